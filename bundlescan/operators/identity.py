"""Content identity of files and bundles.

``bundle_fingerprint`` identifies a bundle by the set of (path, sha256) of its own files
(archive members, ``__pycache__`` folders and ``*.pyc`` excluded, as the reference packer
does). Each file gives h = SHA-256(path NUL sha256). One bundle may hold a third of all
files, so its hashes are not sorted into one row: they fall into 65,536 buckets by their
first four hex digits, each bucket is the SHA-256 of its sorted hashes, and the
fingerprint the SHA-256 of the count and the sorted bucket hashes. Two bundles with one
fingerprint would be a collision of SHA-256, and the order of files does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import base_name

BUCKET_DIGITS = 4


def file_hashes(content: Column) -> tuple[Column, Column]:
    return F.sha2(content, 256), F.md5(content)


def fingerprint_member(path: Column, extracted_from: Column) -> Column:
    """True for files that take part in the bundle identity."""
    pyc = F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1) == ".pyc"
    return extracted_from.isNull() & ~path.rlike(r"(^|/)__pycache__(/|$)") & ~pyc


def with_bucket(entries: DataFrame) -> DataFrame:
    """Entries with _h, the hash of a file that takes part in the identity, and _bucket, its first
    digits; both are null for other files."""
    h = F.when(fingerprint_member(F.col("path"), F.col("extracted_from")), F.sha2(F.concat_ws("\u0000", "path", "sha256"), 256))
    return entries.withColumn("_h", h).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))


def by_bucket(hashed: DataFrame, own: Column | None = None, *more: Column) -> DataFrame:
    """(bundle_id, _bucket, _files, _hash) of the files with_bucket() has seen, those that own holds
    for, and the aggregates in more over all rows of the bucket; files that don't take part in the
    identity are in a bucket of their own."""
    h = F.col("_h") if own is None else F.when(own, F.col("_h"))
    return hashed.groupBy("bundle_id", "_bucket").agg(
        F.count(h).alias("_files"), F.sha2(F.array_join(F.sort_array(F.collect_list(h)), ""), 256).alias("_hash"), *more)


def from_buckets(own: Column | None = None) -> Column:
    """The aggregate of a bundle's buckets, those that own holds for, that is its fingerprint."""
    hashes = F.collect_list(F.when(F.col("_bucket").isNotNull() & (F.lit(True) if own is None else own), F.col("_hash")))
    return F.sha2(F.concat_ws(":", F.sum("_files").cast("string"), F.array_join(F.sort_array(hashes), "")), 256)


def bundle_fingerprint(entries: DataFrame) -> DataFrame:
    """(bundle_id, fingerprint) for every bundle, also one without files of its own."""
    return bucket_table(entries).groupBy("bundle_id").agg(from_buckets().alias("fingerprint"))


def bucket_table(entries: DataFrame) -> DataFrame:
    """(bundle_id, _bucket, _files, _hash): the table to keep, so that a fingerprint can be brought up
    to date from the buckets that changed."""
    return by_bucket(with_bucket(entries.select("bundle_id", "path", "extracted_from", "sha256")))


def changed_buckets(before: DataFrame, after: DataFrame, stored: DataFrame) -> DataFrame:
    """The bucket table after a change. before, after: the entries (bundle_id, path, extracted_from,
    sha256) of the files that the change took away and brought; a file with new contents is in both.
    stored: the member table (bundle_id, _bucket, _h) as it was, of which only the buckets that
    changed are read (a semi join on their few keys), together with the new hashes."""
    gone, new = (with_bucket(x.select("bundle_id", "path", "extracted_from", "sha256")).select("bundle_id", "_bucket", "_h", F.lit(k).alias("_k"))
                 for x, k in ((before, -1), (after, 1)))
    moved = gone.unionByName(new)
    keys = moved.select("bundle_id", "_bucket").distinct()
    same = (stored["_bucket"].eqNullSafe(keys["_bucket"])) & (stored["bundle_id"] == keys["bundle_id"])
    kept = stored.join(keys, same, "left_semi").withColumn("_k", F.lit(1)).unionByName(moved)
    # equal hashes are the same file of a bundle: its signs add up to 1 where it is still there
    left = kept.filter(F.col("_h").isNotNull()).groupBy("bundle_id", "_bucket", "_h").agg(F.sum("_k").alias("_k")).filter(F.col("_k") > 0)
    return by_bucket(left.select("bundle_id", "_bucket", F.explode(F.array_repeat("_h", F.col("_k").cast("int"))).alias("_h")))


def refreshed(buckets: DataFrame, before: DataFrame, after: DataFrame, stored: DataFrame) -> DataFrame:
    """(bundle_id, fingerprint) of the bundles that a change touched, from the kept bucket table and the
    buckets that changed: equal to the full value."""
    new = changed_buckets(before, after, stored)
    keys = with_bucket(before.select("bundle_id", "path", "extracted_from", "sha256").unionByName(
        after.select("bundle_id", "path", "extracted_from", "sha256"))).select("bundle_id", "_bucket").distinct()
    touched = buckets.join(keys.select("bundle_id").distinct(), "bundle_id", "left_semi")
    old = touched.join(keys, (touched["_bucket"].eqNullSafe(keys["_bucket"])) & (touched["bundle_id"] == keys["bundle_id"]), "left_anti")
    return old.unionByName(new).groupBy("bundle_id").agg(from_buckets().alias("fingerprint"))
