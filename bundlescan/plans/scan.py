"""The end-to-end scan plan: files -> entries -> findings -> bundles -> reports.

    files ──► entries (hashes, MIME, text) ──► scanned (one array of findings a file)     narrow
                                                  ├──► findings   (explode)               narrow
                                                  └──► bundles    (by bucket, by bundle)  two shuffles

``scan_new_bundles`` puts the cache lookup (left anti join on the fingerprint) in
front of text extraction, so bundles already reported are never read as text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archives as A
from ..operators import bundle as B
from ..operators import identity as I
from ..operators import indicators as IND
from ..operators import lines as L
from ..operators import report as R
from ..session import written
from ..sources import files as S

ENTRY_COLS = ["bundle_id", "path", "size_bytes", "mime_type", "sha256", "md5", "is_archive", "extracted_from",
              "depth", "suffix", "is_script", "line_count", "_meta_text"]


def scanned(entries: DataFrame) -> DataFrame:
    """The single content pass: one row per file with its entry columns and ``_found``, the array of
    all its findings (24 keys, three grains)."""
    t, held = F.col("text"), F.col("_held")
    gates = IND.with_held_literals(entries, ENTRY_COLS + ["text"]).select(
        *ENTRY_COLS, "text", IND.items(IND.key_arrays(t, held=held), F.col("is_script")).alias("_items"),
        L.detector_gate(t, F.col("suffix"), fold=F.col("_fold"), held=held).alias("_fired"),
        L.invisible_gate(t).alias("_inv"), L.dns_gate(t, F.col("_fold"), held).alias("_dns"))
    sets = F.transform("_items", lambda x: L.finding(x["key"], x["value"], decoded=x["decoded"]))
    none = F.array().cast(f"array<{L.FOUND}>")
    lines = L.line_findings(t, F.col("_fired"), F.col("_inv"), F.col("_dns"))
    return gates.select(*ENTRY_COLS, F.concat(F.coalesce(sets, none), F.coalesce(lines, none)).alias("_found"))


def findings(entries: DataFrame) -> DataFrame:
    """Long findings table of ``entries`` (batch or streaming). A file is named by bundle, path, the
    hash of the archive it came from and its own hash: paths may repeat between archives. (The outer
    generator keeps the optimizer from testing the array's size below the scan, which would copy
    the whole pass into a filter.)"""
    return found_in(scanned(entries))


def found_in(scanned: DataFrame) -> DataFrame:
    """The long findings of files that are scanned."""
    return scanned.select("bundle_id", "path", "extracted_from", "sha256", F.inline_outer("_found")).where(F.col("key").isNotNull())


def bundles(files: DataFrame) -> DataFrame:
    """One flat row per bundle: totals, identity, metadata, package files, the 24 finding counts as
    ``MAP<STRING,BIGINT>`` and the first file of each hit category. Contents are read once."""
    return B.rollup(scanned(S.entries(files)))


def scan_new_bundles(files: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, findings of misses): reported bundles come back with their report; only
    the others are decoded and scanned."""
    hits, todo = new_files(files, reports)
    return hits, findings(S.entries(todo))


def new_files(files: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, files of the bundles without a report). The semi join is on the raw files, before any
    text is decoded; Spark splits a bundle that is too large for one of its tasks."""
    hits, misses = R.cache_lookup(I.bundle_fingerprint(S.entries(files)), reports)
    return hits, files.join(misses.select("bundle_id"), "bundle_id", "left_semi")


def run(files: DataFrame, reports: DataFrame | None = None, expand: bool = True, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """End-to-end scan of a ``files(bundle_id, path, content)`` table.

    targets: files of the same columns that are zips to scan as bundles of their own, by the root
    rule (``archives.zip_targets``); identity and metadata are those of their content.

    Returns ``entries`` (one row per file, archive members included, with its findings),
    ``findings`` (long, all 24 keys), ``bundles`` (one row per bundle), ``archive_status`` (one row
    per archive met) and, with ``reports``, ``cached`` (bundles whose fingerprint already has a
    report, joined to it; their files are not scanned and they do not appear in ``findings`` or
    ``bundles``). Archives are unpacked once and contents scanned once: both are written to the
    shared folder, and all results read them there.
    """
    out: dict[str, DataFrame] = {}
    if targets is not None:
        # scanning is bound by CPU: contents are dealt over all tasks, not over as few as their bytes fill
        n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = written(A.zip_targets(targets), "targets").repartition(n, "bundle_id", "path")
        files = files.select("bundle_id", "path", "content").unionByName(dealt)
    if reports is not None:
        out["cached"], files = new_files(files, reports)
    if expand:
        unpacked = written(A.unpack(files), "unpacked")
        out["archive_status"] = A.statuses(unpacked)
        files = A.with_members(files, unpacked)
    entries = written(scanned(S.entries(files)), "scanned")
    return out | {"entries": entries, "findings": found_in(entries), "bundles": B.rollup(entries)}


def write_artifact(files: DataFrame, path: str, expand: bool = True) -> str:
    """The scan's artifact below path, whole or not at all: a run's datasets are written into a folder
    of its own -- ``files`` (a row a file with its findings), ``bundles`` (skill information, summary,
    scan metadata), ``dotfiles`` (a row a hidden name) and ``archives`` (a row an archive met) -- and
    a row in ``manifest`` commits them, which says where they are and how many rows they have.
    Readers (``read_artifact``) look only there, so a run that failed on the way is never seen.
    Contents are read once; bundles are added up from the written files. -> the run's name."""
    spark, run_id = files.sparkSession, uuid.uuid4().hex
    at = f"{path}/runs/{run_id}"
    if expand:
        unpacked = written(A.unpack(files), "unpacked")
        A.statuses(unpacked).write.parquet(f"{at}/archives")
        files = A.with_members(files, unpacked)
    scanned(S.entries(files)).write.parquet(f"{at}/files")
    own = spark.read.parquet(f"{at}/files")
    info = ["name", "version", "author", "description"]
    B.rollup(own).select(
        "bundle_id", F.col("fingerprint").alias("skill_sha256"),
        F.struct(F.current_timestamp().alias("timestamp"), F.lit(VERSION).alias("scanner_version")).alias("scan_metadata"),
        F.struct(*info, F.struct(*info).alias("frontmatter"), "total_files", "total_size_bytes", "script_count", "total_lines",
                 "has_skill_md", "has_readme",
                 F.struct("has_install_hooks", "install_hooks_found", "package_files_found").alias("dependency_metadata")).alias("skill_info"),
        F.struct(F.col("total_files").alias("total_files_scanned"), F.col("archives_extracted").alias("total_archives_extracted"),
                 "finding_counts", "n_hidden_dotfiles").alias("summary")).write.parquet(f"{at}/bundles")
    B.hidden_dotfiles_long(own).write.parquet(f"{at}/dotfiles")
    names = ["files", "bundles", "dotfiles"] + ["archives"] * expand
    rows = {n: spark.read.parquet(f"{at}/{n}").count() for n in names}
    (spark.createDataFrame([(run_id, rows)], "run string, rows map<string,bigint>").withColumn("committed", F.current_timestamp())
     .coalesce(1).write.mode("append").parquet(f"{path}/manifest"))
    return run_id


def read_artifact(spark: SparkSession, path: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """The datasets of a committed run, the last one unless named. Fewer or more rows than the manifest
    says are an error."""
    manifest = spark.read.parquet(f"{path}/manifest")
    if run_id is not None:
        manifest = manifest.filter(F.col("run") == run_id)
    last = manifest.orderBy(F.desc("committed")).first()
    if last is None:
        raise ValueError(f"{path}: no such committed run")
    out = {n: spark.read.parquet(f"{path}/runs/{last['run']}/{n}") for n in last["rows"]}
    for name, n in last["rows"].items():
        if out[name].count() != n:
            raise ValueError(f"{path}: {name} of run {last['run']} is not what was committed")
    return out


VERSION = "2"
