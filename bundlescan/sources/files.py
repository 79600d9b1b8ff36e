"""File-level source layer: the ``files(bundle_id, path, content)`` contract -> ``entries``.

All columns are JVM expressions on the path and the bytes (no Python per row):
base name, suffix, MIME type from the name, text test, archive kind, hashes and the
decoded text (of every text type, whatever its size; UTF-8 with U+FFFD for bad bytes; CRLF and
lone CR -> LF; a BOM is kept).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.mime import ENCODINGS, SUFFIX_MAP, TYPES_MAP


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """``Path(p).suffix.lower()``: last dot of the base name, needs a character before
    it and one after it (so ``.env`` and ``a.`` have none)."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def _splitext_ext(name: Column) -> Column:
    # posixpath.splitext on a base name: extension from the last dot, if some
    # non-dot character comes before that dot (a trailing '.' is an extension)
    return F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)


def _strip_ext(name: Column, ext: Column) -> Column:
    return F.left(name, F.length(name) - F.length(ext))


def with_mime_type(df: DataFrame, path: str = "path", out: str = "mime_type") -> DataFrame:
    """Add ``mimetypes.guess_type`` (strict) on the name, default
    ``application/octet-stream``: suffix aliases (``.tgz`` -> ``.tar.gz``), one compression
    suffix stripped, then the type of the remaining extension. Built in stages (one
    column per step) so that no sub-expression is copied into its consumers."""
    aliases = F.create_map(*[F.lit(x) for kv in SUFFIX_MAP.items() for x in kv])
    types = F.create_map(*[F.lit(x) for kv in TYPES_MAP.items() for x in kv])
    lower_enc = [e for e in ENCODINGS if e == e.lower()]
    df = df.withColumn("_mn", base_name(F.col(path)))
    df = df.withColumn("_me", _splitext_ext(F.col("_mn")))
    df = df.withColumn("_ma", F.element_at(aliases, F.lower(F.col("_me"))))
    df = df.withColumn("_mn", F.when(F.col("_ma").isNotNull(),
                                     F.concat(_strip_ext(F.col("_mn"), F.col("_me")), F.col("_ma"))).otherwise(F.col("_mn")))
    df = df.withColumn("_me", _splitext_ext(F.col("_mn")))
    df = df.withColumn("_mn", F.when(F.col("_me").isin(*ENCODINGS) | F.lower(F.col("_me")).isin(*lower_enc),
                                     _strip_ext(F.col("_mn"), F.col("_me"))).otherwise(F.col("_mn")))
    df = df.withColumn("_me", _splitext_ext(F.col("_mn")))
    df = df.withColumn(out, F.coalesce(F.element_at(types, F.col("_me")), F.element_at(types, F.lower(F.col("_me"))),
                                       F.lit("application/octet-stream")))
    return df.drop("_mn", "_me", "_ma")


def is_text(mime: Column, sfx: Column) -> Column:
    return mime.startswith("text/") | mime.isin(*rules.TEXT_MIME_TYPES) | sfx.isin(*rules.TEXT_EXTENSIONS)


def archive_extension(path: Column) -> Column:
    """Longest archive extension the lower-cased name ends with, '' if none."""
    low = F.lower(base_name(path))
    exts = sorted(rules.ARCHIVE_EXTENSIONS, key=len, reverse=True)
    return F.coalesce(*[F.when(low.endswith(e), F.lit(e)) for e in exts], F.lit(""))


def read_text(content: Column, text_ok: Column) -> Column:
    return F.when(text_ok, meta_text(content))


META_FILES = ["SKILL.md", "package.json", "setup.py"]


def meta_text(content: Column) -> Column:
    """Text as the reference reads bundle metadata files: UTF-8 with replacement,
    universal newlines, no size or type gate."""
    bytes_, text = content.cast("string"), F.make_valid_utf8(content.cast("string"))
    return F.when(bytes_.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def line_count(text: Column) -> Column:
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(F.octet_length(text), F.lit(0)) > 0, ends + 1).otherwise(0).cast("long")


def entries(files: DataFrame) -> DataFrame:
    """``files(bundle_id, path, content[, extracted_from, depth])`` -> entries."""
    cols = files.columns
    p, c = F.col("path"), F.col("content")
    ef = F.col("extracted_from") if "extracted_from" in cols else F.lit(None).cast("string")
    dp = F.col("depth") if "depth" in cols else F.lit(0)
    e = files.select(
        "bundle_id", "path", c,
        F.length(c).cast("long").alias("size_bytes"),
        F.sha2(c, 256).alias("sha256"),
        F.md5(c).alias("md5"),
        (archive_extension(p) != "").alias("is_archive"),
        ef.alias("extracted_from"),
        dp.cast("int").alias("depth"),
        suffix(p).alias("suffix"),
    )
    e = with_mime_type(e)
    e = e.withColumn("is_script", F.col("suffix").isin(*rules.SCRIPT_EXTENSIONS))
    e = e.withColumn("text", read_text(c, is_text(F.col("mime_type"), F.col("suffix"))))
    # root metadata files keep their text here, so bundle metadata never re-reads the content
    e = e.withColumn("_meta_text", F.when(F.col("extracted_from").isNull() & F.col("path").isin(*META_FILES),
                                          meta_text(c)))
    return e.withColumn("line_count", line_count(F.col("text"))).drop("content")
