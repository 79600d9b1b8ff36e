"""Per-bundle roll-ups: totals, finding counts, dotfiles, package files, metadata.

All roll-ups are ``groupBy(bundle_id)`` aggregates with map-side partial aggregation,
so a bundle holding a third of all files is combined per task before the shuffle.
Bundle metadata (front matter, install hooks) reads only root-level ``SKILL.md``,
``package.json`` and ``setup.py`` rows, which a filter selects before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dialect import to_java
from ..sources.files import META_FILES, base_name, meta_text
from . import identity


#: What a bucket of a dotfile's name begins with; hash buckets are hex digits.
NAME_BUCKET = "name:"


def is_root(path: Column, extracted_from: Column) -> Column:
    return extracted_from.isNull() & ~path.contains("/")


def hidden_name(name: Column) -> Column:
    return name.startswith(".") & ~name.isin(*rules.ALLOWED_DOTFILES)


def hidden_dotfiles_long(entries: DataFrame) -> DataFrame:
    """(bundle_id, name) of hidden dotfiles as a distributed distinct — no per-bundle list."""
    name = base_name(F.col("path"))
    return entries.select("bundle_id", name.alias("name")).where(hidden_name(F.col("name"))).distinct()


def package_files_long(entries: DataFrame) -> DataFrame:
    name = base_name(F.col("path"))
    return entries.select("bundle_id", name.alias("name")).where(F.col("name").isin(*rules.PACKAGE_FILES)).distinct()


def bundle_stats(entries: DataFrame) -> DataFrame:
    """Totals, package files and root flags of each bundle."""
    name = base_name(F.col("path"))
    root = is_root(F.col("path"), F.col("extracted_from"))
    return entries.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("size_bytes").cast("long").alias("total_size_bytes"),
        F.count_if(F.col("is_script")).alias("script_count"),
        F.sum("line_count").cast("long").alias("total_lines"),
        F.count_if(F.col("extracted_from").isNotNull()).alias("archives_extracted"),
        F.sort_array(F.collect_set(F.when(name.isin(*rules.PACKAGE_FILES), name))).alias("package_files_found"),
        F.coalesce(F.bool_or(root & (F.col("path") == "SKILL.md")), F.lit(False)).alias("has_skill_md"),
        F.coalesce(F.bool_or(root & F.col("path").isin(*rules.README_NAMES)), F.lit(False)).alias("has_readme"),
    )


def rollup(files: DataFrame) -> DataFrame:
    """One row a bundle from one pass over its files (entries with ``_found``, the array of a file's
    findings): totals, flags, counts by key, distinct dotfile names, the first file of each category,
    fingerprint and root metadata. Two aggregates, by (bundle, hash bucket) and then by bundle: a
    bundle that holds a third of all files is spread over its buckets, and no list grows with its
    files. A hidden dotfile also stands in a bucket of its name, which counts once."""
    name, root = base_name(F.col("path")), is_root(F.col("path"), F.col("extracted_from"))
    files = files.withColumn("_keys", F.transform("_found", lambda x: x["key"])).withColumn(
        "_categories", F.array_distinct(F.transform(F.filter("_found", lambda x: x["category"].isNotNull()), lambda x: x["category"])))
    files = identity.with_bucket(files).withColumn("_n", F.array(*[F.size("_keys") - F.size(F.array_remove("_keys", k)) for k in rules.FINDING_KEYS]))
    named = F.concat(F.lit(NAME_BUCKET), name)
    files = files.withColumn("_bucket", F.explode(F.when(hidden_name(name), F.array("_bucket", named)).otherwise(F.array("_bucket"))))
    of_name = F.coalesce(F.col("_bucket").startswith(NAME_BUCKET), F.lit(False))
    own = lambda c: F.when(~of_name, c)
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    text_of = lambda p: F.first(F.when(~of_name & root & (F.col("path") == p), F.col("_meta_text")), ignorenulls=True)
    sums = {"total_files": F.lit(1), "total_size_bytes": F.col("size_bytes"), "script_count": F.col("is_script").cast("int"),
            "total_lines": F.col("line_count"), "archives_extracted": F.col("extracted_from").isNotNull().cast("int")}
    sums |= {f"_n_{k}": F.element_at("_n", i + 1) for i, k in enumerate(rules.FINDING_KEYS)}
    flags = {"has_skill_md": root & (F.col("path") == "SKILL.md"), "has_readme": root & F.col("path").isin(*rules.README_NAMES)}
    flags |= {f"_package_{i}": name == p for i, p in enumerate(rules.PACKAGE_FILES)}
    firsts = {f"_first_{c}": F.when(F.array_contains("_categories", c), F.col("path")) for c in rules.CATEGORIES}
    metas = {"_skill": "SKILL.md", "_pkg": "package.json", "_setup": "setup.py"}
    parts = identity.by_bucket(files, ~of_name, *[F.sum(own(c)).cast("long").alias(k) for k, c in sums.items()],
                               *[yes(own(c)).alias(k) for k, c in flags.items()], *[F.min(own(c)).alias(k) for k, c in firsts.items()],
                               *[text_of(p).alias(k) for k, p in metas.items()])
    whole = parts.groupBy("bundle_id").agg(
        identity.from_buckets(~of_name).alias("fingerprint"), F.count_if(of_name).alias("n_hidden_dotfiles"), *[F.sum(k).alias(k) for k in sums],
        *[yes(F.col(k)).alias(k) for k in flags], *[F.min(k).alias(k) for k in firsts], *[F.first(k, ignorenulls=True).alias(k) for k in metas])
    counts = F.create_map(*[x for k in rules.FINDING_KEYS for x in (F.lit(k), F.col(f"_n_{k}"))])
    packages = F.sort_array(F.array_compact(F.array(*[F.when(F.col(f"_package_{i}"), F.lit(p)) for i, p in enumerate(rules.PACKAGE_FILES)])))
    firsts_ = F.sort_array(F.array_compact(F.array(*[
        F.when(F.col(f"_first_{c}").isNotNull(), F.struct(F.lit(f"Detected {c}").alias("description"), F.col(f"_first_{c}").alias("file")))
        for c in rules.CATEGORIES])))
    hooks = hooks_of(F.col("_pkg"), F.col("_setup"))
    return whole.select(
        "bundle_id", "fingerprint", *[k for k in sums if not k.startswith("_")], "n_hidden_dotfiles", counts.alias("finding_counts"),
        packages.alias("package_files_found"), hooks.alias("install_hooks_found"), (F.size(hooks) > 0).alias("has_install_hooks"),
        "has_skill_md", "has_readme", *frontmatter_cols(F.col("_skill")), firsts_.alias("findings"))


# ------------------------------------------------------------------ metadata

def _block_scalar(block: Column, key: str) -> Column:
    """A literal (|) or folded (>) block scalar: the indented lines after the key, without their
    common indent; folded, a single line feed is a space and each further one stays; then the
    chomping sign: ``-`` drops line feeds at the end, ``+`` keeps them, else one stays."""
    found = f"(?sd)(?:^|\\n){key}:[ \\t]*([|>])([+-]?)[0-9]?[ \\t]*(?:#[^\\n]*)?\\n(?=[ \\n])(.*?)(?=\\n[^ \\n]|\\z)"
    style, chomp = F.regexp_extract(block, found, 1), F.regexp_extract(block, found, 2)
    body = F.concat(F.regexp_extract(block, found, 3), F.lit("\n"))
    indent = F.length(F.regexp_extract(body, "^\\n*( *)", 1)).cast("string")
    body = F.regexp_replace(body, F.concat(F.lit("(?md)^ {0,"), indent, F.lit("}")), F.lit(""))
    end = F.regexp_extract(body, "(?d)\\n*\\z", 0)
    core = F.regexp_replace(body, "(?d)\\n*\\z", "")
    folded = F.regexp_replace(F.regexp_replace(core, "(?d)(?<!\\n)\\n(?![\\n ])", " "), "(?d)(?<!\\n)\\n(\\n+)(?! )", "$1")
    core = F.when(style == ">", folded).otherwise(core)
    return F.when(style != "", F.concat(core, F.when((chomp == "-") | (core == ""), F.lit("")).when(chomp == "+", end).otherwise(F.lit("\n"))))


def _scalar(block: Column, key: str) -> Column:
    """The value of a top-level key: quoted, plain (up to `` #``, a comment) or a block scalar; ''
    for a flow collection, which is no scalar, and for a key that is missing."""
    raw = F.regexp_extract(block, f"(?md)^{key}:[ \\t]*(.*?)[ \\t]*$", 1)
    dq, sq = r'(?d)^"((?:[^"\\]|\\.)*+)"[ \t]*(?:#.*)?$', r"(?d)^'((?:[^']|'')*+)'[ \t]*(?:#.*)?$"
    plain = F.regexp_replace(raw, r"(?d)(?:^|[ \t]+)#.*$", "")
    double = F.regexp_extract(raw, dq, 1)
    for escaped, char in ((r"\\n", "\n"), (r"\\t", "\t"), (r'\\"', '"'), (r"\\\\", r"\\")):
        double = F.regexp_replace(double, escaped, char)
    return (F.when(raw.rlike(r"^[|>]"), F.coalesce(_block_scalar(block, key), F.lit("")))
            .when(raw.rlike(dq), double)
            .when(raw.rlike(sq), F.replace(F.regexp_extract(raw, sq, 1), F.lit("''"), F.lit("'")))
            .when(raw.rlike(r"^[\[{]"), F.lit(""))
            .otherwise(plain))


def frontmatter_cols(text: Column) -> list[Column]:
    """name, version, author, description: top-level scalars of the block between the
    first two ``---`` of a SKILL.md that starts with ``---``; '' when absent."""
    parts = F.split(text, "---", 3)
    block = F.when(text.startswith("---") & (F.size(parts) == 3), F.element_at(parts, 2))
    return [F.coalesce(_scalar(block, k), F.lit("")).alias(k) for k in ("name", "version", "author", "description")]


def install_hooks_col(pkg_text: Column) -> Column:
    """Hook names among the keys of ``scripts``. The whole text must be one JSON value; of repeated
    keys the last counts."""
    strict = {"allowSingleQuotes": "false"}
    whole = F.size(F.from_json(F.concat(F.lit("["), pkg_text, F.lit("]")), "array<string>", strict)) == 1
    scripts = F.when(whole, F.from_json(pkg_text, "scripts string", strict)["scripts"])
    keys = (F.when(scripts.startswith("{"), F.json_object_keys(scripts))
            .when(scripts.startswith("["), F.from_json(scripts, "array<string>")))
    return F.sort_array(F.array_intersect(keys, F.array(*[F.lit(h) for h in rules.INSTALL_HOOKS])))


def hooks_of(package_json: Column, setup_py: Column) -> Column:
    """Install hooks of the two files' texts (null: no such file)."""
    hooks = F.coalesce(install_hooks_col(package_json), F.array().cast("array<string>"))
    return F.concat(hooks, F.when(F.coalesce(setup_py.rlike(to_java(r"cmdclass\s*=")), F.lit(False)), F.array(F.lit("cmdclass")))
                    .otherwise(F.array().cast("array<string>")))


def bundle_meta(files: DataFrame) -> DataFrame:
    """files(bundle_id, path, content[, extracted_from]) -> one row per bundle that has
    any root metadata file: name, version, author, description, install hooks."""
    ef = F.col("extracted_from") if "extracted_from" in files.columns else F.lit(None).cast("string")
    m = files.where(ef.isNull() & F.col("path").isin(*META_FILES)).select(
        "bundle_id", "path", meta_text(F.col("content")).alias("t"))
    return meta_from_text(m)


def meta_from_text(m: DataFrame) -> DataFrame:
    """(bundle_id, path, t) rows of root metadata files -> metadata per bundle."""
    agg = m.groupBy("bundle_id").agg(*[F.first(F.when(F.col("path") == p, F.col("t")), ignorenulls=True).alias(p) for p in META_FILES])
    return agg.select("bundle_id", *frontmatter_cols(F.col("`SKILL.md`")),
                      hooks_of(F.col("`package.json`"), F.col("`setup.py`")).alias("install_hooks_found")).withColumn(
        "has_install_hooks", F.size("install_hooks_found") > 0)
