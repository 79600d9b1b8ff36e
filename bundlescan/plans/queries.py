"""Registered queries: name -> (spark builder, DuckDB oracle or None).

Every builder takes ``(spark, sf_dir)`` and reads the driver tables (or data Spark
derives from them), so its work grows with the tables. Integer outputs are BIGINT on
both sides; arrays are emitted as long rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import lines
from ..functions.dialect import sql_str, to_re2
from ..session import ensure_checkpoint_dir, written
from ..sources.corpus import corpus_sql, scan_text, text_source
from . import oracle_lines as OL

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, Callable[[], str] | None]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def keep_if(df: DataFrame, cond) -> DataFrame:
    """Filter written as a generator: Catalyst pushes a Filter below the projection that
    computes its inputs and then evaluates expensive expressions twice; a conditional
    one-element explode stays above it."""
    return df.select("*", F.explode(F.when(cond, F.array(F.lit(True)))).alias("_keep")).drop("_keep")


def _long(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


# ---------------------------------------------------------------- line grain (§2.8)

@register("security_patterns", OL.security_patterns_sql)
def q_security_patterns(spark, sf):
    return _long(lines.detector_hits(scan_text(spark, sf)), "line")


def _category_query(category: str):
    def q(spark, sf):
        return _long(lines.category_hits(scan_text(spark, sf), category), "line")
    register(f"detect_{category}", lambda: OL.category_sql(category))(q)


for _c in rules.CATEGORIES:
    _category_query(_c)


@register("category_counts", OL.category_counts_sql)
def q_category_counts(spark, sf):
    hits = lines.detector_hits(scan_text(spark, sf))
    return (hits.groupBy("bundle_id", "category", "pattern_name")
            .agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("path").alias("n_files")))


@register("invisible_unicode", OL.invisible_unicode_sql)
def q_invisible_unicode(spark, sf):
    return _long(lines.invisible_unicode(scan_text(spark, sf)), "line", "position")


@register("dns_exfil_patterns", OL.dns_exfil_sql)
def q_dns_exfil(spark, sf):
    return _long(lines.dns_exfil(scan_text(spark, sf)), "line")


# ---------------------------------------------------------------- set / presence grain (§2.6-2.7)

from ..operators import indicators as IND  # noqa: E402
from . import oracle_indicators as OI  # noqa: E402


def _indicator_query(name: str, keys: list[str], oracle):
    def q(spark, sf):
        rows = IND.indicator_rows(IND.file_indicators(scan_text(spark, sf)), keys=keys)
        return rows if "base64_strings" in keys else rows.drop("decoded")
    register(name, oracle)(q)


for _k in OI.SIMPLE:
    _indicator_query(_k, [_k], (lambda k: lambda: OI.simple_sql(k))(_k))
_indicator_query("shell_commands", ["shell_commands"], OI.shell_commands_sql)
_indicator_query("sensitive_file_paths", ["sensitive_file_paths"], OI.sensitive_file_paths_sql)
_indicator_query("suspicious_imports", ["suspicious_imports"], OI.suspicious_imports_sql)
_indicator_query("sensitive_env_vars", ["sensitive_env_var_names"], OI.sensitive_env_vars_sql)
_indicator_query("base64_strings", ["base64_strings"], OI.base64_sql)
_indicator_query("crypto_wallets", ["crypto_wallets"], OI.wallets_sql)


def _base58_sql():
    return (f"{OI._files()}\nSELECT bundle_id, path, candidate, {OI.base58check_duck('candidate')} AS valid FROM "
            f"(SELECT DISTINCT bundle_id, path, unnest(regexp_extract_all(text, {sql_str(to_re2(rules.BTC_WALLET))}, 0)) "
            f"AS candidate FROM tfiles) WHERE NOT starts_with(candidate, 'bc1')")


@register("base58check", _base58_sql)
def q_base58check(spark, sf):
    """Every legacy-address-shaped candidate with its Base58Check verdict."""
    t = scan_text(spark, sf)
    c = (t.where(F.col("text").isNotNull())
         .select("bundle_id", "path", F.explode(IND.btc_candidates(F.col("text"))).alias("candidate"))
         .where(~F.col("candidate").startswith("bc1")))
    return c.select("bundle_id", "path", "candidate", F.expr(IND.base58check_sql("candidate")).alias("valid"))


@register("secret_hits", OI.secret_hits_sql)
def q_secret_hits(spark, sf):
    t = scan_text(spark, sf).where(F.col("text").isNotNull())
    return (t.select("bundle_id", "path", F.explode(IND.secret_counts(F.col("text"))).alias("_s"))
            .select("bundle_id", "path", "_s.label", "_s.n").where(F.col("n") > 0))


@register("redact_secrets", OI.redact_secrets_sql)
def q_redact_secrets(spark, sf):
    t = scan_text(spark, sf)
    r = keep_if(t.select("bundle_id", "path", "text", IND.redact(F.col("text")).alias("_r")),
                F.col("_r") != F.col("text"))
    return r.select("bundle_id", "path", F.md5("_r").alias("redacted_md5"),
                    F.length("_r").cast("long").alias("redacted_chars"))


# ---------------------------------------------------------------- file layer (§2.1, §2.2, §2.10)

from ..operators import archives as ARC  # noqa: E402
from ..operators import bundle as BND  # noqa: E402
from ..operators import identity as IDN  # noqa: E402
from ..sources import files as SRC  # noqa: E402
from ..sources import tree  # noqa: E402
from ..sources.fixtures import corpus_files  # noqa: E402
from . import oracle_files as OF  # noqa: E402


def _entries(spark, sf):
    """All files, those in archives too."""
    return SRC.entries(ARC.expand_archives(corpus_files(spark, sf)))


@register("file_inventory", OF.inventory_sql)
def q_file_inventory(spark, sf):
    return _entries(spark, sf).select("bundle_id", "path", "size_bytes", "mime_type", "sha256", "md5", "is_archive",
                                      "extracted_from", F.col("depth").cast("long").alias("depth"))


@register("mime_type", lambda: OF.with_entries("SELECT bundle_id, path, mime_type FROM entries"))
def q_mime_type(spark, sf):
    return _entries(spark, sf).select("bundle_id", "path", "mime_type")


@register("is_text", OF.is_text_sql)
def q_is_text(spark, sf):
    return _entries(spark, sf).select("bundle_id", "path",
                                      SRC.is_text(F.col("mime_type"), F.col("suffix")).alias("is_text"))


@register("archive_kind", OF.archive_kind_sql)
def q_archive_kind(spark, sf):
    return _entries(spark, sf).select("bundle_id", "path", SRC.archive_extension(F.col("path")).alias("archive_extension"),
                                      "is_archive")


@register("script_classify", lambda: OF.with_entries("SELECT bundle_id, path, suffix, is_script FROM entries"))
def q_script_classify(spark, sf):
    return _entries(spark, sf).select("bundle_id", "path", "suffix", "is_script")


@register("read_text", lambda: OF.with_entries(
    "SELECT bundle_id, path, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS text_chars FROM entries"))
def q_read_text(spark, sf):
    e = _entries(spark, sf)  # null text (not a text type) stays as a null row
    return e.select("bundle_id", "path", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_chars"))


@register("line_count", lambda: OF.with_entries("SELECT bundle_id, path, line_count FROM entries"))
def q_line_count(spark, sf):
    return _entries(spark, sf).select("bundle_id", "path", "line_count")


@register("file_hashes", lambda: OF.with_entries("SELECT bundle_id, path, sha256, md5 FROM entries"))
def q_file_hashes(spark, sf):
    return _entries(spark, sf).select("bundle_id", "path", "sha256", "md5")


# ---------------------------------------------------------------- bundle roll-ups (§2.4, §2.10, §2.11)

@register("bundle_totals", OF.bundle_totals_sql)
def q_bundle_totals(spark, sf):
    return BND.bundle_stats(_entries(spark, sf)).select(
        "bundle_id", "total_files", "total_size_bytes", "script_count", "total_lines", "archives_extracted")


@register("hidden_dotfiles", OF.hidden_dotfiles_sql)
def q_hidden_dotfiles(spark, sf):
    return BND.hidden_dotfiles_long(_entries(spark, sf))


@register("package_file_match", OF.package_files_sql)
def q_package_file_match(spark, sf):
    return BND.package_files_long(_entries(spark, sf))


@register("has_skill_md", OF.has_files_sql)
def q_has_skill_md(spark, sf):
    return BND.bundle_stats(_entries(spark, sf)).select("bundle_id", "has_skill_md", "has_readme")


@register("frontmatter", OF.frontmatter_sql)
def q_frontmatter(spark, sf):
    files = corpus_files(spark, sf)
    m = files.where(F.col("path") == "SKILL.md").select("bundle_id", SRC.meta_text(F.col("content")).alias("t"))
    return m.select("bundle_id", *BND.frontmatter_cols(F.col("t")))


@register("install_hooks", OF.install_hooks_sql)
def q_install_hooks(spark, sf):
    meta = BND.bundle_meta(corpus_files(spark, sf))
    return meta.select("bundle_id", F.posexplode("install_hooks_found").alias("pos", "hook")).select(
        "bundle_id", (F.col("pos") + 1).cast("long").alias("pos"), "hook")


@register("bundle_fingerprint", OF.fingerprint_sql)
def q_bundle_fingerprint(spark, sf):
    return IDN.bundle_fingerprint(_entries(spark, sf))


# ---------------------------------------------------------------- composed bundle queries (§2.3, §2.4, §2.11)

from ..operators import report as REP  # noqa: E402
from ..sources.fixtures import reports as fixture_reports  # noqa: E402
from . import oracle_bundle as OB  # noqa: E402
from . import scan as SCAN  # noqa: E402


@register("finding_counts", OB.finding_counts_sql)
def q_finding_counts(spark, sf):
    return SCAN.bundles(ARC.expand_archives(corpus_files(spark, sf))).select("bundle_id", F.explode("finding_counts").alias("key", "n"))


@register("bundle_report", OB.bundle_report_sql)
def q_bundle_report(spark, sf):
    b = SCAN.bundles(ARC.expand_archives(corpus_files(spark, sf)))
    return b.select(
        "bundle_id", "fingerprint", "total_files", "total_size_bytes", "script_count", "total_lines",
        "archives_extracted",
        F.aggregate(F.map_values("finding_counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_findings"),
        "n_hidden_dotfiles", F.array_join("package_files_found", ",").alias("package_files_found"),
        "has_install_hooks", F.array_join("install_hooks_found", ",").alias("install_hooks_found"),
        "has_skill_md", "has_readme", "name", "version", "author", "description")


@register("cache_lookup", OB.cache_lookup_sql)
def q_cache_lookup(spark, sf):
    fps = IDN.bundle_fingerprint(_entries(spark, sf))
    hits, misses = REP.cache_lookup(fps, fixture_reports(spark, sf, fps))
    return (hits.select("bundle_id", "fingerprint", F.lit("hit").alias("status"), "skill_name", "risk_level")
            .unionByName(misses.select("bundle_id", "fingerprint", F.lit("miss").alias("status"),
                                       F.lit(None).cast("string").alias("skill_name"),
                                       F.lit(None).cast("string").alias("risk_level"))))


@register("render_report", OB.render_report_sql)
def q_render_report(spark, sf):
    r = fixture_reports(spark, sf, SCAN.bundles(ARC.expand_archives(corpus_files(spark, sf))), every=True)
    md = REP.render_markdown(F.col("name"), F.col("skill_name"), F.col("adjusted_risk_level"),
                             F.col("risk_level"), F.col("scan_date"), F.col("llm_summary"), F.col("findings"),
                             F.col("source"))
    return r.select("bundle_id", md.alias("markdown"))


# ---------------------------------------------------------------- archives (§2.1, §2.3)

from ..sources import fixtures as FIX  # noqa: E402
from ..sources.fixtures import archive_files, archive_groups_sql, planted_sql  # noqa: E402


def _expanded(spark, sf):
    return ARC.expand_archives(archive_files(spark, sf))


def _expanded_sql():
    return f"""WITH {archive_groups_sql()},
m AS ({_members_sql()})
SELECT bundle_id, path, depth, size_bytes, sha256, false AS is_archive FROM m
UNION ALL SELECT bundle_id, path, depth, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), true FROM ({_guard_sql()})"""


@register("expand_archives", lambda: _expanded_sql())
def q_expand_archives(spark, sf):
    """All files of the archive fixture with their members. A container's size and hash depend on
    the packer, so they are left out."""
    own = F.when(~F.col("is_archive"), F.lit(True))
    return SRC.entries(_expanded(spark, sf)).select(
        "bundle_id", "path", F.col("depth").cast("long").alias("depth"), F.when(own, F.col("size_bytes")).alias("size_bytes"),
        F.when(own, F.col("sha256")).alias("sha256"), "is_archive")


def _guard_sql():
    return f"""WITH {archive_groups_sql()}
SELECT bundle_id, 'pack_' || CAST(g AS VARCHAR) || CASE kind WHEN 0 THEN '.zip' WHEN 1 THEN '.tar.gz'
         WHEN 2 THEN '.tar' ELSE '.zip' END AS path, CAST(0 AS BIGINT) AS depth,
       CASE WHEN kind = 3 THEN 'escape' ELSE 'ok' END AS status FROM groups
UNION ALL SELECT bundle_id, 'inner.zip', CAST(1 AS BIGINT), 'ok' FROM groups WHERE kind = 1
UNION ALL SELECT bundle_id, 'pack_' || CAST(g AS VARCHAR) || '.7z', CAST(0 AS BIGINT), 'unsupported' FROM groups WHERE g % 5 = 0"""


@register("archive_guard", _guard_sql)
def q_archive_guard(spark, sf):
    return ARC.archive_status(archive_files(spark, sf)).select("bundle_id", "path", F.col("depth").cast("long").alias("depth"), "status")


def _lineage_sql():
    exts = "['.py', '.sh', '.js', '.md', '.ps1', '.txt']"
    return f"""WITH {archive_groups_sql()},
d AS (SELECT d.doc_id, g.* FROM documents d JOIN groups g ON d.doc_id // 25 = g.g),
docs AS (SELECT bundle_id, 'docs/doc_' || CAST(doc_id AS VARCHAR) || {exts}[doc_id % 6 + 1] AS path, kind, g FROM d)
SELECT bundle_id, path, CAST(1 AS BIGINT) AS depth,
       'pack_' || CAST(g AS VARCHAR) || CASE kind WHEN 0 THEN '.zip' ELSE '.tar' END AS parent_path
FROM docs WHERE kind IN (0, 2)
UNION ALL SELECT bundle_id, path, CAST(2 AS BIGINT), 'inner.zip' FROM docs WHERE kind = 1
UNION ALL SELECT bundle_id, 'inner.zip', CAST(1 AS BIGINT), 'pack_' || CAST(g AS VARCHAR) || '.tar.gz' FROM groups WHERE kind = 1
UNION ALL SELECT bundle_id, 'README.md', CAST(1 AS BIGINT), 'pack_' || CAST(g AS VARCHAR) || '.tar.gz' FROM groups WHERE kind = 1"""


@register("archive_lineage", _lineage_sql)
def q_archive_lineage(spark, sf):
    return ARC.archive_lineage(_expanded(spark, sf))


# ---------------------------------------------------------------- embedding data work (§2.12)

from ..operators import chunks as CH  # noqa: E402

_WS_RE2 = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+"
_DOC_TOKENS = f"list_filter(regexp_split_to_array(text, '{_WS_RE2}'), lambda x: x != '')"


def _chunks_sql() -> str:
    return f"""tok AS (SELECT doc_id, {_DOC_TOKENS} AS t FROM documents),
st AS (SELECT doc_id, t, len(t) AS n, unnest(CASE WHEN len(t) = 0 THEN []
          WHEN len(t) <= {CH.WINDOW} THEN [0] ELSE range(0, len(t), {CH.STRIDE}) END) AS start FROM tok),
ch AS (SELECT doc_id, CAST(start // {CH.STRIDE} AS BIGINT) AS chunk, CAST(start AS BIGINT) AS start,
              CASE WHEN n <= {CH.WINDOW} THEN t ELSE t[start + 1 : start + {CH.WINDOW}] END AS piece FROM st)"""


@register("token_chunks", lambda: f"WITH {_chunks_sql()}\nSELECT doc_id, chunk, start, "
                                   "CAST(len(piece) AS BIGINT) AS n_tokens, md5(array_to_string(piece, ' ')) AS chunk_md5 FROM ch")
def q_token_chunks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c = CH.token_chunks(docs, "doc_id")
    return c.drop("_k").select("doc_id", "chunk", "start", "n_tokens", F.md5("chunk_text").alias("chunk_md5"))


@register("mean_pool", lambda: """SELECT label, CAST(i - 1 AS BIGINT) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS value
FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i""")
def q_mean_pool(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    m = CH.mean_pool(emb, ["label"], "embedding")
    return m.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def _embed_sql() -> str:
    return f"""WITH {_chunks_sql()},
cw AS (SELECT doc_id, chunk, len(piece) AS n_tokens, unnest(piece) AS tk FROM ch),
cv AS (SELECT doc_id, chunk, CAST(('0x' || substr(md5(tk), 1, 8))::UBIGINT % {CH.HASH_DIM} AS BIGINT) AS dim,
              count(*) / any_value(n_tokens) AS value FROM cw GROUP BY doc_id, chunk, dim),
k AS (SELECT doc_id, count(*) AS k FROM ch GROUP BY doc_id)
SELECT cv.doc_id, cv.dim, round(sum(cv.value) / any_value(k.k), 6) AS value
FROM cv JOIN k USING (doc_id) GROUP BY cv.doc_id, cv.dim"""


@register("embed_text", _embed_sql)
def q_embed_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    v = CH.embed_text(docs, "doc_id")
    return v.select("doc_id", "dim", F.round("value", 6).alias("value"))


@register("dir_text_files", lambda: OF.with_entries(
    f"SELECT bundle_id, path, size_bytes FROM entries WHERE suffix IN "
    f"({', '.join(repr(e) for e in rules.EMBED_DIR_EXTENSIONS)})"))
def q_dir_text_files(spark, sf):
    e = _entries(spark, sf)
    # listing order of the reference: by path components (a/b < a-b < a.txt), a range-partitioned
    # global sort — a hot bundle is split across tasks, no per-bundle window
    return e.where(F.col("suffix").isin(*rules.EMBED_DIR_EXTENSIONS)).select("bundle_id", "path", "size_bytes").orderBy("bundle_id", F.split("path", "/"))


# ---------------------------------------------------------------- remaining §2 items

@register("root_normalize", lambda: f"""WITH {archive_groups_sql()},
d AS (SELECT d.doc_id, g.* FROM documents d JOIN groups g ON d.doc_id // 25 = g.g)
SELECT bundle_id, 'pack_' || CAST(g AS VARCHAR) || '.zip' AS archive_path,
       'doc_' || CAST(doc_id AS VARCHAR) || ['.py', '.sh', '.js', '.md', '.ps1', '.txt'][doc_id % 6 + 1] AS path
FROM d WHERE kind = 0""")
def q_root_normalize(spark, sf):
    return ARC.root_normalize(archive_files(spark, sf)).drop("content")


ROUTED_OUT = [k for k in rules.FINDING_KEYS if k.replace("_in_docs", "") in rules.ROUTED_KEYS
              or k == "sensitive_env_var_assignments"]


def _route_sql():
    with_parts = [OI.shell_commands_sql(), OI.sensitive_file_paths_sql(), OI.suspicious_imports_sql(),
                  OI.sensitive_env_vars_sql(), OI.simple_sql("env_var_references")]
    body = "\nUNION ALL\n".join(f"SELECT bundle_id, path, key FROM ({q})" for q in with_parts)
    return f"SELECT bundle_id, path, key, CAST(count(*) AS BIGINT) AS n_values FROM (\n{body}\n) GROUP BY ALL"


@register("route_docs", _route_sql)
def q_route_docs(spark, sf):
    rows = IND.indicator_rows(IND.file_indicators(scan_text(spark, sf)),
                              keys=["env_var_references", "shell_commands", "sensitive_file_paths",
                                    "suspicious_imports", "sensitive_env_var_names"])
    return rows.groupBy("bundle_id", "path", "key").agg(F.count(F.lit(1)).alias("n_values"))


def _gate_count_spark():
    from ..operators.lines import _gate
    return sum((F.when(_gate(d, F.col("suffix")), 1).otherwise(0) for d in rules.DETECTORS), F.lit(0))


def _gate_count_sql():
    terms = [("1" if d.gate is None else f"CASE WHEN suffix IN ({', '.join(repr(x) for x in d.gate)}) THEN 1 ELSE 0 END")
             for d in rules.DETECTORS]
    return " + ".join(terms)


@register("file_type_gate", lambda: f"WITH {corpus_sql()}\nSELECT bundle_id, path, suffix, "
                                    f"CAST({_gate_count_sql()} AS BIGINT) AS n_detectors FROM scan_text")
def q_file_type_gate(spark, sf):
    return scan_text(spark, sf).select("bundle_id", "path", "suffix",
                                       _gate_count_spark().cast("long").alias("n_detectors"))


def _has_any_sql():
    found = "\n  UNION ALL\n  ".join(OB._found_parts())
    return (f"WITH {OF.entries_sql()},\nfound AS (\n  {found}\n)\n"
            "SELECT e.bundle_id, e.path, e.extracted_from, EXISTS (SELECT 1 FROM found f WHERE f.bundle_id = e.bundle_id "
            f"AND f.path = {OB.ENTRY_PATH_OF_E}) AS has_findings FROM entries e")


@register("has_any_findings", _has_any_sql)
def q_has_any_findings(spark, sf):
    return SCAN.scanned(_entries(spark, sf)).select("bundle_id", "path", "extracted_from", (F.size("_found") > 0).alias("has_findings"))


def _projection_sql():
    return (f"WITH {OB._reports_cte(every=True)}\nSELECT skill_name, scan_date, adjusted_risk_level, risk_level, llm_summary, "
            "CAST(coalesce(len(rf.findings), 0) AS BIGINT) AS n_findings FROM rep LEFT JOIN rf USING (bundle_id)")


@register("column_projection", _projection_sql)
def q_column_projection(spark, sf):
    rep = fixture_reports(spark, sf, SCAN.bundles(ARC.expand_archives(corpus_files(spark, sf))), every=True)
    # only the six report keys leave; fingerprint and bundle_id are internal
    return rep.select("skill_name", "scan_date", "adjusted_risk_level", "risk_level", "llm_summary",
                      F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("n_findings"))


@register("distinct_sorted", lambda: f"WITH {corpus_sql()}\nSELECT bundle_id, path, string_agg(u, chr(10) ORDER BY u) "
                                     f"AS urls FROM (SELECT DISTINCT bundle_id, path, unnest(regexp_extract_all(text, "
                                     f"{sql_str(to_re2(rules.URL))}, 0)) AS u FROM scan_text) GROUP BY ALL")
def q_distinct_sorted(spark, sf):
    t = scan_text(spark, sf)
    u = t.select("bundle_id", "path", IND.extract_set(F.col("text"), rules.URL).alias("u"))
    return keep_if(u, F.size("u") > 0).select("bundle_id", "path", F.array_join("u", "\n").alias("urls"))


def _findings_by_key():
    per_key = [OI.simple_sql(k) for k in OI.SIMPLE] + [
        OI.shell_commands_sql(), OI.sensitive_file_paths_sql(), OI.suspicious_imports_sql(),
        OI.sensitive_env_vars_sql(), OI.base64_sql(), OI.wallets_sql()]
    parts = [f"SELECT bundle_id, path, key, value, CAST(NULL AS BIGINT) AS line FROM ({q})" for q in per_key]
    parts.append(f"SELECT bundle_id, path, 'security_patterns', match, line FROM ({OL.security_patterns_sql()})")
    parts.append(f"SELECT bundle_id, path, 'invisible_unicode', char_code, line FROM ({OL.invisible_unicode_sql()})")
    parts.append(f"SELECT bundle_id, path, 'dns_exfil_patterns', match, line FROM ({OL.dns_exfil_sql()})")
    return "\nUNION ALL\n".join(parts)


def _findings_sql():
    with text_source(OB._entry_text_ctes()):
        return OB.apart(_findings_by_key())


@register("findings", _findings_sql)
def q_findings(spark, sf):
    return SCAN.findings(_entries(spark, sf)).select("bundle_id", "path", "extracted_from", "key", "value", "line")


def _artifact_sql():
    with text_source(OB._entry_text_ctes()):
        found = _findings_by_key()
    keys = ", ".join(sql_str(k) for k in rules.FINDING_KEYS)
    return OB.bundle_report_sql(found, f"""SELECT r.* EXCLUDE (n_findings), c.counts, d.dotfiles, e.path, e.extracted_from, e.size_bytes, e.mime_type, e.sha256, e.md5,
  coalesce(x.n, 0) AS n_findings, coalesce(x.h, md5('')) AS findings_md5
FROM ({OF.with_entries("SELECT * FROM entries")}) e JOIN report r USING (bundle_id)
JOIN (SELECT bundle_id, string_agg(key || '=' || CAST(n AS VARCHAR), ',' ORDER BY list_position([{keys}], key)) AS counts FROM counts GROUP BY ALL) c USING (bundle_id)
LEFT JOIN (SELECT bundle_id, string_agg(name, ',' ORDER BY name) AS dotfiles FROM ({OF.hidden_dotfiles_sql()}) GROUP BY ALL) d USING (bundle_id)
LEFT JOIN (SELECT bundle_id, path, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM (
           SELECT bundle_id, path, key || '|' || value || '|' || coalesce(CAST(line AS VARCHAR), '') AS s FROM found) GROUP BY ALL) x
  ON x.bundle_id = e.bundle_id AND x.path = {OB.ENTRY_PATH_OF_E}""")


@register("write_artifact", _artifact_sql)
def q_write_artifact(spark, sf):
    """The artifact written to the shared folder and read back: a row a file, with all of its bundle's."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/artifact-{uuid.uuid4().hex}"
    SCAN.write_artifact(corpus_files(spark, sf), path)
    out = SCAN.read_artifact(spark, path)
    said = F.transform("_found", lambda x: F.concat_ws("|", x["key"], x["value"], F.coalesce(x["line"].cast("string"), F.lit(""))))
    files = out["files"].select("bundle_id", "path", "extracted_from", "size_bytes", "mime_type", "sha256", "md5", F.size("_found").cast("long").alias("n_findings"),
                                F.md5(F.array_join(F.sort_array(said), "\n")).alias("findings_md5"))
    info, meta = "skill_info.", "skill_info.dependency_metadata."
    count = lambda k: F.concat(F.lit(f"{k}="), F.col("summary.finding_counts")[k].cast("string"))
    whole = out["bundles"].select(
        "bundle_id", F.col("skill_sha256").alias("fingerprint"),
        *[info + c for c in ("total_files", "total_size_bytes", "script_count", "total_lines", "has_skill_md", "has_readme")],
        *[info + "frontmatter." + c for c in ("name", "version", "author", "description")],
        F.col("summary.total_archives_extracted").alias("archives_extracted"), "summary.n_hidden_dotfiles", meta + "has_install_hooks",
        *[F.array_join(meta + c, ",").alias(c) for c in ("package_files_found", "install_hooks_found")],
        F.concat_ws(",", *[count(k) for k in rules.FINDING_KEYS]).alias("counts"))
    names = out["dotfiles"].groupBy("bundle_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("dotfiles"))
    return files.join(whole, "bundle_id").join(names, "bundle_id", "left")


def _expanded_findings_sql():
    exts = "['.py', '.sh', '.js', '.md', '.ps1', '.txt']"
    members = f"""{archive_groups_sql()},
scan_text AS (SELECT bundle_id, 'docs/doc_' || CAST(doc_id AS VARCHAR) || {exts}[doc_id % 6 + 1] AS path, {exts}[doc_id % 6 + 1] AS suffix,
       regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text
  FROM (SELECT d.doc_id, {planted_sql()} AS text, g.* FROM documents d JOIN groups g ON d.doc_id // 25 = g.g) WHERE kind IN (0, 1, 2))"""
    with text_source(members):
        return _findings_by_key()


@register("expanded_findings", lambda: _expanded_findings_sql())
def q_expanded_findings(spark, sf):
    """Findings of the archive fixture, in whatever archive the files lie."""
    return SCAN.run(archive_files(spark, sf))["findings"].select("bundle_id", "path", "key", "value", "line")


@register("has_readme", OF.has_files_sql)
def q_has_readme(spark, sf):
    return q_has_skill_md(spark, sf)


def _members_sql():
    exts = "['.py', '.sh', '.js', '.md', '.ps1', '.txt']"
    return f"""WITH {archive_groups_sql()},
d AS (SELECT d.doc_id, {planted_sql()} AS text, g.* FROM documents d JOIN groups g ON d.doc_id // 25 = g.g)
SELECT bundle_id, 'docs/doc_' || CAST(doc_id AS VARCHAR) || {exts}[doc_id % 6 + 1] AS path,
       CAST(CASE WHEN kind = 1 THEN 2 ELSE 1 END AS BIGINT) AS depth,
       CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(encode(text)) AS sha256
FROM d WHERE kind IN (0, 1, 2)
UNION ALL
SELECT bundle_id, 'README.md', CAST(1 AS BIGINT), CAST(octet_length(encode(r)) AS BIGINT), sha256(encode(r))
FROM (SELECT bundle_id, '# pack ' || CAST(g AS VARCHAR) || chr(10) AS r FROM groups WHERE kind = 1)"""


@register("archive_members", _members_sql)
def q_archive_members(spark, sf):
    """Extracted non-archive members of the archive fixture."""
    e = SRC.entries(_expanded(spark, sf))
    return keep_if(e, F.col("extracted_from").isNotNull() & ~F.col("is_archive")).select(
        "bundle_id", "path", F.col("depth").cast("long").alias("depth"), "size_bytes", "sha256")


# ---------------------------------------------------------------- listings and targets

def _listing_sql():
    return f"""WITH g AS (SELECT doc_id // {FIX.ARCHIVE_GROUP} AS g, count(*) AS n FROM documents GROUP BY ALL),
a AS (SELECT g, g % 7 AS kind, n, 'guard' || CAST(g % 3 AS VARCHAR) AS bundle_id, 'pack_' || CAST(g AS VARCHAR) AS name FROM g)
SELECT bundle_id, name || CASE kind WHEN 5 THEN '.7z' ELSE '.zip' END AS path, CAST(0 AS BIGINT) AS depth,
       CASE WHEN kind = 1 AND 2 * n > {FIX.GUARD_ENTRIES} THEN 'too_many' WHEN kind = 2 THEN 'too_big' WHEN kind = 3 THEN 'escape' WHEN kind = 4 THEN 'corrupt'
            WHEN kind = 5 THEN 'unsupported' ELSE 'ok' END AS status,
       CASE kind WHEN 1 THEN 2 * n WHEN 2 THEN n + 1 WHEN 3 THEN n + 1 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 1 ELSE n END AS n_members FROM a
UNION ALL SELECT bundle_id, 'mid.zip', 1, 'ok', 1 FROM a WHERE kind = 6
UNION ALL SELECT bundle_id, 'low.zip', 2, 'too_deep', 0 FROM a WHERE kind = 6"""


@register("archive_listing", _listing_sql)
def q_archive_listing(spark, sf):
    """Every refusal, from listings alone."""
    limits = ARC.Limits(entries=FIX.GUARD_ENTRIES, total_bytes=FIX.GUARD_BYTES, depth=FIX.GUARD_DEPTH)
    return _long(ARC.listing_status(ARC.archive_listing(FIX.guard_files(spark, sf), limits), limits).drop("declared_bytes"), "depth")


@register("archive_refusals", lambda: f"SELECT bundle_id, path, depth, status FROM ({_listing_sql()})")
def q_archive_refusals(spark, sf):
    """Every refusal, as unpacking finds it."""
    limits = ARC.Limits(entries=FIX.GUARD_ENTRIES, total_bytes=FIX.GUARD_BYTES, depth=FIX.GUARD_DEPTH)
    return _long(ARC.archive_status(FIX.guard_files(spark, sf), limits), "depth")


def _targets_sql():
    with OF.files_source(FIX.uploads_sql()):
        with text_source(OB._entry_text_ctes()):
            found = _findings_by_key()
        return f"""SELECT t.bundle_id, f.fingerprint, t.total_files, t.total_size_bytes, t.script_count, t.total_lines, h.has_skill_md,
  CASE WHEN g % 3 < 2 THEN 'up-' || g ELSE '' END AS name, CASE WHEN g % 3 < 2 THEN '1.' || g ELSE '' END AS version,
  CASE WHEN g % 3 < 2 THEN 'postinstall' ELSE '' END AS install_hooks_found, coalesce(x.n, 0) AS n_findings
FROM (SELECT *, CAST(regexp_extract(bundle_id, '_([0-9]+)', 1) AS INTEGER) AS g FROM ({OF.bundle_totals_sql()})) t
JOIN ({OF.fingerprint_sql()}) f USING (bundle_id) JOIN ({OF.has_files_sql()}) h USING (bundle_id)
LEFT JOIN (SELECT bundle_id, count(*) AS n FROM ({found}) GROUP BY ALL) x USING (bundle_id)"""


@register("zip_targets", _targets_sql)
def q_zip_targets(spark, sf):
    """Zips scanned as bundles of their own: identity, metadata and findings of their content."""
    none = spark.createDataFrame([], "bundle_id string, path string, content binary")
    out = SCAN.run(none, targets=FIX.upload_files(spark, sf))["bundles"]
    return out.select("bundle_id", "fingerprint", "total_files", "total_size_bytes", "script_count", "total_lines", "has_skill_md", "name", "version",
                      F.array_join("install_hooks_found", ",").alias("install_hooks_found"),
                      F.aggregate(F.map_values("finding_counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_findings"))


def _tree_sql():
    return """SELECT source AS bundle_id, 'd' || CAST(doc_id % 10 AS VARCHAR) || '/' || CASE WHEN doc_id % 3 = 0 THEN '.' ELSE '' END || 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
  CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents
UNION ALL SELECT 'all', source || '/_' || CAST(doc_id AS VARCHAR), CAST(octet_length(encode(source)) AS BIGINT), sha256(source) FROM documents"""


@register("tree_inventory", _tree_sql)
def q_tree_inventory(spark, sf):
    """Files of trees that are made from the documents, a root a source and one that holds a file of
    each document; a third of the names are hidden."""
    roots = FIX.document_trees(spark, sf)
    return SRC.entries(tree.read_trees(spark, roots, splits=4)).select("bundle_id", "path", "size_bytes", "sha256")


def _embed_files_sql():
    return f"""WITH {OF.entries_sql()},
documents AS (SELECT bundle_id || chr(1) || path || chr(1) || coalesce(extracted_from, '') AS doc_id, text FROM entries
              WHERE suffix IN ({', '.join(repr(e) for e in rules.EMBED_DIR_EXTENSIONS)}) AND text IS NOT NULL),
v AS ({_embed_sql()})
SELECT split_part(doc_id, chr(1), 1) AS bundle_id, split_part(doc_id, chr(1), 2) AS path, nullif(split_part(doc_id, chr(1), 3), '') AS extracted_from, dim, value FROM v"""


@register("embed_files", _embed_files_sql)
def q_embed_files(spark, sf):
    """A vector for each text file of each bundle."""
    return CH.embed_files(_entries(spark, sf)).withColumn("value", F.round("value", 6))


def _seek_sql():
    return f"""WITH {FIX.uploads_sql()},
n AS (SELECT CAST(regexp_extract(bundle_id, '_([0-9]+)', 1) AS INTEGER) AS g, path, content FROM files
      UNION ALL SELECT g, 'notes.txt', encode('loose') FROM ups WHERE g % 3 = 0)
SELECT 'up' || CAST(g % 5 AS VARCHAR) AS bundle_id, 'upload_' || CAST(g AS VARCHAR) || '.zip' AS parent_path,
  CASE WHEN g % 3 = 0 AND path <> 'notes.txt' THEN 'skill-' || CAST(g AS VARCHAR) || '/' ELSE '' END || path AS path,
  CAST(octet_length(content) AS BIGINT) AS size_bytes, sha256(content) AS sha256 FROM n"""


@register("archive_seek", _seek_sql)
def q_archive_seek(spark, sf):
    """Members of zips on a file system, read by many tasks that seek to them."""
    index = written(ARC.member_index(FIX.upload_paths(spark, sf)), "member-index")
    members = ARC.read_members(index, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return members.select("bundle_id", "parent_path", "path", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
