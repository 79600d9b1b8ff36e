"""DuckDB twins of the composed bundle queries: findings, finding counts, bundle report,
cache lookup and report rendering. They reuse the per-key oracles with ``scan_text``
rebound to the text of ``entries`` (see ``corpus.text_source``)."""

from __future__ import annotations

from ..functions import rules
from ..functions.dialect import sql_str
from ..operators import report as R
from ..sources.corpus import text_source
from . import oracle_files as OF
from . import oracle_indicators as OI
from . import oracle_lines as OL

# the path of a member carries the hash of its archive, for equal paths in several archives of a bundle
ENTRY_PATH = "coalesce(extracted_from || '!', '') || path"
ENTRY_PATH_OF_E = "coalesce(e.extracted_from || '!', '') || e.path"
ENTRY_TEXT = f"scan_text AS (SELECT bundle_id, {ENTRY_PATH} AS path, suffix, text FROM entries WHERE text IS NOT NULL)"


def apart(select: str) -> str:
    """A select's rows with the path and the hash of the archive as columns of their own."""
    return (f"SELECT * REPLACE (regexp_replace(path, '^[0-9a-f]*!', '') AS path), nullif(regexp_extract(path, '^([0-9a-f]*)!', 1), '') AS extracted_from FROM ({select})")


def _entry_text_ctes() -> str:
    return f"{OF.entries_sql()},\n{ENTRY_TEXT}"


def _found_parts() -> list[str]:
    """(bundle_id, path, key) rows of every key over the entries text."""
    with text_source(_entry_text_ctes()):
        per_key = [OI.simple_sql(k) for k in OI.SIMPLE] + [
            OI.shell_commands_sql(), OI.sensitive_file_paths_sql(), OI.suspicious_imports_sql(),
            OI.sensitive_env_vars_sql(), OI.base64_sql(), OI.wallets_sql()]
        parts = [f"SELECT bundle_id, path, key FROM ({q})" for q in per_key]
        parts.append(f"SELECT bundle_id, path, 'security_patterns' AS key FROM ({OL.security_patterns_sql()})")
        parts.append(f"SELECT bundle_id, path, 'invisible_unicode' AS key FROM ({OL.invisible_unicode_sql()})")
        parts.append(f"SELECT bundle_id, path, 'dns_exfil_patterns' AS key FROM ({OL.dns_exfil_sql()})")
    return parts


def _counts_cte(found: str | None = None) -> str:
    keys = ", ".join(f"({sql_str(k)})" for k in rules.FINDING_KEYS)
    found = found or "\n  UNION ALL\n  ".join(_found_parts())
    return f"""found AS MATERIALIZED (
  {found}
),
all_bundles AS (SELECT DISTINCT bundle_id FROM ({OF.with_entries('SELECT bundle_id FROM entries')})),
all_keys(key) AS (VALUES {keys}),
per AS (SELECT bundle_id, key, count(*) AS n FROM found GROUP BY ALL),
counts AS (SELECT b.bundle_id, k.key, CAST(coalesce(p.n, 0) AS BIGINT) AS n
           FROM all_bundles b CROSS JOIN all_keys k LEFT JOIN per p ON p.bundle_id = b.bundle_id AND p.key = k.key)"""


def finding_counts_sql() -> str:
    return f"WITH {_counts_cte()}\nSELECT bundle_id, key, n FROM counts"


def bundle_report_sql(found: str | None = None, then: str = "SELECT * FROM report") -> str:
    return f"""WITH {_counts_cte(found)},
tot AS ({OF.bundle_totals_sql()}),
fp AS ({OF.fingerprint_sql()}),
hf AS ({OF.has_files_sql()}),
fm AS ({OF.frontmatter_sql()}),
hk AS (SELECT bundle_id, string_agg(hook, ',' ORDER BY pos) AS hooks FROM ({OF.install_hooks_sql()}) GROUP BY ALL),
dot AS (SELECT bundle_id, count(*) AS n_hidden FROM ({OF.hidden_dotfiles_sql()}) GROUP BY ALL),
pkg AS (SELECT bundle_id, string_agg(name, ',' ORDER BY name) AS names FROM ({OF.package_files_sql()}) GROUP BY ALL),
cnt AS (SELECT bundle_id, CAST(sum(n) AS BIGINT) AS n_findings FROM counts GROUP BY ALL),
report AS (SELECT tot.bundle_id, fp.fingerprint, tot.total_files, tot.total_size_bytes, tot.script_count, tot.total_lines,
       tot.archives_extracted, cnt.n_findings, CAST(coalesce(dot.n_hidden, 0) AS BIGINT) AS n_hidden_dotfiles,
       coalesce(pkg.names, '') AS package_files_found, hk.hooks IS NOT NULL AS has_install_hooks,
       coalesce(hk.hooks, '') AS install_hooks_found, hf.has_skill_md, hf.has_readme,
       coalesce(fm.name, '') AS name, coalesce(fm.version, '') AS version, coalesce(fm.author, '') AS author,
       coalesce(fm.description, '') AS description
FROM tot JOIN fp USING (bundle_id) JOIN hf USING (bundle_id) JOIN cnt USING (bundle_id)
LEFT JOIN fm USING (bundle_id) LEFT JOIN hk USING (bundle_id) LEFT JOIN dot USING (bundle_id)
LEFT JOIN pkg USING (bundle_id))
{then}"""


def _reports_cte(every: bool = False) -> str:
    with text_source(_entry_text_ctes()):
        sec = OL.security_patterns_sql()
    return f"""fp AS ({OF.fingerprint_sql()}),
rf AS (SELECT bundle_id, list_sort(list({{'description': 'Detected ' || category, 'file': file}})) AS findings
       FROM (SELECT bundle_id, category, min(path) AS file FROM ({apart(sec)}) GROUP BY ALL) GROUP BY ALL),
rep AS (
  SELECT fingerprint, bundle_id,
         CASE WHEN n % 6 = 0 THEN fingerprint ELSE 'bundle-' || CAST(n AS VARCHAR) END AS skill_name,
         '2026-01-' || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') AS scan_date,
         CASE WHEN n % 8 = 0 THEN 'MEDIUM' END AS adjusted_risk_level,
         CASE WHEN n % 4 = 0 THEN 'HIGH' ELSE 'CLEAN' END AS risk_level,
         CASE WHEN n % 4 = 0 THEN 'Bundle ' || CAST(n AS VARCHAR) || ' runs remote code.' END AS llm_summary,
         CASE WHEN n % 3 = 0 THEN 'metadata' ELSE 'full' END AS source
  FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(bundle_id, '[0-9]+', 0) AS INTEGER), 0) AS n FROM fp
        {"" if every else "WHERE regexp_matches(bundle_id, '^(src|kit)[0-9]+$')"})
  {"" if every else "WHERE n % 2 = 0"}
)"""


def cache_lookup_sql() -> str:
    return f"""WITH {_reports_cte()}
SELECT fp.bundle_id, fp.fingerprint, CASE WHEN rep.fingerprint IS NULL THEN 'miss' ELSE 'hit' END AS status,
       rep.skill_name, rep.risk_level
FROM fp LEFT JOIN rep ON rep.fingerprint = fp.fingerprint"""


def render_report_sql() -> str:
    items = ("list_transform(findings, lambda f, i: CAST(i AS VARCHAR) || '. **' || "
             "coalesce(f.description, 'No description') || '** — `' || coalesce(f.file, '?') || '`')")
    return f"""WITH {_reports_cte(every=True)},
fm AS ({OF.frontmatter_sql()}),
r AS (SELECT rep.*, rf.findings, fm.name AS local_name FROM rep
      LEFT JOIN rf USING (bundle_id) LEFT JOIN fm USING (bundle_id)),
s AS (SELECT *, coalesce(nullif(adjusted_risk_level, ''), risk_level, 'UNKNOWN') AS severity,
             coalesce(len(findings), 0) > 0 AS has_f FROM r)
SELECT bundle_id, concat_ws(chr(10),
    '{R.TITLE}' || coalesce(nullif(local_name, ''), nullif(skill_name, ''), 'Unknown'), '',
    '- **Severity:** ' || severity,
    CASE WHEN scan_date IS NOT NULL THEN '- **Scan Date:** ' || scan_date END,
    '',
    CASE WHEN coalesce(llm_summary, '') != '' THEN '## Summary' || chr(10) || chr(10) || llm_summary || chr(10) END,
    CASE WHEN has_f THEN '## Findings (' || CAST(len(findings) AS VARCHAR) || ')' || chr(10) || chr(10)
                         || array_to_string({items}, chr(10))
         WHEN severity = 'CLEAN' THEN {sql_str(R.CLEAN_TEXT)} ELSE {sql_str(R.EMPTY_TEXT)} END,
    '',
    CASE WHEN source = 'metadata' THEN {sql_str(R.METADATA_NOTICE)} || chr(10) END) AS markdown
FROM s"""
