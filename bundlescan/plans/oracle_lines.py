"""DuckDB twins of the line-grain detectors (RE2 dialect, see ``dialect.to_re2``)."""

from __future__ import annotations

from ..functions import rules
from ..functions.dialect import sql_str, to_re2
from ..sources.corpus import corpus_sql

LINES_CTE = """lines AS (
  SELECT bundle_id, path, suffix, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no, unnest(parts) AS line
  FROM (SELECT bundle_id, path, suffix, string_split(text, chr(10)) AS parts FROM scan_text WHERE text IS NOT NULL)
)"""


def _detector_branch(d: rules.Detector) -> str:
    pat, grp = rules.RE2_DETECTOR_OVERRIDES.get(d.name, (to_re2(d.pattern), 0))
    if d.ignore_case:
        pat = "(?i)" + pat
    gate = "" if d.gate is None else f" AND suffix IN ({', '.join(sql_str(s) for s in d.gate)})"
    return (f"SELECT bundle_id, path, line_no AS line, {sql_str(d.category)} AS category, "
            f"{sql_str(d.name)} AS pattern_name, {sql_str(d.description)} AS description, "
            f"regexp_extract(line, {sql_str(pat)}, {grp}) AS match "
            f"FROM lines WHERE regexp_matches(line, {sql_str(pat)}){gate}")


def hits_sql(detectors) -> str:
    body = "\nUNION ALL\n".join(_detector_branch(d) for d in detectors)
    return f"WITH {corpus_sql()},\n{LINES_CTE}\n{body}"


def security_patterns_sql() -> str:
    return hits_sql(rules.DETECTORS)


def category_sql(category: str) -> str:
    return hits_sql([d for d in rules.DETECTORS if d.category == category])


def category_counts_sql() -> str:
    body = "\nUNION ALL\n".join(_detector_branch(d) for d in rules.DETECTORS)
    return (f"WITH {corpus_sql()},\n{LINES_CTE},\nhits AS (\n{body}\n)\n"
            "SELECT bundle_id, category, pattern_name, CAST(count(*) AS BIGINT) AS n_hits, "
            "CAST(count(DISTINCT path) AS BIGINT) AS n_files FROM hits GROUP BY bundle_id, category, pattern_name")


def invisible_unicode_sql() -> str:
    pat = to_re2(rules.INVISIBLE_UNICODE)
    return f"""WITH {corpus_sql()},
{LINES_CTE},
chars AS (
  SELECT bundle_id, path, line_no, CAST(generate_subscripts(cs, 1) - 1 AS BIGINT) AS position, unnest(cs) AS ch
  FROM (SELECT bundle_id, path, line_no, string_split(line, '') AS cs FROM lines
        WHERE regexp_matches(line, {sql_str(pat)}))
)
SELECT bundle_id, path, line_no AS line, printf('U+%04X', unicode(ch)) AS char_code, position
FROM chars WHERE regexp_matches(ch, {sql_str(pat)})"""


def dns_exfil_sql() -> str:
    pat = to_re2(rules.DNS_EXFIL, ignore_case=True)
    return f"""WITH {corpus_sql()},
{LINES_CTE}
SELECT bundle_id, path, line_no AS line, regexp_extract(line, {sql_str(pat)}, 0) AS match
FROM lines WHERE regexp_matches(line, {sql_str(pat)})"""
