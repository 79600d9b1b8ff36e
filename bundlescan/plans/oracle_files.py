"""DuckDB twins of the file layer (entries) and the bundle roll-ups."""

from __future__ import annotations

from ..functions import rules
from ..functions.dialect import sql_str, to_re2
from ..sources.files import ENCODINGS, SUFFIX_MAP, TYPES_MAP
from ..sources.fixtures import files_sql


def _in(xs) -> str:
    return "(" + ", ".join(sql_str(x) for x in xs) + ")"


_EXT = r"^\.*[^.].*(\.[^.]*)$"


_FILES: list[str] = []


class files_source:
    """Context manager: the twins read ``files`` and ``members`` from another CTE chain."""

    def __init__(self, ctes: str):
        self.ctes = ctes

    def __enter__(self):
        _FILES.append(self.ctes)

    def __exit__(self, *exc):
        _FILES.pop()


def entries_sql() -> str:
    """CTEs up to ``entries`` (same columns as ``sources.files.entries``)."""
    mimes = ", ".join(f"({sql_str(k)}, {sql_str(v)})" for k, v in TYPES_MAP.items())
    alias = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in SUFFIX_MAP.items())
    lower_enc = [e for e in ENCODINGS if e == e.lower()]
    arch = " OR ".join(f"lower(name) LIKE {sql_str('%' + e)}" for e in rules.ARCHIVE_EXTENSIONS)
    return f"""{_FILES[-1] if _FILES else files_sql()},
mimes(ext, mt) AS (VALUES {mimes}),
f0 AS (SELECT *, regexp_extract(path, '[^/]*$', 0) AS name FROM (
       SELECT bundle_id, path, content, CAST(NULL AS VARCHAR) AS extracted_from, 0 AS depth FROM files
       UNION ALL SELECT bundle_id, path, content, extracted_from, depth FROM members)),
f1 AS (SELECT *, regexp_extract(name, {sql_str(_EXT)}, 1) AS e0 FROM f0),
f2 AS (SELECT *, CASE WHEN (CASE lower(e0) {alias} END) IS NOT NULL
                      THEN left(name, length(name) - length(e0)) || (CASE lower(e0) {alias} END) ELSE name END AS n1 FROM f1),
f3 AS (SELECT *, regexp_extract(n1, {sql_str(_EXT)}, 1) AS e1 FROM f2),
f4 AS (SELECT *, CASE WHEN e1 IN {_in(ENCODINGS)} OR lower(e1) IN {_in(lower_enc)}
                      THEN left(n1, length(n1) - length(e1)) ELSE n1 END AS n2 FROM f3),
f5 AS (SELECT *, regexp_extract(n2, {sql_str(_EXT)}, 1) AS e2 FROM f4),
f6 AS (SELECT f5.*, coalesce(m1.mt, m2.mt, 'application/octet-stream') AS mime_type
       FROM f5 LEFT JOIN mimes m1 ON m1.ext = f5.e2 LEFT JOIN mimes m2 ON m2.ext = lower(f5.e2)),
f7 AS (SELECT bundle_id, path, content, CAST(octet_length(content) AS BIGINT) AS size_bytes, mime_type,
              sha256(content) AS sha256, md5(content) AS md5, ({arch}) AS is_archive,
              extracted_from, depth, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS suffix FROM f6),
entries AS (
  SELECT * EXCLUDE (content), suffix IN {_in(rules.SCRIPT_EXTENSIONS)} AS is_script,
         CAST(CASE WHEN coalesce(length(text), 0) > 0 THEN len(string_split(text, chr(10))) ELSE 0 END AS BIGINT) AS line_count
  FROM (SELECT *, CASE WHEN (starts_with(mime_type, 'text/') OR mime_type IN {_in(rules.TEXT_MIME_TYPES)}
                             OR suffix IN {_in(rules.TEXT_EXTENSIONS)})
                       THEN regexp_replace(decode(content), '\\r\\n?', chr(10), 'g') END AS text FROM f7)
)"""


def with_entries(select: str) -> str:
    return f"WITH {entries_sql()}\n{select}"


def inventory_sql() -> str:
    return with_entries("SELECT bundle_id, path, size_bytes, mime_type, sha256, md5, is_archive, extracted_from, "
                        "CAST(depth AS BIGINT) AS depth FROM entries")


def is_text_sql() -> str:
    return with_entries(
        f"SELECT bundle_id, path, (starts_with(mime_type, 'text/') OR mime_type IN {_in(rules.TEXT_MIME_TYPES)} "
        f"OR suffix IN {_in(rules.TEXT_EXTENSIONS)}) AS is_text FROM entries")


def archive_kind_sql() -> str:
    cases = " ".join(f"WHEN lower(name) LIKE {sql_str('%' + e)} THEN {sql_str(e)}"
                     for e in sorted(rules.ARCHIVE_EXTENSIONS, key=len, reverse=True))
    return with_entries(f"SELECT bundle_id, path, CASE {cases} ELSE '' END AS archive_extension, is_archive "
                        f"FROM (SELECT *, regexp_extract(path, '[^/]*$', 0) AS name FROM entries)")


# ------------------------------------------------------------------ bundles

def _base(col: str = "path") -> str:
    return f"regexp_extract({col}, '[^/]*$', 0)"


def bundle_totals_sql() -> str:
    return with_entries("""SELECT bundle_id, CAST(count(*) AS BIGINT) AS total_files,
  CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, CAST(count(*) FILTER (WHERE is_script) AS BIGINT) AS script_count,
  CAST(sum(line_count) AS BIGINT) AS total_lines,
  CAST(count(*) FILTER (WHERE extracted_from IS NOT NULL) AS BIGINT) AS archives_extracted
FROM entries GROUP BY bundle_id""")


def hidden_dotfiles_sql() -> str:
    return with_entries(f"SELECT DISTINCT bundle_id, {_base()} AS name FROM entries "
                        f"WHERE starts_with({_base()}, '.') AND {_base()} NOT IN {_in(rules.ALLOWED_DOTFILES)}")


def package_files_sql() -> str:
    return with_entries(f"SELECT DISTINCT bundle_id, {_base()} AS name FROM entries "
                        f"WHERE {_base()} IN {_in(rules.PACKAGE_FILES)}")


def has_files_sql() -> str:
    return with_entries(
        "SELECT bundle_id, coalesce(bool_or(extracted_from IS NULL AND path = 'SKILL.md'), false) AS has_skill_md, "
        f"coalesce(bool_or(extracted_from IS NULL AND path IN {_in(rules.README_NAMES)}), false) AS has_readme "
        "FROM entries GROUP BY bundle_id")


def _meta_cte() -> str:
    return ("meta AS (SELECT bundle_id, path, regexp_replace(decode(content), '\\r\\n?', chr(10), 'g') AS t FROM files "
            f"WHERE path IN {_in(['SKILL.md', 'package.json', 'setup.py'])})")


def frontmatter_sql() -> str:
    """The values that the planted files stand for, said outright."""
    return f"""WITH {entries_sql()}
SELECT bundle_id, 'skill-' || n AS name, '1.' || n AS version, CASE WHEN n % 4 = 0 THEN 'team ' || n ELSE '' END AS author,
       CASE WHEN n % 4 = 0 THEN 'scans' ELSE 'scans every file' || chr(10) || 'again' END AS description
FROM bundles WHERE n % 2 = 0"""


def install_hooks_sql() -> str:
    """The hooks that the planted files stand for, said outright."""
    return """WITH b AS (SELECT 'src' || i AS bundle_id, i AS n FROM (SELECT DISTINCT CAST(regexp_extract(source, '[0-9]+', 0) AS INTEGER) AS i FROM documents)
           UNION ALL SELECT 'kit' || CAST(doc_id AS VARCHAR), doc_id FROM documents),
h AS (SELECT bundle_id, list_concat(CASE WHEN n % 3 = 0 THEN ['postinstall', 'prepare'] WHEN n % 6 = 1 THEN ['postinstall'] ELSE [] END,
             CASE WHEN n % 5 = 0 THEN ['cmdclass'] ELSE [] END) AS hooks FROM b)
SELECT bundle_id, CAST(generate_subscripts(hooks, 1) AS BIGINT) AS pos, unnest(hooks) AS hook FROM h"""


def fingerprint_sql() -> str:
    return with_entries(f"""SELECT bundle_id, sha256(CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || ':' || coalesce(string_agg(b, '' ORDER BY b), '')) AS fingerprint
FROM (SELECT bundle_id, bucket, count(h) AS n, sha256(string_agg(h, '' ORDER BY h)) AS b
      FROM (SELECT bundle_id, h, left(h, 4) AS bucket FROM (
            SELECT bundle_id, CASE WHEN extracted_from IS NULL AND NOT regexp_matches(path, '(^|/)__pycache__(/|$)')
                     AND regexp_extract({_base()}, '^.+(\\.[^.]+)$', 1) != '.pyc'
                   THEN sha256(path || chr(0) || sha256) END AS h FROM entries)) GROUP BY bundle_id, bucket)
GROUP BY bundle_id""")
