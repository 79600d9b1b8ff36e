"""DuckDB twins of the per-file set / presence extractors and redaction.

RE2 has no lookaround; the three rules that need one are written with consuming
groups (base64's right guard, the env-assignment follower, the ``.env`` owner test).
"""

from __future__ import annotations

from ..functions import rules
from ..functions.dialect import sql_str, to_re2
from ..sources.corpus import corpus_sql

_W = r"\p{L}\p{N}_"
_S = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
SCRIPT_LIST = ", ".join(sql_str(s) for s in rules.SCRIPT_EXTENSIONS)


def _files() -> str:
    return (f"WITH {corpus_sql()},\ntfiles AS (SELECT bundle_id, path, suffix, text, "
            f"coalesce(suffix IN ({SCRIPT_LIST}), false) AS is_script FROM scan_text WHERE text IS NOT NULL)")


def _key(key: str) -> str:
    if key in rules.ROUTED_KEYS:
        return f"CASE WHEN is_script THEN {sql_str(key)} ELSE {sql_str(key + '_in_docs')} END"
    return sql_str(key)


def _extract(key: str, pat: str, group: int = 0) -> str:
    return (f"SELECT DISTINCT bundle_id, path, key, value FROM (SELECT bundle_id, path, {_key(key)} AS key, "
            f"unnest(regexp_extract_all(text, {sql_str(pat)}, {group})) AS value FROM tfiles)")


SIMPLE = {
    "urls": (rules.URL, False),
    "data_uris": (rules.DATA_URI, False),
    "javascript_uris": (rules.JAVASCRIPT_URI, True),
    "ips": (rules.IPV4, False),
    "encoded_urls": (rules.ENCODED_URL, False),
    "emails": (rules.EMAIL, False),
    "env_var_references": (rules.ENV_VAR, False),
    "private_ips": (rules.PRIVATE_IP, False),
    "paste_service_urls": (rules.PASTE_SERVICE, True),
}


def simple_sql(key: str) -> str:
    pat, ic = SIMPLE[key]
    return f"{_files()}\n{_extract(key, to_re2(pat, ic))}"


def shell_commands_sql() -> str:
    branches = "\nUNION ALL\n".join(
        f"SELECT bundle_id, path, {_key('shell_commands')} AS key, {sql_str(name)} AS value FROM tfiles "
        f"WHERE regexp_matches(lower(text), {sql_str(to_re2(p))})" for p, name in rules.SHELL_COMMANDS)
    return f"{_files()}\n{branches}"


def _path_re2(sp: str) -> str:
    import re
    lit = re.escape(sp)
    pre = "" if sp[0] in "/~." else f"(?:^|[^{_W}])"
    suf = "" if sp.endswith("/") else f"(?:[^{_W}]|$)"
    return to_re2(pre + lit + suf)


def sensitive_file_paths_sql() -> str:
    owners = "|".join(rules.ENV_MEMBER_OWNERS)
    branches = []
    for sp in rules.SENSITIVE_PATHS:
        if sp == ".env":
            cond = (f"len(list_filter(regexp_extract_all(text, '(?s).{{0,10}}\\.env(?:\\.example)?[{_W}]?', 0), "
                    f"lambda x: NOT regexp_matches(x, '(?:{owners})\\.env') AND NOT regexp_matches(x, '\\.env\\.example') "
                    f"AND NOT regexp_matches(x, '\\.env[{_W}]$'))) > 0")
        else:
            cond = f"regexp_matches(text, {sql_str(_path_re2(sp))})"
        branches.append(f"SELECT bundle_id, path, {_key('sensitive_file_paths')} AS key, {sql_str(sp)} AS value "
                        f"FROM tfiles WHERE {cond}")
    return f"{_files()}\n" + "\nUNION ALL\n".join(branches)


def suspicious_imports_sql() -> str:
    branches = "\nUNION ALL\n".join(
        f"SELECT bundle_id, path, {_key('suspicious_imports')} AS key, "
        f"unnest(regexp_extract_all(text, {sql_str(to_re2(p, ic))}, 0)) AS value FROM tfiles"
        for p, ic in rules.SUSPICIOUS_IMPORTS)
    return f"{_files()}\nSELECT DISTINCT * FROM (\n{branches}\n)"


def _env_occ() -> str:
    names = "|".join(rules.SENSITIVE_ENV_NAMES)
    follow = f"(?:[\"'][{_S}]*\\])?[{_S}]*=(?:[^=]|$)"
    return (f"env_occ AS (SELECT bundle_id, path, is_script, regexp_extract(m, '^[A-Z_]+', 0) AS name, "
            f"m != regexp_extract(m, '^[A-Z_]+', 0) AS assign FROM (SELECT bundle_id, path, is_script, "
            f"unnest(regexp_extract_all(text, {sql_str(r'\b(?:' + names + r')\b(?:' + follow + ')?')}, 0)) AS m "
            f"FROM tfiles)),\nenv_file AS (SELECT bundle_id, path, is_script, "
            f"list_distinct(list(name) FILTER (WHERE NOT assign)) AS reads, "
            f"list_distinct(list(name) FILTER (WHERE assign)) AS assigns FROM env_occ GROUP BY ALL)")


def sensitive_env_vars_sql() -> str:
    return f"""{_files()},
{_env_occ()}
SELECT bundle_id, path, 'sensitive_env_var_names' AS key, unnest(reads) AS value FROM env_file WHERE is_script
UNION ALL
SELECT bundle_id, path, 'sensitive_env_var_assignments', unnest(list_filter(assigns, lambda a: NOT list_contains(reads, a)))
FROM env_file WHERE is_script
UNION ALL
SELECT DISTINCT bundle_id, path, 'sensitive_env_var_names_in_docs', unnest(list_concat(reads, assigns))
FROM env_file WHERE NOT is_script"""


def redact_sql(col: str) -> str:
    for p, label, ic in rules.SECRET_SHAPES:
        col = f"regexp_replace({col}, {sql_str(to_re2(p, ic))}, {sql_str(f'[REDACTED:{label}]')}, 'g')"
    return col


_NONPRINT_RE2 = (r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{202F}\x{205F}\x{3000}]")


def base64_sql() -> str:
    cand = r"\b([A-Za-z0-9+/]{20,}={0,2})(?:[^A-Za-z0-9+/=]|$)"
    return f"""{_files()},
cands AS (SELECT DISTINCT bundle_id, path, unnest(regexp_extract_all(text, {sql_str(cand)}, 1)) AS encoded FROM tfiles),
dec AS (SELECT bundle_id, path, encoded,
               CASE WHEN length(encoded) % 4 = 0 THEN TRY(decode(from_base64(encoded))) END AS s FROM cands)
SELECT bundle_id, path, 'base64_strings' AS key, encoded AS value, {redact_sql('s')} AS decoded
FROM dec WHERE s IS NOT NULL AND (NOT regexp_matches(s, {sql_str(_NONPRINT_RE2)}) OR contains(s, chr(10)))"""


def secret_hits_sql() -> str:
    branches = "\nUNION ALL\n".join(
        f"SELECT bundle_id, path, {sql_str(label)} AS label, "
        f"CAST(len(regexp_extract_all(text, {sql_str(to_re2(p, ic))}, 0)) AS BIGINT) AS n FROM tfiles"
        for p, label, ic in rules.SECRET_SHAPES)
    return f"{_files()}\nSELECT * FROM (\n{branches}\n) WHERE n > 0"


def redact_secrets_sql() -> str:
    return (f"{_files()}\nSELECT bundle_id, path, md5(r) AS redacted_md5, "
            f"CAST(length(r) AS BIGINT) AS redacted_chars FROM "
            f"(SELECT bundle_id, path, text, {redact_sql('text')} AS r FROM tfiles) WHERE r != text")


def wallets_sql() -> str:
    eth = to_re2(rules.ETH_WALLET)
    return (f"{_files()}\nSELECT DISTINCT bundle_id, path, 'crypto_wallets' AS key, value FROM ("
            f"SELECT bundle_id, path, unnest(regexp_extract_all(text, {sql_str(eth)}, 0)) AS value FROM tfiles "
            f"UNION ALL SELECT bundle_id, path, unnest(list_filter(regexp_extract_all(text, "
            f"{sql_str(to_re2(rules.BTC_WALLET))}, 0), lambda a: starts_with(a, 'bc1') OR {base58check_duck('a')})) FROM tfiles)")


def base58check_duck(c: str) -> str:
    """DuckDB boolean twin of ``indicators.base58check_sql``."""
    alpha = rules.BASE58_ALPHABET
    digits = f"list_transform(range(1, length({c}) + 1), lambda i: instr('{alpha}', substring({c}, i, 1)) - 1)"
    limbs = (f"list_reduce({digits}, lambda acc, d: list_reduce(list_reverse(acc), "
             f"lambda st, l: {{'o': list_prepend(CAST((l * 58 + st.c) % 256 AS INTEGER), st.o), "
             f"'c': CAST((l * 58 + st.c) // 256 AS INTEGER)}}, {{'o': []::INTEGER[], 'c': d}}).o, "
             f"list_value(0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0))")
    hexs = f"list_aggregate(list_transform(L[2:26], lambda x: lpad(printf('%02x', x), 2, '0')), 'string_agg', '')"
    return (f"list_reduce([{limbs}], lambda z, L: L[1] = 0 AND "
            f"coalesce(list_position(list_transform(L[2:26], lambda x: x != 0), true) - 1, 25) = "
            f"length(regexp_extract({c}, '^1*', 0)) AND "
            f"left(sha256(unhex(sha256(unhex(left({hexs}, 42))))), 8) = right({hexs}, 8), false)")
