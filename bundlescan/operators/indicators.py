"""Per-file indicator extractors (set grain and presence grain) and secret redaction.

Each extractor is one JVM expression over the whole text: ``regexp_extract_all`` ->
``array_distinct`` -> ``sort_array`` (byte order of UTF-8 = code-point order, as
Python's ``sorted``). :func:`file_indicators` evaluates all of them in a single
projection and :func:`indicator_rows` explodes them into the long ``findings`` shape
with one generator, so the text is read once and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prefilter, rules
from ..functions.dialect import to_java
from ..functions.linear import form
from ..functions.prefilter import any_held, any_of, folded, lowered, may_match
from ..functions.prefilter import gated as _gated

KEEP = ["bundle_id", "path"]


def _j(p: str, ic: bool = False) -> Column:
    return F.lit(to_java(p, ic))


def _empty() -> Column:
    return F.array().cast("array<string>")


def extract_set(text: Column, pattern: str, ignore_case: bool = False, fold: Column | None = None, held: Column | None = None) -> Column:
    """Sorted distinct matches; the regex runs only on texts holding a required literal."""
    search = form(pattern, ignore_case)
    found = F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(search.java), F.lit(search.match))))
    gate = may_match(text, fold, pattern, ignore_case, held)
    if pattern in rules.ROUGH:
        gate = gate & _rough(text, pattern, held)
    return _gated(text, gate, found, _empty())


def _rough(text: Column, pattern: str, held: Column | None) -> Column:
    """Whether a text holds what every match of a rule in rules.ROUGH does."""
    there = text.rlike(to_java(rules.ROUGH[pattern]))
    taken = prefilter.ROUGH_HELD.get(pattern)
    return there if held is None or taken is None else held.rlike(taken) & there


def is_script(suffix: Column) -> Column:
    return F.coalesce(suffix.isin(*rules.SCRIPT_EXTENSIONS), F.lit(False))


# ------------------------------------------------------------------ redaction (§2.9)

def redact(col: Column) -> Column:
    """Nine secret shapes, in order, each replaced by ``[REDACTED:<label>]``. A shape's pattern runs only
    on texts that hold one of its literals; a lambda over an array of one binds the text of the step
    before, which is named three times, so that the expression does not grow with each step."""
    for pattern, label, ic in rules.SECRET_SHAPES:
        search = form(pattern, ic)
        col = _redacted(col, pattern, ic, search.java, search.replacement(label))
    return col


def _redacted(col: Column, pattern: str, ignore_case: bool, java: str, replacement: str) -> Column:
    def step(text: Column) -> Column:
        return F.when(may_match(text, None, pattern, ignore_case), F.regexp_replace(text, java, replacement)).otherwise(text)

    return F.transform(F.array(col), step)[0]


def secret_counts(text: Column) -> Column:
    """map label -> number of matches of that shape in the (unredacted) text."""
    return F.array(*[F.struct(F.lit(label).alias("label"),
                              F.when(may_match(text, None, p, ic), F.regexp_count(text, F.lit(form(p, ic).java)))
                              .otherwise(F.when(text.isNotNull(), 0)).cast("long").alias("n"))
                     for p, label, ic in rules.SECRET_SHAPES])


# ------------------------------------------------------------------ base64 (§2.6)

_NONPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def base64_entries(text: Column, held: Column | None = None) -> Column:
    """array<struct<encoded, decoded>>: strict decode, < 15 % U+FFFD, printable or
    multi-line; the whole decoded text, redacted."""
    cands = extract_set(text, rules.BASE64, held=held)

    def decode(c):
        s = F.make_valid_utf8(F.try_to_binary(c, F.lit("base64")).cast("string"))
        return F.struct(c.alias("encoded"), s.alias("_s"))

    def keep(e):
        s = e["_s"]
        n_bad = F.length(s) - F.length(F.replace(s, F.lit("\ufffd"), F.lit("")))
        return ((F.length(e["encoded"]) % 4 == 0) & s.isNotNull()
                & (n_bad / F.greatest(F.length(s), F.lit(1)) < 0.15)
                & (~s.rlike(_NONPRINTABLE) | (F.instr(s, "\n") > 0)))

    return F.transform(F.filter(F.transform(cands, decode), keep),
                       lambda e: F.struct(e["encoded"].alias("encoded"),
                                          redact(e["_s"]).alias("decoded")))


# ------------------------------------------------------------------ wallets (§2.6)

def base58check_sql(c: str) -> str:
    """Spark SQL boolean: ``c`` is a Base58Check string of exactly 25 bytes whose last 4
    bytes equal the first 4 of SHA-256(SHA-256(first 21)). The number is held as 8 limbs of 32
    bits, the lowest first, and built from five characters at a time: 58^5 times a limb and
    the carry fit in 64 bits. As hex, its 25 bytes are the last 50 of 64 digits."""
    alpha = rules.BASE58_ALPHABET
    chunks = (f"transform(sequence(1, length({c}), 5), i -> substring({c}, i, 5))")
    values = (f"transform({chunks}, p -> named_struct('v', aggregate(sequence(1, length(p)), 0L, "
              f"(a, j) -> a * 58L + instr('{alpha}', substring(p, j, 1)) - 1L), 'm', cast(pow(58, length(p)) as bigint)))")
    step = ("(limbs, e) -> aggregate(limbs, named_struct('o', cast(array() as array<bigint>), 'c', e.v), "
            "(acc, l) -> named_struct('o', concat(acc.o, array((l * e.m + acc.c) & 4294967295L)), "
            "'c', shiftrightunsigned(l * e.m + acc.c, 32))).o")
    limbs = f"aggregate({values}, array_repeat(0L, 8), {step})"
    number = f"concat_ws('', transform(reverse({limbs}), x -> lpad(hex(x), 8, '0')))"
    return (f"(aggregate(array({number}), false, (z, h) -> "
            f"left(h, 14) = '00000000000000' "
            f"AND length(regexp_extract(right(h, 50), '^(00)*', 0)) = 2 * length(regexp_extract({c}, '^1*', 0)) "
            f"AND left(sha2(unhex(sha2(unhex(left(right(h, 50), 42)), 256)), 256), 8) = lower(right(h, 8))))")


def crypto_wallets(text: Column, btc_col: str = "_btc", held: Column | None = None) -> Column:
    """eth addresses + bc1 addresses + legacy addresses passing Base58Check. ``btc_col``
    names a column holding :func:`btc_candidates` (SQL lambdas need a named input)."""
    eth = extract_set(text, rules.ETH_WALLET, held=held)
    btc_ok = F.expr(f"filter({btc_col}, a -> startswith(a, 'bc1') OR {base58check_sql('a')})")
    return F.sort_array(F.array_union(F.array_distinct(eth), btc_ok))


def btc_candidates(text: Column, held: Column | None = None) -> Column:
    found = F.sort_array(F.array_distinct(F.regexp_extract_all(text, _j(rules.BTC_WALLET), F.lit(0))))
    bech = text.contains(prefilter.BECH32) if held is None else any_held(held, [prefilter.BECH32])
    return _gated(text, bech | _rough(text, rules.BTC_WALLET, held), found, _empty())


# ------------------------------------------------------------------ presence (§2.7)

def shell_commands(text: Column, low: Column | None = None, held: Column | None = None) -> Column:
    """Rule names found in the lower-cased text (``low``: a column holding ``lower(text)``);
    each rule's regex runs only when its required literal occurs."""
    low = F.lower(text) if low is None else low
    return F.sort_array(F.array_compact(F.array(*[
        F.when(may_match(low, None, p, held=held) & low.rlike(to_java(p)), F.lit(n)) for p, n in rules.SHELL_COMMANDS])))


def guarded(literal: str, before: list[str], after: list[str]) -> str:
    """A pattern for a literal with none of the given patterns right before or right after it.
    What stands before is looked at once the literal is found, so that a search can skip to it."""
    found = re.escape(literal)
    return found + "".join(f"(?<!{x}{found})" for x in before) + "".join(f"(?!{x})" for x in after)


def sensitive_file_paths(text: Column, held: Column | None = None) -> Column:
    """Paths of the catalogue that the text names, within their guards. A path without guards
    needs no pattern."""
    guards = {path: (before, after) for path, before, after in rules.SENSITIVE_PATH_GUARDS}

    def there(path: str) -> Column:
        holds = text.contains(path) if held is None else any_held(held, [path]) & text.contains(path)
        return holds & text.rlike(to_java(guarded(path, *guards[path]))) if path in guards else holds

    found = F.sort_array(F.array_compact(F.array(*[F.when(there(p), F.lit(p)) for p in rules.SENSITIVE_PATHS])))
    parts = any_of(text, rules.SENSITIVE_PATH_PARTS) if held is None else any_held(held, rules.SENSITIVE_PATH_PARTS)
    return F.when(parts, found).otherwise(_empty())


def suspicious_imports(text: Column, fold: Column | None = None, held: Column | None = None) -> Column:
    found = F.sort_array(F.array_distinct(F.concat(*[
        F.when(may_match(text, fold, p, ic, held), F.regexp_extract_all(text, _j(p, ic), F.lit(0))).otherwise(_empty())
        for p, ic in rules.SUSPICIOUS_IMPORTS])))
    words = any_of(folded(text) if fold is None else fold, rules.SUSPICIOUS_WORDS) if held is None else any_held(held, rules.SUSPICIOUS_WORDS)
    return _gated(text, words, found, _empty())


# ------------------------------------------------------------------ sensitive env names

_ENV_NAMES = r"\b(?:" + "|".join(rules.SENSITIVE_ENV_NAMES) + r")\b"


def env_occurrences(text: Column, held: Column | None = None) -> Column:
    """Every sensitive name occurrence, with its assignment follower when it has one
    (one regex pass; the follower is an optional greedy group), in texts that hold the end of a name."""
    found = F.array_distinct(F.regexp_extract_all(text, _j(_ENV_NAMES + "(?:" + rules.ENV_ASSIGN_FOLLOW + ")?"), F.lit(0)))
    ends = any_of(text, prefilter.ENV_ENDS)
    return _gated(text, ends if held is None else any_held(held, prefilter.ENV_ENDS) & ends, found, _empty())


def _env_name(m: Column) -> Column:
    return F.regexp_extract(m, "^[A-Z_]+", 0)


def env_reads(occ: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(occ, lambda m: _env_name(m) == m), _env_name))


def env_assignments(occ: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(occ, lambda m: _env_name(m) != m), _env_name))


# ------------------------------------------------------------------ all keys of one file

def key_arrays(t: Column, btc_col: str = "_btc", occ_col: str = "_env_occ", fold_col: str = "_fold",
               held: Column | None = None) -> dict[str, Column]:
    """Per-file array expression of every set / presence key (unrouted names). ``btc_col``
    and ``occ_col`` name columns holding :func:`btc_candidates` and :func:`env_occurrences`
    of the same text (computed one projection earlier); ``held``: what the text holds of all rules' literals."""
    occ, fold = F.col(occ_col), F.col(fold_col)
    return {
        "urls": extract_set(t, rules.URL, held=held),
        "data_uris": extract_set(t, rules.DATA_URI, held=held),
        "javascript_uris": extract_set(t, rules.JAVASCRIPT_URI, True, fold, held),
        "ips": extract_set(t, rules.IPV4, held=held),
        "base64_strings": base64_entries(t, held),
        "encoded_urls": extract_set(t, rules.ENCODED_URL, held=held),
        "emails": extract_set(t, rules.EMAIL, held=held),
        "env_var_references": extract_set(t, rules.ENV_VAR, held=held),
        "shell_commands": shell_commands(t, F.col("_low"), held),
        "sensitive_file_paths": sensitive_file_paths(t, held),
        "suspicious_imports": suspicious_imports(t, fold, held),
        "private_ips": extract_set(t, rules.PRIVATE_IP, held=held),
        "crypto_wallets": crypto_wallets(t, btc_col, held),
        "_env_reads": F.sort_array(env_reads(occ)),
        "_env_assigns": F.sort_array(env_assignments(occ)),
        "paste_service_urls": extract_set(t, rules.PASTE_SERVICE, True, fold, held),
    }


def with_text_helpers(df: DataFrame, keep: list[str]) -> DataFrame:
    t = F.col("text")
    return df.select(*keep, btc_candidates(t).alias("_btc"), env_occurrences(t).alias("_env_occ"),
                     folded(t).alias("_fold"), F.lower(t).alias("_low"))


def with_held_literals(df: DataFrame, keep: list[str]) -> DataFrame:
    """The same columns and ``_held``, all rules' literals that the text holds, for a scan with every rule."""
    t, fold, held = F.col("text"), F.col("_fold"), F.col("_held")
    df = df.select(*keep, folded(t).alias("_fold"))
    df = df.select(*keep, "_fold", lowered(t, fold).alias("_low"), prefilter.held(fold).alias("_held"))
    return df.select(*keep, "_fold", "_low", "_held", btc_candidates(t, held).alias("_btc"), env_occurrences(t, held).alias("_env_occ"))


def file_indicators(df: DataFrame, keep=None) -> DataFrame:
    """One row per file with one array column per set/presence key (unrouted names)
    plus ``is_script``. Files without text give null arrays (hence no rows in :func:`indicator_rows`)."""
    keep = list(KEEP if keep is None else keep)
    # no Filter on the text: null text gives null arrays and no exploded rows, and a
    # Filter would be pushed below (and re-evaluate) the projection that decodes it
    df = with_text_helpers(df, keep + ["suffix", "text"])
    arrays = key_arrays(F.col("text"))
    return df.select(*keep, is_script(F.col("suffix")).alias("is_script"),
                     *[c.alias(k) for k, c in arrays.items()])


SET_KEYS = ["urls", "data_uris", "javascript_uris", "ips", "encoded_urls", "emails",
            "env_var_references", "shell_commands", "sensitive_file_paths", "suspicious_imports",
            "private_ips", "crypto_wallets", "paste_service_urls"]


def routed_key(key: str, script: Column) -> Column:
    if key in rules.ROUTED_KEYS:
        return F.when(script, F.lit(key)).otherwise(F.lit(key + "_in_docs"))
    return F.lit(key)


def items(arrays: dict[str, Column], script: Column, keys=None) -> Column:
    """ARRAY<STRUCT<key, value, decoded>> of one file with the reference routing (5 keys go
    to ``<key>_in_docs`` for non-script files; sensitive env names split into reads /
    assignments - reads for scripts, everything ``_in_docs`` for prose)."""
    keys = list(SET_KEYS + ["base64_strings", "sensitive_env_var_names"] if keys is None else keys)

    def wrap(arr: Column, key: Column) -> Column:
        return F.transform(arr, lambda v: F.struct(key.alias("key"), v.alias("value"),
                                                   F.lit(None).cast("string").alias("decoded")))

    parts = []
    for k in keys:
        if k == "base64_strings":
            parts.append(F.transform(arrays[k], lambda e: F.struct(F.lit("base64_strings").alias("key"),
                                                                   e["encoded"].alias("value"),
                                                                   e["decoded"].alias("decoded"))))
        elif k == "sensitive_env_var_names":
            reads, assigns = arrays["_env_reads"], arrays["_env_assigns"]
            parts.append(F.when(script, F.concat(
                wrap(reads, F.lit("sensitive_env_var_names")),
                wrap(F.sort_array(F.array_except(assigns, reads)), F.lit("sensitive_env_var_assignments"))))
                .otherwise(wrap(F.sort_array(F.array_union(reads, assigns)), F.lit("sensitive_env_var_names_in_docs"))))
        else:
            parts.append(wrap(arrays[k], routed_key(k, script)))
    return F.concat(*parts)


def indicator_rows(ind: DataFrame, keys=None, keep=None) -> DataFrame:
    """Explode :func:`file_indicators` into ``keep.., key, value, decoded`` rows."""
    keep = list(KEEP if keep is None else keep)
    names = ["urls", "data_uris", "javascript_uris", "ips", "base64_strings", "encoded_urls", "emails",
             "env_var_references", "shell_commands", "sensitive_file_paths", "suspicious_imports", "private_ips",
             "crypto_wallets", "_env_reads", "_env_assigns", "paste_service_urls"]
    arrays = {k: F.col(k) for k in names if k in ind.columns}
    return (ind.select(*keep, F.explode(items(arrays, F.col("is_script"), keys)).alias("_f"))
            .select(*keep, "_f.key", "_f.value", "_f.decoded"))
