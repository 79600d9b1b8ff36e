"""Line-grain detectors: the 71 categorised rules, invisible characters, DNS exfiltration.

Plan shape (all narrow, no shuffle):

1. whole-file gate — per file, the flags of the rules that match *anywhere* in the text
   (rule compiled in ``(?m)`` mode). A whole-text match is a superset of the line
   matches, so a file with an empty gate list can never produce a hit and is never
   exploded into lines. At scale almost every file is clean; this keeps the line
   explosion proportional to the hits, not to the corpus.
2. ``posexplode(split(text, '\\n'))`` on the surviving files only.
3. per line, one ``when`` per fired rule -> ``array_compact`` -> ``explode``; the
   match is the whole first one on the line.

Everything stays in JVM expressions (codegen), every regex is a literal compiled once
per task. Rules of the form ``A.*B`` are searched in linear time (``dialect.linear_forms``),
so a long line costs its length, not the square of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dialect import linear_forms, to_java
from ..functions.prefilter import any_of, folded, may_match

KEEP = ["bundle_id", "path"]

#: One finding of a file, whatever its grain.
FOUND = ("struct<key:string,value:string,line:bigint,category:string,pattern_name:string,description:string,"
         "position:bigint,decoded:string>")


def finding(key: Column, value: Column, **more: Column) -> Column:
    """A FOUND struct; fields that a grain lacks are null."""
    fields = [f.split(":") for f in FOUND[len("struct<"):-1].split(",")]
    have = {"key": key, "value": value} | more
    return F.struct(*[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def line_findings(text: Column, fired: Column, inv: Column, dns: Column, detectors=None) -> Column:
    """All line-grain findings of a file as one array: rules, invisible characters, DNS lookups.
    Files whose gates did not fire never split into lines, and only rules that fired go over the lines:
    rule by rule, their findings then put in the order of lines."""
    detectors = list(rules.DETECTORS if detectors is None else detectors)
    split = F.split(text, "\n", -1)
    pat = to_java(rules.INVISIBLE_UNICODE)
    hit = f"struct<line:int,rule:int,found:{FOUND}>"

    def of_rule(k, d):
        found = F.transform(split, lambda line, i: F.when(may_match(line, None, d.pattern, d.ignore_case) & matches(line, d.pattern, d.ignore_case), F.struct(
            (i + 1).alias("line"), F.lit(k).alias("rule"),
            finding(F.lit("security_patterns"), first_match(line, d.pattern, d.ignore_case), line=i + 1,
                    category=F.lit(d.category), pattern_name=F.lit(d.name), description=F.lit(d.description)).alias("found"))))
        return F.when(fired_at(fired, k), F.array_compact(found)).otherwise(F.array().cast(f"array<{hit}>"))

    by_rule = F.transform(F.sort_array(F.concat(*[of_rule(k, d) for k, d in enumerate(detectors)])), lambda x: x["found"])

    def by_char(line, i):
        found = F.transform(F.split(line, "", -1), lambda ch, at: F.when(
            ch.rlike(pat), finding(F.lit("invisible_unicode"), F.format_string("U+%04X", F.ascii(ch)), line=i + 1, position=at)))
        return F.when(line.rlike(pat), F.array_compact(found)).otherwise(_none())

    def by_lookup(line, i):
        return F.when(matches(line, rules.DNS_EXFIL, True),
                      F.array(finding(F.lit("dns_exfil_patterns"), first_match(line, rules.DNS_EXFIL, True), line=i + 1))).otherwise(_none())

    return F.concat(F.when(any_fired(fired), by_rule).otherwise(_none()), *[
        F.when(gate, F.flatten(F.transform(split, each))).otherwise(_none()) for gate, each in ((inv, by_char), (dns, by_lookup))])


def _none() -> Column:
    return F.array().cast(f"array<{FOUND}>")


def _gate(d: rules.Detector, suffix: Column) -> Column:
    return F.lit(True) if d.gate is None else suffix.isin(*d.gate)


# ``requests.get(`` ... ``).text`` ... ``exec``: between the parentheses no ``)`` may stand, so a line is
# searched by the stretches that a ``)`` ends, up to its last ``exec``
_GET_EXEC = next(d.pattern for d in rules.DETECTORS if d.name == "requests_get_exec")
_GET_EXEC_PARTS = (r"^(.*)exec", r"(?:^|\))(?>[^)]*?(?=requests\.get\([^)]))(requests\.get\([^)]+\)\.text.*)")


def _get_exec(line: Column) -> Column:
    """The match but for its closing ``exec``, '' without one."""
    head, search = map(to_java, _GET_EXEC_PARTS)
    return F.regexp_extract(F.regexp_extract(line, head, 1), search, 1)


def matches(text: Column, pattern: str, ignore_case: bool = False, multiline: bool = False) -> Column:
    """Whether a rule matches somewhere in the text (one line, or with multiline any of its lines)."""
    if pattern == _GET_EXEC:  # for a whole file, all its literals will do as a gate
        return (text.contains("requests.get(") & text.contains(").text") & text.contains("exec")
                if multiline else _get_exec(text) != "")
    found = [text.rlike(to_java(p, ignore_case, multiline)) for p in linear_forms(pattern) or [pattern]]
    return reduce(lambda a, b: a | b, found)


def first_match(line: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The first match of a rule on a line that has one."""
    if pattern == _GET_EXEC:
        return F.concat(_get_exec(line), F.lit("exec"))
    forms = [to_java(p, ignore_case) for p in linear_forms(pattern)]
    if not forms:
        return F.regexp_extract(line, to_java(pattern, ignore_case), 0)
    # each form's groups: what comes before the match, and the match; the earliest wins
    found = [F.when(line.rlike(p), F.struct(F.length(F.regexp_extract(line, p, 1)).alias("at"), F.lit(i).alias("i"),
                                            F.regexp_extract(line, p, 2).alias("match"))) for i, p in enumerate(forms)]
    return (F.least(*found) if len(found) > 1 else found[0])["match"]


def _lines(df: DataFrame, keep: list[str], extra: list[str], when: Column) -> DataFrame:
    """Lines of the files for which ``when`` holds. The condition sits inside the
    generator instead of a Filter, so Catalyst cannot push it below the projection that
    computes it (which would evaluate the whole-file gate twice)."""
    parts = F.when(when, F.split(F.col("text"), "\n", -1))
    return df.select(*keep, *extra, F.posexplode(parts).alias("_pos", "_line"))


def detector_gate(text: Column, suffix: Column, detectors=None, whole_file_gate: bool = True,
                  fold: Column | None = None, held: Column | None = None) -> Column:
    """STRING of one flag per detector ('1' = its suffix gate passed and it matches
    anywhere in the text). A flag string, unlike an ``array_compact``-ed id list, is plain
    string code, so the gate stays inside whole-stage codegen. Each regex runs only when the
    text holds one of the rule's required literals (``fold`` = the folded text column for
    case-insensitive rules, ``held`` = a column of all rules' literals in the text)."""
    detectors = list(rules.DETECTORS if detectors is None else detectors)
    fold = folded(text) if fold is None else fold
    return F.concat(*[
        F.when(_gate(d, suffix) & ((may_match(text, fold, d.pattern, d.ignore_case, held)
                                    & matches(text, d.pattern, d.ignore_case, multiline=True))
                                   if whole_file_gate else text.isNotNull()), F.lit("1")).otherwise(F.lit("0"))
        for d in detectors
    ])


def any_fired(fired: Column) -> Column:
    return F.instr(fired, "1") > 0


def fired_at(fired: Column, i: int) -> Column:
    return F.substring(fired, i + 1, 1) == "1"


def invisible_gate(text: Column) -> Column:
    return F.coalesce((F.octet_length(text) != F.length(text)) & any_of(text, rules.INVISIBLE_CHARS), F.lit(False))


def dns_gate(text: Column, fold: Column | None = None, held: Column | None = None) -> Column:
    return F.coalesce(may_match(text, fold, rules.DNS_EXFIL, True, held)
                      & matches(text, rules.DNS_EXFIL, ignore_case=True, multiline=True), F.lit(False))


def detector_hits(df: DataFrame, detectors=None, keep=None, whole_file_gate: bool = True) -> DataFrame:
    """``df(bundle_id, path, suffix, text)`` -> one row per (file, line, rule) hit:
    ``keep.., line, category, pattern_name, description, match``.
    ``whole_file_gate=False`` explodes every line of every file (same result; the bench
    uses it to measure what the gate saves)."""
    keep = list(KEEP if keep is None else keep)
    df = df.select(*keep, "suffix", "text", folded(F.col("text")).alias("_fold"))
    fired = detector_gate(F.col("text"), F.col("suffix"), detectors, whole_file_gate, F.col("_fold"))
    return hits_from_gate(df.select(*keep, "text", fired.alias("_fired")), detectors, keep)


def hits_from_gate(files: DataFrame, detectors=None, keep=None) -> DataFrame:
    """Line hits of files that already carry their gate list in ``_fired``."""
    detectors = list(rules.DETECTORS if detectors is None else detectors)
    keep = list(KEEP if keep is None else keep)
    lines = _lines(files, keep, ["_fired"], any_fired(F.col("_fired")))
    line = F.col("_line")
    hits = F.array_compact(F.array(*[
        F.when(fired_at(F.col("_fired"), i) & matches(line, d.pattern, d.ignore_case),
               F.struct(F.lit(d.category).alias("category"), F.lit(d.name).alias("pattern_name"),
                        F.lit(d.description).alias("description"),
                        first_match(line, d.pattern, d.ignore_case).alias("match")))
        for i, d in enumerate(detectors)
    ]))
    return (lines.select(*keep, (F.col("_pos") + 1).alias("line"), F.explode(hits).alias("_h"))
            .select(*keep, "line", "_h.category", "_h.pattern_name", "_h.description", "_h.match"))


def category_hits(df: DataFrame, category: str, keep=None) -> DataFrame:
    return detector_hits(df, [d for d in rules.DETECTORS if d.category == category], keep)


def invisible_unicode(df: DataFrame, keep=None) -> DataFrame:
    """Every zero-width / BOM character: line, ``U+XXXX``, 0-based code-point position."""
    keep = list(KEEP if keep is None else keep)
    pat = to_java(rules.INVISIBLE_UNICODE)
    files = df.select(*keep, "text")
    gate = F.col("_inv") if "_inv" in df.columns else invisible_gate(F.col("text"))
    if "_inv" in df.columns:
        files = df.select(*keep, "text", "_inv")
    lines = _lines(files, keep, [], gate).where(F.col("_line").rlike(pat))
    chars = lines.select(*keep, (F.col("_pos") + 1).alias("line"),
                         F.posexplode(F.split(F.col("_line"), "", -1)).alias("position", "_ch"))
    return (chars.where(F.col("_ch").rlike(pat))
            .select(*keep, "line", F.format_string("U+%04X", F.ascii("_ch")).alias("char_code"), "position"))


def dns_exfil(df: DataFrame, keep=None) -> DataFrame:
    """First ``nslookup|dig|host … $`` per line, whole."""
    keep = list(KEEP if keep is None else keep)
    if "_dns" in df.columns:
        files, gate = df.select(*keep, "text", "_dns"), F.col("_dns")
    else:
        files, gate = df.select(*keep, "text"), dns_gate(F.col("text"))
    line = F.col("_line")
    lines = _lines(files, keep, [], gate).where(matches(line, rules.DNS_EXFIL, True))
    return lines.select(*keep, (F.col("_pos") + 1).alias("line"), first_match(line, rules.DNS_EXFIL, True).alias("match"))
