"""Randomised parity: our Java translation (run by Spark) against Python ``re`` on generated
strings with Unicode near-misses (SURVEY §4.1, §5 strategy 3)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bundlescan.functions import rules
from bundlescan.functions.dialect import to_java
from bundlescan.operators import lines

ALPHABET = list("abcdefghijklmnopqrstuvwxyz0123456789 _-./:;|&=\"'()$\t") + [
    "é", "ſ", "３", "‍", "́", " ", " ", "K", "\u0085", "curl", "nc", "eval(", "sudo ",
    "import subprocess", "npx ", "--yes", "chmod 777 ", "after 3 days then", "http://1.2.3.4", "API_KEY=",
    "os.environ", "/etc/passwd", ".env", "process", "AKIA" + "A" * 16, "secretly send"]

GAPS = ["getattr(", ", 'system'", "subprocess.run(", "shell=True", "base64.b64decode", "exec", "atob", "eval", "codecs.decode", "'hex'",
        "open(", "'w", "python", "pty.spawn", "curl", "wget", "| sh", "|bash", "requests.get(", "u", ").text", "if", "Date.now", "datetime.now",
        ">", "timestamp", "1234567890", "cp ", "ln ", "/etc/", "/usr/local/bin/", "host ", "dig ", "$"]

PATTERNS = [(d.pattern, d.ignore_case) for d in rules.DETECTORS] + [
    (p, False) for p, _ in rules.SHELL_COMMANDS] + [(p, ic) for p, ic in rules.SUSPICIOUS_IMPORTS] + [
    (rules.IPV4, False), (rules.EMAIL, False), (rules.URL, False), (rules.BASE64, False), (rules.PRIVATE_IP, False)]

texts = st.lists(st.sampled_from(ALPHABET), min_size=0, max_size=12).map("".join)


@settings(max_examples=40, deadline=None)
@given(st.lists(texts, min_size=20, max_size=20))
def test_first_match_parity(spark, samples):
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    cols = [F.regexp_extract("t", to_java(p, ic), 0).alias(f"p{i}") for i, (p, ic) in enumerate(PATTERNS)]
    got = df.select("t", *cols).collect()
    for row in got:
        for i, (p, ic) in enumerate(PATTERNS):
            m = re.search(p, row.t, re.IGNORECASE if ic else 0)
            assert (m.group(0) if m else "") == row[f"p{i}"], (p, row.t)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET + GAPS), max_size=14).map("".join), min_size=20, max_size=20))
def test_linear_search_parity(spark, samples):
    """Rules with a gap: the linear search finds Python's first match, the line gate every line with one."""
    gaps = [(d.pattern, d.ignore_case) for d in rules.DETECTORS if ".*" in d.pattern] + [(rules.DNS_EXFIL, True)]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    t = F.col("t")
    cols = [F.when(lines.matches(t, p, ic), lines.first_match(t, p, ic)).alias(f"p{i}") for i, (p, ic) in enumerate(gaps)]
    gates = [lines.matches(t, p, ic, multiline=True).alias(f"g{i}") for i, (p, ic) in enumerate(gaps)]
    for row in df.select("t", *cols, *gates).collect():
        for i, (p, ic) in enumerate(gaps):
            m = re.search(p, row.t, re.IGNORECASE if ic else 0)
            assert (m.group(0) if m else None) == row[f"p{i}"], (p, row.t)
            assert row[f"g{i}"] or not m


def test_required_literals_are_required():
    """Every match of every rule contains one of its required literals (checked with
    Python ``re`` on the planted snippets and random strings)."""
    import random

    from bundlescan.functions.dialect import FOLD_FROM, FOLD_TO, required_literals
    from bundlescan.sources.corpus import SNIPPETS
    rnd = random.Random(7)
    samples = list(SNIPPETS) + ["".join(rnd.choice(ALPHABET) for _ in range(15)) for _ in range(3000)]
    fold = str.maketrans(FOLD_FROM, FOLD_TO)
    for p, ic in PATTERNS:
        lits = required_literals(p)
        if not lits:
            continue
        for s in samples:
            for m in re.finditer(p, s, re.IGNORECASE if ic else 0):
                seg = m.group(0).translate(fold).lower() if ic else m.group(0)
                want = [x.lower() for x in lits] if ic else lits
                assert any(x in seg for x in want), (p, s, lits)
