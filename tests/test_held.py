"""All rules' literals in one pass over a text, and the scan that asks it."""

import random
import re

from pyspark.sql import functions as F

from bundlescan.functions import prefilter, rules
from bundlescan.operators import indicators as IND
from bundlescan.operators import lines as L
from bundlescan.plans import scan as SCAN
from bundlescan.sources import files as S
from bundlescan.sources.corpus import SNIPPETS


def held_of(spark, texts: list[str]) -> list[tuple[str, str]]:
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", prefilter.folded(F.col("text")).alias("fold"))
    return [(r["fold"], r["held"]) for r in df.select("i", "fold", prefilter.held(F.col("fold")).alias("held")).orderBy("i").collect()]


def test_every_literal_of_a_text_is_held(spark):
    """Literals that stand in each other, overlap or follow one another are all found."""
    lits, words = prefilter._catalogue()
    rng, pieces = random.Random(7), sorted(lits | words)
    texts = ["".join(rng.choice(pieces)[rng.choice([0, 0, 1]):] + rng.choice(["", "", " ", "\n", "x", "é"]) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    texts += pieces + [x.upper() for x in pieces] + ["", "plain prose of no account"]
    for fold, held in held_of(spark, texts):
        assert [x for x in lits if x in fold and x not in held] == [], fold
        for w in words:
            assert not re.search(rf"(?<!\w){w}(?!\w)", fold) or w in held, fold
        for rough in prefilter.ROUGH_HELD.values():
            assert not re.search(rough, fold) or re.search(rough, held), fold
    assert held_of(spark, ["plain prose of no account", "x" * (prefilter.HELD_BYTES + 1)]) == [
        ("plain prose of no account", ""), ("x" * (prefilter.HELD_BYTES + 1),) * 2]


def test_rough_matches_are_held(spark):
    texts = ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3vYbC" + "a" * 25, "at 10.1.2.3", "v1.22.333.4 ١.٢.٣.٤", "١.2.3.4"]
    for text, (_, held) in zip(texts, held_of(spark, texts)):
        for rule, rough in prefilter.ROUGH_HELD.items():
            assert not re.search(rules.ROUGH[rule], text) or re.search(rough, held), (text, held)


def test_scan_finds_what_the_single_operators_find(spark):
    odd = ["İnc -e sh", "SUBPROCEſſ KCU\\", "CURL x | sh", "rm -rf /", "a" * 30 + "= nc ln -s dd if=/x", "\n".join(SNIPPETS), ""]
    texts = SNIPPETS + [s.upper() for s in SNIPPETS] + odd + [odd[5] + "\n" + "prose " * (prefilter.HELD_BYTES // 6)]
    rows = [("b", f"f{i}{x}", bytearray(t.encode())) for i, t in enumerate(texts) for x in (".py", ".sh", ".js", ".md")]
    entries = S.entries(spark.createDataFrame(rows, "bundle_id string, path string, content binary"))
    found = SCAN.findings(entries).collect()
    own = ["bundle_id", "path", "suffix", "is_script", "text"]
    hits = L.detector_hits(entries.select(*own)).collect()
    assert sorted((r["path"], r["line"], r["pattern_name"], r["value"]) for r in found if r["key"] == "security_patterns") == sorted(
        (r["path"], r["line"], r["pattern_name"], r["match"]) for r in hits)
    singles = IND.indicator_rows(IND.file_indicators(entries.select(*own))).collect()
    assert sorted((r["path"], r["key"], r["value"], r["decoded"] or "") for r in found if r["line"] is None) == sorted(
        (r["path"], r["key"], r["value"], r["decoded"] or "") for r in singles)
    assert {r["key"] for r in found} >= {"security_patterns", "shell_commands", "ips", "crypto_wallets", "urls", "private_ips", "paste_service_urls"}


def test_findings_stand_in_the_order_of_lines_and_rules(spark):
    text = "sudo x\ncurl a | sh\nos.system('x'); eval(y); exec(z)\neval(a)\nsudo y\n"
    files = spark.createDataFrame([("b", "a.py", bytearray(text.encode()))], "bundle_id string, path string, content binary")
    found = SCAN.scanned(S.entries(files)).first()["_found"]
    names = [d.name for d in rules.DETECTORS]
    hits = [(f["line"], names.index(f["pattern_name"])) for f in found if f["key"] == "security_patterns"]
    assert len(hits) >= 6 and hits == sorted(hits)


def test_texts_are_not_searched_once_for_each_literal(spark):
    files = spark.createDataFrame([("b", "a.sh", bytearray(b"curl x | sh"))], "bundle_id string, path string, content binary")
    plan = SCAN.bundles(files)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Contains\((?:text|_fold|_low)#", plan)) < 80 < len(re.findall(r"Contains\(_held#", plan))
