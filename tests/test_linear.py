"""Search forms: the matches of the plain rules, and time in proportion to the text."""

import random
import re
import time

import pytest
from bundlescan.functions import rules
from bundlescan.functions.linear import form
from bundlescan.operators import indicators as IND
from bundlescan.operators import lines as L
from pyspark.sql import functions as F

SETS = {"email": (rules.EMAIL, False), "base64": (rules.BASE64, False), "url": (rules.URL, False), "data": (rules.DATA_URI, False),
        "script": (rules.JAVASCRIPT_URI, True), "ip": (rules.IPV4, False), "encoded": (rules.ENCODED_URL, False), "env": (rules.ENV_VAR, False),
        "private_ip": (rules.PRIVATE_IP, False), "eth": (rules.ETH_WALLET, False), "btc": (rules.BTC_WALLET, False), "paste": (rules.PASTE_SERVICE, True)}
KEY = "-----BEGIN RSA PRIVATE KEY-----"
PIECES = {
    rules.EMAIL: ["a", "Z9", "@", "@b", ".", ".co", "_", "-", " ", "é", "x@y.org"],
    rules.BASE64: ["a", "Zz09", "+", "/", "=", "_", " ", "é", "a" * 19, "b" * 20],
    "jwt": ["eyJ", "a", "-", "_", ".", "b" * 10, "é", " ", "c" * 9, "eyJaaaaaaaaaa.bbbbbbbbbb.cccccccccc"],
    "private-key": [KEY, KEY.replace("BEGIN RSA", "END"), "-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----", "x", "\n", "END PRIVATE KEY-----"],
}


def plain(pattern: str, ignore_case: bool = False) -> re.Pattern:
    return re.compile(pattern, re.I if ignore_case else 0)


@pytest.mark.parametrize("name", list(PIECES))
def test_forms_find_what_the_rules_find(spark, name):
    pattern, ignore_case = next(((p, ic) for p, label, ic in rules.SECRET_SHAPES if label == name), (name, False))
    random.seed(5)
    texts = ["".join(random.choices(PIECES[name], k=random.randint(1, 14))) for _ in range(8000)]
    search = form(pattern, ignore_case)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", F.regexp_extract_all("t", F.lit(search.java), F.lit(search.match)).alias("m"),
                     F.regexp_replace("t", search.java, search.replacement("x")).alias("r")).collect()
    want = plain(pattern, ignore_case)
    for r in rows:
        assert r.m == [m.group() for m in want.finditer(r.t)], r.t
        assert r.r == want.sub("[REDACTED:x]", r.t), r.t
    assert sum(bool(r.m) for r in rows) > 20


#: Repeated, these ask the most of a backtracking search.
SEEDS = ["a", "1", "@", "a@", "a@a.", "@a", "a.", "1.", "255.", "a+", "+a=", "a+a+a+===", "/", "=", "%4", "%41", "eyJ", "eyJ-", "eyJaaaaaaaaaa.", "-", "_", KEY,
         KEY + "\n", "-----END PRIVATE KEY-----", "ghp_a", "xoxb-", "xoxb-a_", "sk-a", "AKIA0", "AIza", "sk_live_a", "password", "token ", "api_key=", "data:a",
         "data:a/", "data:a/b;c", "javascript:", "http://", "https:/", "$", "${A", "$A", "os.environ ", "process.env.", "0x", "bc1q", "1A", "127.0.0.", "10.1.", "[::1",
         "paste.", "ix.io", "é", " ", "\t", "​", "'", "(", "\"A\"+"]


LONG = 150_000


@pytest.fixture(scope="module")
def hostile(spark):
    df = spark.createDataFrame([(s, (s * (LONG // len(s) + 1))[:LONG] + tail) for s in SEEDS for tail in ("", " x", "!")], "seed string, text string")
    df = df.repartition(8).cache()
    df.count()
    yield df
    df.unpersist()


def timed(df) -> float:
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t


@pytest.mark.parametrize("name", list(SETS))
def test_set_patterns_take_linear_time(hostile, name):
    """26 megabytes on all cores: a quadratic search of one of the texts alone takes minutes."""
    assert timed(hostile.select(IND.extract_set(F.col("text"), *SETS[name]))) < 30


@pytest.mark.parametrize("label", [label for _, label, _ in rules.SECRET_SHAPES])
def test_secret_patterns_take_linear_time(hostile, label):
    pattern, ignore_case = next((p, ic) for p, x, ic in rules.SECRET_SHAPES if x == label)
    search = form(pattern, ignore_case)
    assert timed(hostile.select(F.regexp_replace("text", search.java, search.replacement(label)))) < 30


def test_a_megabyte_takes_under_two_seconds(spark):
    for column, seeds in ((lambda t: IND.extract_set(t, rules.EMAIL), ["@" + "a" * 10**6, "a@" * (5 * 10**5)]), (IND.base64_entries, ["a+" * (5 * 10**5) + "==="]),
                          (IND.redact, [KEY * 30000, "eyJ-" * 250000]), (IND.secret_counts, [KEY * 30000, "eyJ-" * 250000])):
        for text in seeds:
            df = spark.createDataFrame([(text,)], "text string").cache()
            df.count()
            df.limit(0).select(column(F.col("text"))).count()
            assert timed(df.select(column(F.col("text")))) < 2
            df.unpersist()


def test_presence_and_line_rules_take_linear_time(spark):
    """Each rule over its own beginnings, repeated: 40,000 characters a line."""
    seeds = SEEDS + ["chmod 7", "7", "chmod 7777", "rm ", "dd ", "import ", "require ( ", "in 1 ", "after 1", "requests.get(", ").text", "getattr(", "open(", "curl ", "| sh",
                     "cp ", "/etc/", "if ", "time.time()", "timestamp", ">", "sudo", "; ", "send the ", "when user says ", "chr( 1", "npx ", "pip install ", "dig ", "subprocess.a("]
    df = spark.createDataFrame([(s, (f"{s}" * (40_000 // len(s) + 1))[:40_000]) for s in seeds], "seed string, text string")
    heads = [F.concat(F.lit(h), F.col("text")) for h in ("", "chmod ", "in ", "if ", "requests.get(")]
    df = df.select(F.explode(F.array(*heads)).alias("text")).repartition(8).cache()
    assert df.count()
    for d in rules.DETECTORS:
        assert timed(df.select(L.matches(F.col("text"), d.pattern, d.ignore_case), L.matches(F.col("text"), d.pattern, d.ignore_case, multiline=True))) < 10, d.name
    for column in (IND.shell_commands, IND.suspicious_imports, IND.sensitive_file_paths, IND.env_occurrences):
        assert timed(df.select(column(F.col("text")))) < 30
    df.unpersist()
