"""Set / presence extractors and redaction."""

from pyspark.sql import functions as F

from bundlescan.functions import rules
from bundlescan.functions.dialect import to_java
from bundlescan.operators import indicators as IND
from bundlescan.sources.corpus import SNIPPETS
from conftest import text_df


def rows(spark, path, text):
    df = text_df(spark, [(path, text)])
    out = {}
    for r in IND.indicator_rows(IND.file_indicators(df)).collect():
        out.setdefault(r.key, []).append((r.value, r.decoded) if r.key == "base64_strings" else r.value)
    return {k: sorted(v) for k, v in out.items()}


def test_base64_and_redaction(spark):
    got = rows(spark, "a.md", SNIPPETS[24])["base64_strings"]
    assert len(got) == 2
    assert ("dG9rZW49YWJjZGVmZ2gxMjM0NTY3OCBlbmQ=", "[REDACTED:credential-assignment] end") in got


def test_env_names_script_vs_prose(spark):
    s = rows(spark, "a.py", SNIPPETS[26])
    assert s["sensitive_env_var_names"] == ["API_KEY", "GITHUB_TOKEN"]
    assert s["sensitive_env_var_assignments"] == ["JWT_SECRET", "OPENAI_API_KEY"]
    d = rows(spark, "a.md", SNIPPETS[26])
    assert d["sensitive_env_var_names_in_docs"] == ["API_KEY", "GITHUB_TOKEN", "JWT_SECRET", "OPENAI_API_KEY"]
    assert "sensitive_env_var_assignments" not in d


def test_wallets_checksum(spark):
    w = rows(spark, "a.txt", SNIPPETS[27])["crypto_wallets"]
    assert len(w) == 3 and w[0].startswith("0x") and any(x.startswith("bc1") for x in w)
    assert "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa" in w and "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb" not in w


def test_zero_width_joiner_does_not_hide_curl(spark):
    r = rows(spark, "a.sh", SNIPPETS[30])
    assert "curl" in r["shell_commands"]
    assert "import subprocess" in r["suspicious_imports"]


def test_near_misses(spark):
    r = rows(spark, "a.py", SNIPPETS[31])
    assert r.get("shell_commands") == ["chmod"]
    assert "suspicious_imports" not in r and "sensitive_file_paths" not in r


def test_paths_commands_secrets(spark):
    r = rows(spark, "a.sh", SNIPPETS[32])
    assert r["shell_commands"] == ["dd", "scp", "ssh"]
    assert r["sensitive_file_paths"] == [".env", "id_rsa", "~/.ssh/"]
    df = text_df(spark, [("a.sh", SNIPPETS[32])])
    labels = {x.label for x in df.select(F.explode(IND.secret_counts(F.col("text"))).alias("s"))
              .select("s.*").where("n > 0").collect()}
    assert labels == {"aws-access-key", "credential-assignment"}


def test_env_member_access_and_routing(spark):
    r = rows(spark, "a.md", "process.env.X import.meta.env Deno.env.get config.env .env.production os.environ")
    assert r["sensitive_file_paths_in_docs"] == [".env"]
    assert rows(spark, "a.md", "process.env.X and .env.example")["env_var_references_in_docs"] == ["process.env.X"]


def test_dd_needs_key_value(spark):
    assert "shell_commands_in_docs" not in rows(spark, "a.md", "date yyyy-mm-dd")
    assert rows(spark, "a.md", "dd if=/dev/zero")["shell_commands_in_docs"] == ["dd"]


def test_set_keys_sorted_distinct(spark):
    r = rows(spark, "a.md", "b@x.org a@x.org b@x.org https://z.example/ https://a.example/.")
    assert r["emails"] == ["a@x.org", "b@x.org"]
    assert r["urls"] == ["https://a.example/.", "https://z.example/"]


def test_data_uri_many_params_no_stack_overflow(spark):
    uri = "data:text/plain" + ";a=b" * 20000 + ",QUJD"
    assert rows(spark, "a.md", uri)["data_uris"] == [uri]


def test_redact_order(spark):
    df = spark.createDataFrame([("AKIA" + "A" * 16 + " and password: abcdefgh1",)], "t string")
    assert df.select(IND.redact(F.col("t"))).first()[0] == \
        "[REDACTED:aws-access-key] and [REDACTED:credential-assignment]"


def _base58check(payload: bytes) -> str:
    import hashlib
    raw = payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = rules.BASE58_ALPHABET[d] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def test_base58check_of_many_addresses(spark):
    import random
    r = random.Random(7)
    good = [_base58check(bytes([v]) + bytes(z) + r.randbytes(20 - z)) for v in (0, 5) for z in (0, 0, 0, 1, 2) for _ in range(6)]
    bad = [x[:-1] + ("2" if x[-1] != "2" else "3") for x in good] + ["1" + x for x in good] + ["3" + "z" * 34, "1" * 35, "1" * 26]
    df = spark.createDataFrame([(x,) for x in good + bad], "c string")
    got = {x.c: x.ok for x in df.select("c", F.expr(IND.base58check_sql("c")).alias("ok")).collect()}
    assert all(got[x] for x in good) and not any(got[x] for x in bad if x not in good)


def test_rough_searches_let_every_match_through(spark):
    texts = ["x1.2.3.4", "at 255.255.255.255.", "٣.1.2.3", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa,", "q " + "Ab+/" * 5 + "==", "=" + "a" * 20,
             "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "no match at all", "1.2.3", "é" + "A" * 24]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern, rough in rules.ROUGH.items():
        out = df.select("t", F.col("t").rlike(to_java(pattern)).alias("m"), (F.col("t").rlike(to_java(rough)) | F.col("t").contains("bc1")).alias("r")).collect()
        assert all(x.r for x in out if x.m) and any(x.m for x in out) and not all(x.r for x in out)


def test_literals_are_searched_from_their_rarest_character():
    from bundlescan.functions.prefilter import _lits
    assert _lits(r"\bsubprocess\b", False) == ("bprocess",)   # s begins many words of prose, b few
    assert _lits(r"\beval\s*\(", False) == ("eval",)
    for d in rules.DETECTORS:
        assert all(len(x) >= 1 for x in _lits(d.pattern, d.ignore_case) or ())


def test_folding_lower_cases_as_translating_does(spark):
    from bundlescan.functions.prefilter import folded
    texts = ["ABC", "ſECRET", "İıIK", "Äß İx", "", None, "KELVIN"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.lower(F.translate("t", "ſıİK", "sIIk"))
    assert all(a == b for a, b in df.select(folded(F.col("t")), old).collect())


def test_lines_are_counted_without_splitting(spark):
    from bundlescan.sources.files import line_count, meta_text
    texts = [b"", b"a", b"a\n", b"\n", b"a\r\nb\rc\n\nd", b"\xff\r\xfe\n", "é\n中".encode()]
    df = spark.createDataFrame([(bytearray(t),) for t in texts], "c binary").select(meta_text(F.col("c")).alias("t"))
    rows = df.select("t", line_count(F.col("t"))).collect()
    want = [t.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    assert [r[0] for r in rows] == want
    assert [r[1] for r in rows] == [len(w.split("\n")) if w else 0 for w in want]
