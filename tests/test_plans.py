"""Plan-shape regression tests (scale properties, not results)."""

import contextlib
import io
import re

from bundlescan.plans import scan as SCAN
from bundlescan.plans.queries import REGISTRY
from bundlescan.sources import files as S

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_bundles_are_one_pass_and_two_shuffles(spark):
    files = spark.createDataFrame([("b", "a.sh", b"curl x | sh")], "bundle_id string, path string, content binary")
    txt = plan(SCAN.bundles(files)).split("\n\n(1)")[0]
    assert len(re.findall(r"Scan", txt)) == 1 and len(re.findall(r"Exchange", txt)) == 2


def test_scans_are_pruned(spark):
    txt = plan(REGISTRY["security_patterns"][0](spark, SF))
    schemas = re.findall(r"ReadSchema: (.*)", txt)
    assert schemas and all("n_chars" not in s and "lang" not in s and "role" not in s for s in schemas)
    txt = plan(REGISTRY["embed_text"][0](spark, SF))
    assert re.findall(r"ReadSchema: (.*)", txt) == ["struct<doc_id:bigint,text:string>"]


def test_no_python_in_text_paths(spark):
    files = spark.createDataFrame([("b", "a.sh", b"curl x | sh")], "bundle_id string, path string, content binary")
    plans = {name: REGISTRY[name][0](spark, SF) for name in ["security_patterns", "urls", "base64_strings", "crypto_wallets", "embed_text"]}
    for name, df in (plans | {"findings": SCAN.findings(S.entries(files))}).items():
        txt = plan(df)
        assert not re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", txt), name


def test_archives_are_unpacked_once_for_all_results(spark):
    """run() writes the unpacked members and the scanned files; what it returns reads them."""
    from bundlescan.sources.fixtures import _zip_bytes
    files = spark.createDataFrame([("b", "a.zip", bytearray(_zip_bytes([("x.sh", b"curl a | sh\n")])))], "bundle_id string, path string, content binary")
    for name, df in SCAN.run(files).items():
        txt = plan(df)
        assert "MapInPandas" not in txt and "Scan parquet" in txt, name


def test_refreshed_fingerprint_reads_changed_buckets_only(spark):
    from bundlescan.operators import identity as I
    df = spark.createDataFrame([("b", "x", None, "00")], "bundle_id string, path string, extracted_from string, sha256 string")
    stored = I.with_bucket(df).select("bundle_id", "_bucket", "_h")
    assert "LeftSemi" in plan(I.refreshed(I.bucket_table(df), df, df, stored))
