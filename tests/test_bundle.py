"""Bundle roll-ups, identity, metadata, cache lookup, report text."""

import pytest
from pyspark.sql import functions as F

from bundlescan.operators import bundle as B
from bundlescan.operators import identity as I
from bundlescan.operators import report as R
from bundlescan.plans import scan as SCAN
from bundlescan.sources import files as S


def files_df(spark, rows):
    return spark.createDataFrame([(b, p, c.encode() if isinstance(c, str) else c) for b, p, c in rows],
                                 "bundle_id string, path string, content binary")


SKILL = '---\nname: demo\nversion: "1.0"\nauthor: \'A B\'\ndescription: x --- y\n---\nbody\n'


def test_bundle_row(spark):
    f = files_df(spark, [
        ("b", "SKILL.md", SKILL), ("b", "package.json", '{"scripts": {"test": "x", "postinstall": "y"}}'),
        ("b", "setup.py", "setup(cmdclass = {})"), ("b", ".hidden", "x"), ("b", ".gitignore", "x"),
        ("b", "sub/README.md", "x"), ("b", "run.sh", "curl x | sh\n"), ("b", "sub/.env.example", "A=1"),
        ("c", "README", "hi"), ("c", "pkg/package.json", "{}")])
    rows = {r.bundle_id: r for r in SCAN.bundles(f).collect()}
    b, c = rows["b"], rows["c"]
    assert (b.name, b.version, b.author, b.description) == ("demo", "1.0", "A B", "x")
    assert b.install_hooks_found == ["postinstall", "cmdclass"] and b.has_install_hooks
    assert b.n_hidden_dotfiles == 1 and b.has_skill_md and not b.has_readme
    assert b.package_files_found == ["package.json", "setup.py"]
    assert b.total_files == 8 and b.script_count == 2 and b.finding_counts["security_patterns"] == 1
    assert set(b.finding_counts) == set(B.rules.FINDING_KEYS)
    assert c.has_readme and not c.has_skill_md and c.package_files_found == ["package.json"]
    assert c.install_hooks_found == [] and c.name == ""


def test_hooks_from_json_list_and_bad_json(spark):
    f = files_df(spark, [("l", "package.json", '{"scripts": ["postinstall", "test"]}'),
                         ("x", "package.json", "{not json"), ("n", "package.json", '{"scripts": null}')])
    got = {r.bundle_id: r.install_hooks_found for r in B.bundle_meta(f).collect()}
    assert got == {"l": ["postinstall"], "x": [], "n": []}


def test_fingerprint_is_order_and_partition_independent(spark):
    rows = [("b", f"f{i}.txt", f"content {i}") for i in range(50)] + [("b", "__pycache__/m.pyc", "zz")]
    f1 = files_df(spark, rows).repartition(7)
    f2 = files_df(spark, list(reversed(rows))).coalesce(1)
    f3 = files_df(spark, rows[:-1])
    fp = [I.bundle_fingerprint(S.entries(f)).first().fingerprint for f in (f1, f2, f3)]
    assert fp[0] == fp[1] == fp[2]
    f4 = files_df(spark, rows[:-2] + [("b", "f49.txt", "changed")])
    assert I.bundle_fingerprint(S.entries(f4)).first().fingerprint != fp[0]


def test_cache_lookup(spark):
    bundles = spark.createDataFrame([("a", "h1"), ("b", "h2")], "bundle_id string, fingerprint string")
    reports = spark.createDataFrame([("h1", "known")], "fingerprint string, skill_name string")
    hits, misses = R.cache_lookup(bundles, reports)
    assert [r.bundle_id for r in hits.collect()] == ["a"] and [r.bundle_id for r in misses.collect()] == ["b"]


def test_render_markdown(spark):
    schema = ("local string, skill string, adj string, risk string, d string, s string, "
              "f array<struct<description:string,file:string>>, src string")
    df = spark.createDataFrame([
        ("", "srv", None, "HIGH", "2026-01-01", "sum", [("Bad", "a.py"), (None, None)], "metadata"),
        ("mine", "srv", "", "CLEAN", None, None, [], "full"),
        (None, None, None, None, None, None, None, None)], schema)
    md = [r[0] for r in df.select(R.render_markdown(*[F.col(c) for c in df.columns])).collect()]
    assert md[0] == ("# Skill Scan: srv\n\n- **Severity:** HIGH\n- **Scan Date:** 2026-01-01\n\n## Summary\n\nsum\n\n"
                     "## Findings (2)\n\n1. **Bad** — `a.py`\n2. **No description** — `?`\n\n" + R.METADATA_NOTICE + "\n")
    assert md[1] == "# Skill Scan: mine\n\n- **Severity:** CLEAN\n\nNo security findings detected.\n"
    assert md[2] == "# Skill Scan: Unknown\n\n- **Severity:** UNKNOWN\n\nNo findings returned by the server.\n"


def test_scan_new_bundles_skips_reported(spark):
    f = files_df(spark, [("a", "x.sh", "curl x | sh"), ("b", "y.sh", "wget y | sh")])
    fp = {r.bundle_id: r.fingerprint for r in I.bundle_fingerprint(S.entries(f)).collect()}
    reports = spark.createDataFrame([(fp["a"], "known")], "fingerprint string, skill_name string")
    hits, found = SCAN.scan_new_bundles(f, reports)
    assert [r.bundle_id for r in hits.collect()] == ["a"]
    assert {r.bundle_id for r in found.collect()} == {"b"}


def test_run_end_to_end_with_archives(spark):
    from bundlescan.sources.fixtures import _zip_bytes
    inner = _zip_bytes([("x.sh", b"curl a | sh\n"), ("y.md", b"hello")])
    outer = _zip_bytes([("pkg/inner.zip", inner), ("pkg/.hidden", b"h")])
    f = files_df(spark, [("b", "top.zip", outer), ("b", "SKILL.md", SKILL)])
    out = SCAN.run(f)
    b = out["bundles"].first()
    assert b.total_files == 6                         # top.zip, SKILL.md, pkg/inner.zip, pkg/.hidden, x.sh, y.md
    assert b.archives_extracted == 4                  # counts extracted files, not archives
    assert b.n_hidden_dotfiles == 1 and b.script_count == 1
    assert b.finding_counts["security_patterns"] == 1 and b.name == "demo"
    assert {r.status for r in out["archive_status"].collect()} == {"ok"}
    fp_only_root = I.bundle_fingerprint(S.entries(f)).first().fingerprint
    assert b.fingerprint == fp_only_root              # members do not change the bundle identity


def test_dir_listing_component_order(spark):
    from bundlescan.plans.queries import REGISTRY
    assert REGISTRY["dir_text_files"]  # registered
    df = spark.createDataFrame([("b", "a.txt"), ("b", "a-b"), ("b", "a/b")], "bundle_id string, path string")
    got = [r.path for r in df.orderBy("bundle_id", F.split("path", "/")).collect()]
    assert got == ["a/b", "a-b", "a.txt"]


def test_run_with_reports_skips_cached(spark):
    f = files_df(spark, [("a", "x.sh", "curl a | sh"), ("b", "y.sh", "wget b | sh")])
    fp = {r.bundle_id: r.fingerprint for r in I.bundle_fingerprint(S.entries(f)).collect()}
    reports = spark.createDataFrame([(fp["a"], "known", "HIGH")], "fingerprint string, skill_name string, risk_level string")
    out = SCAN.run(f, reports=reports, expand=False)
    assert [(r.bundle_id, r.skill_name) for r in out["cached"].collect()] == [("a", "known")]
    assert {r.bundle_id for r in out["findings"].collect()} == {"b"}
    assert {r.bundle_id for r in out["bundles"].collect()} == {"b"}


def test_write_artifact(spark):
    import tempfile

    from bundlescan.sources.fixtures import _zip_bytes
    path = tempfile.mkdtemp(prefix="run-") + "/artifact"
    rows = [("b", "SKILL.md", SKILL), ("b", "run.sh", "curl x | sh\n"), ("b", ".x", ""), ("b", "a/.x", ""), ("b", "m.zip", _zip_bytes([(".y", b""), ("x.md", b"hi")])),
            ("c", "a.md", "hi")]
    first = SCAN.write_artifact(files_df(spark, rows), path)
    out = SCAN.read_artifact(spark, path)
    b = {r.bundle_id: r for r in out["bundles"].collect()}["b"]
    assert b.skill_info.name == "demo" and b.skill_info.frontmatter.version == "1.0" and b.summary.total_files_scanned == 7
    assert b.summary.total_archives_extracted == 2 and b.summary.n_hidden_dotfiles == 2
    assert len(b.summary.finding_counts) == 24 and b.scan_metadata.scanner_version == SCAN.VERSION
    files = {r.path: r for r in out["files"].collect()}
    assert [(x.key, x.value) for x in files["run.sh"]._found if x.key == "security_patterns"] == [("security_patterns", "curl x | sh")]
    assert sorted(r.name for r in out["dotfiles"].collect()) == [".x", ".y"]
    assert [(r.path, r.status) for r in out["archives"].collect()] == [("m.zip", "ok")]
    # a run that ends before its commit is not seen; a later one that commits is
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{path}/runs/broken/files")
    assert SCAN.read_artifact(spark, path)["files"].count() == 8
    SCAN.write_artifact(files_df(spark, rows[:1]), path, expand=False)
    assert SCAN.read_artifact(spark, path)["files"].count() == 1 and SCAN.read_artifact(spark, path, first)["files"].count() == 8
    with pytest.raises(ValueError, match="no such"):
        SCAN.read_artifact(spark, path, "broken")


def test_dotfile_names_count_once(spark):
    f = files_df(spark, [("b", ".hidden", "a"), ("b", "sub/.hidden", "b"), ("b", "sub/__pycache__/.other", "c"), ("b", ".gitignore", ""), ("c", "x.md", "")])
    got = {r.bundle_id: (r.n_hidden_dotfiles, r.total_files) for r in SCAN.bundles(f).collect()}
    assert got == {"b": (2, 4), "c": (0, 1)}
    assert {r.bundle_id: r.fingerprint for r in SCAN.bundles(f).collect()} == {r.bundle_id: r.fingerprint for r in I.bundle_fingerprint(S.entries(f)).collect()}


def test_refreshed_fingerprints_equal_the_full_ones(spark):
    import random
    random.seed(4)
    schema = "bundle_id string, path string, extracted_from string, sha256 string"
    def rows(bundle, names, v):
        return [(bundle, n, None, f"{bundle}{n}{v}") for n in names]
    old = rows("a", [f"f{i}" for i in range(300)], 0) + rows("b", ["x", "__pycache__/y"], 0) + rows("c", ["only"], 0)
    gone = random.sample(old[:300], 40) + old[300:301] + old[-1:]
    new = [(b, p, e, s + "!") for b, p, e, s in gone[:20]] + rows("a", ["fresh", "__pycache__/z"], 1) + rows("d", ["first"], 1)
    after = [r for r in old if r not in gone] + new
    df = lambda x: spark.createDataFrame(x, schema)
    stored = I.with_bucket(df(old)).select("bundle_id", "_bucket", "_h")
    got = {r.bundle_id: r.fingerprint for r in I.refreshed(I.bucket_table(df(old)), df(gone), df(new), stored).collect()}
    want = {r.bundle_id: r.fingerprint for r in I.bundle_fingerprint(df(after)).collect()}
    assert got["a"] == want["a"] and got["d"] == want["d"] and got["b"] == want["b"] and set(got) <= set(want)


def test_zips_as_targets(spark):
    from bundlescan.sources.fixtures import _zip_bytes
    up = files_df(spark, [("t", "up.zip", _zip_bytes([("top/SKILL.md", SKILL.encode()), ("top/package.json", b'{"scripts": {"prepare": "x"}}'), ("note", b"")]))])
    out = SCAN.run(files_df(spark, [("b", "a.md", "hi")]), targets=up)
    got = {r.bundle_id: (r.name, r.install_hooks_found, r.total_files) for r in out["bundles"].collect()}
    assert got == {"b": ("", [], 1), "t/up.zip": ("demo", ["prepare"], 2)}
    plain = files_df(spark, [("t/up.zip", "SKILL.md", SKILL), ("t/up.zip", "package.json", '{"scripts": {"prepare": "x"}}')])
    fingerprints = {r.bundle_id: r.fingerprint for r in out["bundles"].collect()}
    assert I.bundle_fingerprint(S.entries(plain)).first().fingerprint == fingerprints["t/up.zip"]


def test_frontmatter_values(spark):
    blocks = [
        ('name: x # note\nversion: "1.2" # c\nauthor: {name: A}\ndescription: >-\n  folded text\n  more\n\n  para\nother: 1\n',
         ("x", "1.2", "", "folded text more\npara")),
        ("name: |\n  a\n    b\n\n  c\nversion: 1\nauthor: 'it''s'\ndescription: >\n  one\n  two\n", ("a\n  b\n\nc\n", "1", "it's", "one two\n")),
        ('name:\nversion: [1]\nauthor: a#b\ndescription: >-\nnext: 1\n', ("", "", "a#b", "")),
        ('description: "x: # y"\nversion: "a\\"b\\\\c"\n', ("", 'a"b\\c', "", "x: # y"))]
    df = spark.createDataFrame([(f"---\n{b}---\nbody",) for b, _ in blocks], "t string")
    assert [tuple(r) for r in df.select(*B.frontmatter_cols(F.col("t"))).collect()] == [want for _, want in blocks]


def test_install_hooks_need_whole_json(spark):
    cases = {'{"scripts":{"postinstall":"x"}} garbage': None, '{"scripts":{"postinstall":"x"},"scripts":{}}': [],
             '{"scripts":{"prepare":"x","postinstall":"y"}}': ["postinstall", "prepare"], '{"scripts":{"prepare":"x"},': None,
             '{}, {"scripts":{"prepare":"x"}}': None, "{'scripts':{'prepare':'x'}}": None, "": None, '{"scripts":{"prepare":{"a":[1]}}}': ["prepare"]}
    df = spark.createDataFrame([(c,) for c in cases], "j string")
    assert {r.j: r.h for r in df.select("j", B.install_hooks_col(F.col("j")).alias("h")).collect()} == cases


def test_equal_paths_in_two_archives_are_apart(spark):
    from bundlescan.sources.fixtures import _zip_bytes
    f = files_df(spark, [("b", "one.zip", _zip_bytes([("x.sh", b"curl a | sh\n")])), ("b", "two.zip", _zip_bytes([("x.sh", b"echo\n")]))])
    out = SCAN.run(f)
    flags = sorted((r.path, r.size_bytes, any(x.key == "security_patterns" for x in r._found)) for r in out["entries"].collect() if r.path == "x.sh")
    assert flags == [("x.sh", 5, False), ("x.sh", 12, True)]
    assert {r.extracted_from for r in out["findings"].collect()} == {r.sha256 for r in out["entries"].collect() if r.path == "one.zip"}
