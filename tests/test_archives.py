"""Archive expansion: nesting, depth cap, guards, lineage, root rule."""

import io
import tarfile
import zipfile

from bundlescan.operators import archives as A
from pyspark.sql import functions as F
from bundlescan.sources.fixtures import _tar_bytes, _zip_bytes


def files_df(spark, rows):
    return spark.createDataFrame([("b", p, c) for p, c in rows], "bundle_id string, path string, content binary")


def expand(spark, rows, **kw):
    f = files_df(spark, rows)
    return (sorted((r.path, r.depth) for r in A.expand_archives(f, **kw).collect()),
            {(r.path, r.depth): r.status for r in A.archive_status(f, **kw).collect()})


def test_nested_zip_in_tar_gz(spark):
    import gzip
    inner = _zip_bytes([("docs/a.md", b"hello")])
    outer = gzip.compress(_tar_bytes([("inner.zip", inner)]), mtime=0)
    got, st = expand(spark, [("x.tar.gz", outer)])
    assert got == [("docs/a.md", 2), ("inner.zip", 1), ("x.tar.gz", 0)]
    assert st == {("x.tar.gz", 0): "ok", ("inner.zip", 1): "ok"}


def test_depth_cap(spark):
    data = _zip_bytes([("leaf.txt", b"x")])
    for i in range(11):
        data = _zip_bytes([(f"l{i}.zip", data)])
    got, st = expand(spark, [("top.zip", data)])
    depths = dict(got)
    assert max(d for _, d in got) == 10                       # children exist up to depth 10
    assert "leaf.txt" not in depths
    assert "too_deep" in st.values()


def test_guards(spark):
    escape = _zip_bytes([("ok.txt", b"1"), ("../evil.sh", b"2")])
    absolute = _zip_bytes([("/etc/x", b"1")])
    many = _zip_bytes([(f"f{i}", b"") for i in range(10_001)])
    truncated = _zip_bytes([("a.txt", b"abc" * 100)])[:50]
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w") as zf:
        zi = zipfile.ZipInfo("huge.bin")
        zf.writestr(zi, b"x")
    raw = bytearray(big.getvalue())
    # declare a 600 MiB uncompressed size in the central directory (guard reads declared sizes)
    cd = raw.rfind(b"PK\x01\x02")
    raw[cd + 24:cd + 28] = (600 * 1024 * 1024).to_bytes(4, "little")
    bad_tar = io.BytesIO()
    with tarfile.open(fileobj=bad_tar, mode="w") as tf:
        ti = tarfile.TarInfo("ok.txt"); ti.size = 1; tf.addfile(ti, io.BytesIO(b"1"))
        ln = tarfile.TarInfo("link"); ln.type = tarfile.SYMTYPE; ln.linkname = "/etc/passwd"; tf.addfile(ln)
    _, st = expand(spark, [("e.zip", escape), ("abs.zip", absolute), ("m.zip", many), ("t.zip", truncated),
                           ("big.zip", bytes(raw)), ("bad.tar", bad_tar.getvalue()), ("x.7z", b"7z")])
    assert st[("e.zip", 0)] == "escape" and st[("abs.zip", 0)] == "escape"
    assert st[("m.zip", 0)] == "too_many" and st[("t.zip", 0)] == "corrupt"
    assert st[("big.zip", 0)] == "too_big" and st[("bad.tar", 0)] == "escape"
    assert st[("x.7z", 0)] == "unsupported"


def test_failed_tar_yields_no_children(spark):
    bad = io.BytesIO()
    with tarfile.open(fileobj=bad, mode="w") as tf:
        ti = tarfile.TarInfo("first.txt"); ti.size = 1; tf.addfile(ti, io.BytesIO(b"1"))
        ev = tarfile.TarInfo("../up.txt"); ev.size = 1; tf.addfile(ev, io.BytesIO(b"2"))
    got, _ = expand(spark, [("bad.tar", bad.getvalue())])
    assert got == [("bad.tar", 0)]


def test_symlinks_and_duplicates(spark):
    t = _tar_bytes([("a.txt", b"1")], links=[("l.txt", "a.txt")])
    zbuf = io.BytesIO()
    with zipfile.ZipFile(zbuf, "w") as zf:
        zf.writestr("d.txt", b"old")
        zf.writestr("d.txt", b"new")
        link = zipfile.ZipInfo("sym")
        link.external_attr = 0o120777 << 16
        zf.writestr(link, "target.txt")
    f = A.expand_archives(files_df(spark, [("t.tar", t), ("z.zip", zbuf.getvalue())]))
    got = {r.path: bytes(r.content) for r in f.collect() if r.depth == 1}
    assert "l.txt" not in got and got["a.txt"] == b"1"           # tar symlink extracted but not walked
    assert got["d.txt"] == b"new" and got["sym"] == b"target.txt"  # last duplicate wins; zip link = file


def test_lineage_identical_archives(spark):
    z = _zip_bytes([("m.txt", b"x")])
    f = A.expand_archives(files_df(spark, [("a/one.zip", z), ("b/two.zip", z)]))
    lin = A.archive_lineage(f).collect()
    assert len(lin) == 2 and {r.parent_path for r in lin} == {"a/one.zip", "b/two.zip"}


def test_limits_are_parameters(spark):
    data = _zip_bytes([(f"f{i}", b"x") for i in range(5)])
    got, st = expand(spark, [("m.zip", data)], limits=A.Limits(entries=4))
    assert got == [("m.zip", 0)] and st == {("m.zip", 0): "too_many"}
    got, st = expand(spark, [("m.zip", data)], limits=A.Limits(entries=None, total_bytes=None))
    assert len(got) == 6 and st == {("m.zip", 0): "ok"}


def test_root_normalize(spark):
    single = _zip_bytes([("skill/SKILL.md", b"x"), ("skill/run.py", b"y"), ("loose.txt", b"z")])
    with_skill = _zip_bytes([("SKILL.md", b"x"), ("skill/run.py", b"y")])
    empty_folder = _zip_bytes([("skill/SKILL.md", b"x"), ("other/", b"")])
    f = files_df(spark, [("u1.zip", single), ("u2.zip", with_skill), ("u3.zip", empty_folder)])
    got = sorted((r.archive_path, r.path) for r in A.root_normalize(f).collect())
    assert got == [("u1.zip", "SKILL.md"), ("u1.zip", "run.py"), ("u2.zip", "SKILL.md"), ("u2.zip", "skill/run.py"), ("u3.zip", "skill/SKILL.md")]
    from bundlescan.plans import scan as SCAN
    flags = {r.bundle_id: r.has_skill_md for r in SCAN.bundles(A.zip_targets(f)).collect()}
    assert flags == {"b/u1.zip": True, "b/u2.zip": True, "b/u3.zip": False}


def test_listing_tells_what_unpacking_finds(spark):
    from bundlescan.sources.fixtures import _tar_bytes
    deep = _zip_bytes([("a.txt", b"x")])
    for _ in range(3):
        deep = _zip_bytes([("in.zip", deep)])
    link = _tar_bytes([("a", b"x")], [("up", "../../x")])
    cases = {"ok.zip": _zip_bytes([("a", b"x"), ("b/", b"")]), "many.zip": _zip_bytes([(f"f{i}", b"") for i in range(5)]), "big.tar": _tar_bytes([("a", bytes(2000))]),
             "out.zip": _zip_bytes([("../a", b"x")]), "out.tar": link, "cut.zip": deep[:40], "x.rar": b"Rar!", "deep.zip": deep, "none.zip": _zip_bytes([]), "empty.tar": b""}
    f = files_df(spark, list(cases.items()))
    limits = A.Limits(entries=4, total_bytes=1000, depth=2)
    listed = {(r.path, r.depth): r.status for r in A.listing_status(A.archive_listing(f, limits), limits).collect()}
    assert listed == {(r.path, r.depth): r.status for r in A.archive_status(f, limits).collect()}
    assert set(listed.values()) == {"ok", "too_many", "too_big", "escape", "corrupt", "unsupported", "too_deep"}
    rows = {(r.path, r.member): r.size_bytes for r in A.archive_listing(f).where("member is not null and path = 'ok.zip'").collect()}
    assert rows == {("ok.zip", "a"): 1, ("ok.zip", "b/"): 0}


def test_one_pass_gives_members_and_statuses(spark):
    f = files_df(spark, [("a.zip", _zip_bytes([("x", b"1"), ("in.zip", _zip_bytes([("y", b"2")]))])), ("b.zip", b"no"), ("c.md", b"hi")])
    un = A.unpack(f)
    assert sorted(map(tuple, A.statuses(un).collect())) == sorted(map(tuple, A.archive_status(f).collect()))
    key = lambda r: repr(tuple(r))
    assert sorted(A.with_members(f, un).collect(), key=key) == sorted(A.expand_archives(f).collect(), key=key)


def test_seeking_reads_what_unpacking_reads(spark, tmp_path):
    """One zip of many members is read by many tasks; statuses and members are those of the other way."""
    from bundlescan.sources.fixtures import _tar_bytes
    cases = {"many.zip": _zip_bytes([(f"d/f{i}.txt", str(i).encode() * 50) for i in range(800)]), "twice.zip": _zip_bytes([("a", b"1"), ("./a", b"2")]),
             "x.tar": _tar_bytes([("b/c", b"in a tar")]), "cut.zip": _zip_bytes([("a", b"x" * 99)])[:60], "out.zip": _zip_bytes([("../a", b"x")]),
             "both.zip": _zip_bytes([("a", b"x"), ("a/b", b"y")])}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([("b", n, str(tmp_path / n)) for n in cases], "bundle_id string, path string, file string")
    index = A.member_index(paths)
    f = files_df(spark, list(cases.items()))
    assert {(r.path, r.status) for r in index.where("status is not null").collect()} == {(r.path, r.status) for r in A.archive_status(f).collect()}
    found = A.read_members(index, 8)
    want = A.expand_archives(f).where("depth = 1")
    key = lambda r: repr(tuple(r))
    assert sorted(found.collect(), key=key) == sorted(want.collect(), key=key)
    sizes = found.where("parent_path = 'many.zip'").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) <= 250


def test_workers_need_not_have_the_package(tmp_path):
    """Started from another folder, with the package on the driver's path alone: Python workers are
    processes of their own and don't inherit that path."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {repo!r})
from bundlescan.session import get_spark
spark = get_spark("local[1]", **{{"spark.checkpoint.dir": {str(tmp_path)!r}}})
from bundlescan.operators import archives as A
from bundlescan.sources.fixtures import _zip_bytes
f = spark.createDataFrame([("b", "a.zip", _zip_bytes([("x", b"1")]))], "bundle_id string, path string, content binary")
assert A.expand_archives(f).count() == 2
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=240)


def test_frames_are_bounded_by_bytes_and_rows():
    rows = (("b", f"f{i}", bytes(1 << 20), "h", 1, "a.zip") for i in range(30))
    frames = list(A._frames(rows, A.MEMBER))
    assert sum(f.num_rows for f in frames) == 30
    assert max(f.nbytes for f in frames) <= A._FRAME_BYTES + (1 << 20) + 4096
    empty = list(A._frames((("b", str(i), 0, "ok") for i in range(2 * A._FRAME_ROWS + 1)), A.STATUS))
    assert [f.num_rows for f in empty] == [A._FRAME_ROWS, A._FRAME_ROWS, 1]


def test_batches_of_archives_are_bounded_in_any_session(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        A.unpack(files_df(spark, [("a.zip", _zip_bytes([("x", b"1")]))]))
        assert int(spark.conf.get(key)) <= 8 << 20
        spark.conf.set(key, str(1 << 20))
        A.unpack(files_df(spark, [("a.zip", _zip_bytes([("x", b"1")]))]))
        assert int(spark.conf.get(key)) == 1 << 20
    finally:
        spark.conf.set(key, before)


def test_zip_targets_are_unpacked_once(spark):
    one = _zip_bytes([("top/SKILL.md", b"s"), ("top/a/b.txt", b"1"), ("loose.txt", b"2")])
    two = _zip_bytes([("one/a.txt", b"1"), ("two/b.txt", b"2"), ("in.zip", one)])
    flat = _zip_bytes([("SKILL.md", b"s"), ("dir/c.txt", b"3")])
    rows = [("b", "one.zip", one), ("b", "two.zip", two), ("b", "flat.zip", flat), (None, "one.zip", one),
            ("same", "x.zip", one), ("same", "x.zip", one), ("b", "cut.zip", one[:40]), ("b", "t.tar", _tar_bytes([("a/x", b"1")]))]
    out = A.root_normalize(spark.createDataFrame(rows, "bundle_id string, path string, content binary"))
    assert "MapIn" not in out._jdf.queryExecution().toString()  # the unpacked members are read, not made again
    got = sorted((r.bundle_id or "", r.archive_path, r.path, bytes(r.content)) for r in out.collect())
    whole = [("loose.txt", b"2"), ("top/SKILL.md", b"s"), ("top/a/b.txt", b"1")]
    assert got == sorted([("b", "one.zip", "SKILL.md", b"s"), ("b", "one.zip", "a/b.txt", b"1"),
                          ("b", "two.zip", "one/a.txt", b"1"), ("b", "two.zip", "two/b.txt", b"2"), ("b", "two.zip", "in.zip", one),
                          ("b", "flat.zip", "SKILL.md", b"s"), ("b", "flat.zip", "dir/c.txt", b"3"),
                          *[("", "one.zip", *m) for m in whole], *[("same", "x.zip", *m) for m in whole * 2]])
