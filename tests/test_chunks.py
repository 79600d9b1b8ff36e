"""Embedding data work."""

from pyspark.sql import functions as F

from bundlescan.operators import chunks as C


def test_chunk_geometry(spark):
    text = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(1, text), (2, "short text"), (3, "   ")], "id int, text string")
    got = sorted((r.id, r.chunk, r.start, r.n_tokens) for r in C.token_chunks(df, "id").collect())
    assert got == [(1, 0, 0, 254), (1, 1, 190, 210), (1, 2, 380, 20), (2, 0, 0, 2)]


def test_mean_pool(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "g string, v array<double>")
    got = {(r.g, r.dim): r.value for r in C.mean_pool(df, ["g"], "v").collect()}
    assert got == {("a", 0): 2.0, ("a", 1): 3.0, ("b", 0): 5.0, ("b", 1): 6.0}
    vec = {r.g: r.vector for r in C.as_vectors(C.mean_pool(df, ["g"], "v"), ["g"]).collect()}
    assert vec["a"] == [2.0, 3.0]


def test_embed_text_sums_to_one(spark):
    text = " ".join(f"w{i % 37}" for i in range(700))
    df = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    v = C.embed_text(df, "id")
    assert v.where("id = 2").count() == 0
    assert abs(v.agg(F.sum("value")).first()[0] - 1.0) < 1e-9   # each chunk vector is a distribution


def test_pluggable_encoder(spark):
    import numpy as np
    df = C.token_chunks(spark.createDataFrame([(1, "a b c")], "id int, text string"), "id")

    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])
    out = C.encode_chunks(df, factory).first()
    assert list(out.vector) == [5.0, 1.0]


def test_a_text_that_fails_stands_alone(spark):
    import numpy as np
    df = spark.createDataFrame([(i, "bad" if i in (3, 40) else f"t{i}") for i in range(60)], "id int, chunk_text string")

    def factory():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError("no vector")
            return np.array([[len(t)] for t in texts])
        return model
    out = C.encode_chunks(df.coalesce(1), factory).collect()
    assert {r.id for r in out if r.vector is None} == {3, 40} == {r.id for r in out if r.encode_error == "RuntimeError: no vector"}
    assert all(list(r.vector) == [float(len(r.chunk_text))] for r in out if r.vector)


def test_vectors_of_a_bundles_files(spark):
    from bundlescan.sources import files as S
    f = spark.createDataFrame([("b", "a.md", b"one two"), ("b", "c.bin", b"x"), ("b", "e.txt", b""), ("c", "a.md", b"one")], "bundle_id string, path string, content binary")
    got = {(r.bundle_id, r.path): r.v for r in C.embed_files(S.entries(f)).groupBy("bundle_id", "path").agg(F.sum("value").alias("v")).collect()}
    assert got == {("b", "a.md"): 1.0, ("c", "a.md"): 1.0}
