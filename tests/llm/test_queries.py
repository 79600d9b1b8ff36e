"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as E  # noqa: E402
import corpus_pipeline  # noqa: E402
from bundlescan.llm.queries import REGISTRY, tokenizer  # noqa: E402
from test_text_operators import brute_groups, brute_hits, brute_lines  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = E.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.sql(REGISTRY[name][1])
    assert sorted(res.columns) == cols
    want = [tuple(dict(zip(res.columns, r))[c] for c in cols) for r in res.fetchall()]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_stages(spark):
    import tiktoken

    from bundlescan.llm.bpe import Vocabulary
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", None, None), (10**6 + 1, "12 !", None, "s", 4), (None, "Some words that have no number", None, None, 1),
                                   (10**6 + 2, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame((out := stage(spark, docs, SF)).collect(), out.schema)
        rows[name] = (before, docs.collect())
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = rows["language_id"]
    keep = [r for r in before if r.text and any(c.isalpha() for c in r.text)]
    assert sorted(after, key=repr) == sorted(keep, key=repr) and len(keep) == len(before) - 3
    before, after = rows["line_dedup"]
    want = [(i, t) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in before], 40, 5)]
    assert sorted(((r.doc_id, r.text) for r in after), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = rows["ngram_jaccard_join"]
    groups = brute_groups([(r.doc_id, r.text) for r in before if r.doc_id is not None], 80, n=5)
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == [i for i, (_, top) in sorted(groups.items()) if i == top]
    assert sum(r.doc_id is None for r in after) == 1
    before, after = rows["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in before if (h := brute_hits(r.text, items))[1] == 0 or 20 * h[1] < h[0]]
    assert sorted(after, key=repr) == sorted(clean, key=repr)
    before, after = rows["byte_bpe"]
    path, pattern = tokenizer()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=Vocabulary(path).ranks, special_tokens={})
    import hashlib
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        ids = [int.from_bytes(r.token_ids[k:k + 4], "little") for k in range(0, len(r.token_ids), 4)]
        assert ids == other.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
