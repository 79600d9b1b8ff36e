"""Simple-8b files of token ids: codec, encoder and files against plain forms."""

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from bundlescan.llm import packed_ids as K
from hypothesis import given, settings
from hypothesis import strategies as st


def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300),
       st.integers(1, 40), st.integers(0, 200), st.data())
def test_any_range_comes_back(values, block, zeros, data):
    ids = np.array(values[:20] + [0] * zeros + values[20:], np.uint64)
    packed = K.pack(ids, block)
    low = data.draw(st.integers(0, len(ids)))
    high = data.draw(st.integers(low, len(ids)))
    assert (K.unpack(*packed, len(ids), block) == ids).all()
    assert (K.unpack(*packed, len(ids), block, low, high) == ids[low:high]).all()


def test_words_are_full():
    """Four ids of 15 bits a word, 120 zeros a word, and an entry for what 60 bits don't hold."""
    words, _, escapes = K.pack(np.full(1000, 30000, np.uint64))
    assert len(words) == 250 and not len(escapes)
    assert len(K.pack(np.zeros(960, np.uint64))[0]) == 8
    words, _, escapes = K.pack(np.array([2**60 - 1, 2**60, 5], np.uint64))
    assert len(words) == 3 and escapes.tolist() == [2**60]


def test_encoder_equals_the_library():
    random.seed(3)
    signs = [" ", "  ", "\n", "a", "Bc", "'s", "'", ".", ",", "é", "<|endoftext|>", "1", "\t", "\xa0", "\x85", "\x1c", "语", "́", "'ll", "​"]
    texts = ["", " ", "a  b", "x\n\n  y ", "trail ", "it's 'quoted', don't", "a<|endoftext|>b. c", None, "日本 語。 text", "re.\nWord next", "a " * 5000]
    texts += ["".join(random.choices(signs, k=random.randint(1, 25))) for _ in range(4000)]
    own = K.Encoder(tokenizer(), memo=500)
    for k in range(0, len(texts), 700):
        part = texts[k:k + 700]
        for t, got in zip(part, own(pa.array(part, pa.string()))):
            assert got.tolist() == own.plain.encode(t or "", add_special_tokens=False).ids


def test_texts_in_pieces(monkeypatch):
    """Chunks, pieces of them, null and loose texts anywhere: each text has its own ids."""
    monkeypatch.setattr(K, "PIECE_BYTES", 40)
    random.seed(4)
    signs = [" ", "  ", "\n", "word", "Other", "...", "é", "12", "\t"]
    texts = [None if random.random() < 0.1 else "".join(random.choices(signs, k=random.randint(0, 30))) for _ in range(300)]
    own = K.Encoder(tokenizer())
    for chunks in ([texts], [[], texts[:7], texts[7:7], texts[7:]]):
        got = own(pa.chunked_array([pa.array(c, pa.string()) for c in chunks], pa.string()))
        assert [g.tolist() for g in got] == [own.plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own(pa.chunked_array([], pa.string())) == []


def test_words_that_come_again_are_encoded_once():
    """A full memo forgets what came once, not the words of every text."""
    class Counted:
        def __init__(self, of):
            self.of, self.words = of, []

        def encode_batch_fast(self, texts, **kind):
            self.words += [w for t in texts for w in t.split()]
            return self.of.encode_batch_fast(texts, **kind)

    own = K.Encoder(tokenizer(), memo=300)
    plain, own.plain, own.divided = own.plain, Counted(own.plain), Counted(own.divided)
    common = [f"often{'a' * k}x" for k in range(100)]
    for k in range(20):
        rare = [f"rare{k}n{i}" for i in range(150)]
        text = "start " + " ".join(common + rare)
        assert own(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sum(w.startswith("often") for w in own.plain.words) == len(common)
    assert len(own.words) <= 300 + 250


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers
    own = K.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not own.parts
    assert own(pa.array(["Some  words", None]))[0].tolist() == own.plain.encode("Some  words", add_special_tokens=False).ids


@pytest.mark.parametrize("rows", [[], [(3, "one two"), (1, None), (None, "no number"), (2, ""), (3, "one two"), (3, "other"), (-5, "x " * 30000)],
                                  [(7, "same")] * 50])
def test_files_round_trip(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(K, "PART_BYTES", 20000)
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id int, text string, start string, file int")
    manifest = K.write(df, str(tmp_path / "ids"), tokenizer(), end_id=0)
    out = K.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    plain = K.Encoder(tokenizer()).plain
    ids = {t: plain.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows}
    assert sorted([(r.doc_id, np.frombuffer(r.token_ids, "<u4").tolist()) for r in out], key=repr) == sorted([(d, ids[t]) for d, t in rows], key=repr)
    assert [r.doc_id for r in out] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    before = 0
    for r in out:
        assert r.start == before and r.n_tokens == len(r.token_ids) // 4
        before += r.n_tokens
    assert manifest.count() == len(glob.glob(f"{tmp_path}/ids/*.ids8b"))


def test_query_equals_the_library(spark):
    from bundlescan.llm.queries import op11_packed_ids
    sf = "/root/testdata/sf0.001"
    out = sorted(op11_packed_ids(spark, sf).collect(), key=lambda r: r.doc_id)
    plain, before = K.Encoder(tokenizer()).plain, 0
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in out] == [d.doc_id for d in docs]
    for r, d in zip(out, docs):
        ids = np.array(plain.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
