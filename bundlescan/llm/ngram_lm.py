"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from sorted arrays.

Counting. Tasks hash the words of their documents with numpy, sort and count them, and send each
shard one packed block of sorted keys and counts, so an exchange moves a few bytes for each distinct
key of a partition. A shard's task merges its blocks and writes sorted arrays as plain files:
  words: the hashes of all tokens and their counts; a token's id is its place over all shards;
  pairs: id * V + next id of all bigrams and their counts; and for each context in the shard its
  count and how many followers it has once, twice and more often;
  after: for each id in a range, how many distinct tokens precede it.
Words are dealt by hash range, bigrams by a hash of their context. Contexts with many tokens are
dealt by a hash of the bigram over all shards, and what the shards know of them is added up at the
driver: at most a few contexts for each shard.

Scoring. Tasks memory-map the arrays and look up the distinct sorted keys of a batch by binary search.

The model, over a document's tokens and one end token, with a start context before the first:
  p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)
  p(w) = max(a(w) - D'(a(w)), 0) / A + g' / (V + 1)
a(w): distinct contexts before w; A: distinct bigrams; D, D': the discounts of Chen and Goodman for
counts 1, 2 and 3 or more (0 to the count, and a fixed 0.5 where the counts of counts give none);
g, g': the mass that the discounts free. A context that was never seen gives p(w); an unknown token
has a(w) = 0. Probabilities of all V tokens and one unknown sum to 1.

Defined results: a null or empty text is the end token alone; a null id is in no training set unless
the given condition says so; without training rows every token has probability 1 / (V + 1) = 1.
Documents that repeat are counted as often as they occur.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlescan.llm.common import mounted, prepare, scratch, with_columns, write_file
from bundlescan.llm.tokens import SPACED, Words, groups, mix

END = np.uint64(0xE0D0E0D0E0D0E0D1)  # the hash of the end token; words are mixed, and collide with it as with any other
_FLUSH = 3_000_000  # keys that a counting task holds before it sorts and sends them
SHARD_KEYS = 4_000_000  # tokens for each shard
_MANY = 255  # counts from here on stand in an array of their own
OUT = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def token_batches(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, token hashes with an end token after each text, first token of each text)."""
    for first, part in groups(texts):
        words = Words(part, SPACED)
        code = np.insert(words.code, words.first[1:], END)
        yield first, code, words.first + np.arange(len(words.first))


def _pack(x: np.ndarray) -> bytes:
    """Sorted or small numbers: differences for the former, by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


BLOCK = "shard int, keys binary, counts binary"
_BLOCK_NAMES = ["shard", "keys", "counts"]


def _blocks(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """One packed block of sorted keys for each shard."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order].astype(np.uint64), shard[order]
    at = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1 if len(shard) else 0))
    ends = [*at[1:].tolist(), len(shard)]
    cols = [[], [], []]
    for a, b in zip(at.tolist(), ends):
        cols[0].append(int(shard[a]))
        cols[1].append(_pack(np.diff(keys[a:b], prepend=np.uint64(0))))
        cols[2].append(_pack(counts[a:b]))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], _BLOCK_NAMES)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[at], np.add.reduceat(count, at) if len(at) else count


def _counted(docs: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray],
             shard_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Packed blocks of the keys that keys_of makes from a batch's tokens and its texts' first tokens."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _blocks(keys, counts, shard_of(keys))

        for batch in batches:
            for _, code, first in token_batches(batch.column("text").to_pylist()):
                held.append(keys_of(code, first))
                n += len(held[-1])
                if n >= _FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return docs.mapInArrow(stage, BLOCK)


def _merged(blocks: DataFrame, shards: int, done: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]],
            schema: str) -> DataFrame:
    """Each shard's blocks brought to one task and merged: done gets (shard, keys, counts)."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, n = None, [], [], 0
        for batch in batches:
            for shard, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shard != now:
                    if keys:
                        yield from done(now, *_summed(keys, counts))
                    now, keys, counts, n = shard, [], [], 0
                keys.append(np.cumsum(_unpack(k), dtype=np.uint64))
                counts.append(_unpack(c))
                n += len(keys[-1])
                if n >= 2 * _FLUSH:
                    both = _summed(keys, counts)
                    keys, counts, n = [both[0]], [both[1]], 0
        if keys:
            yield from done(now, *_summed(keys, counts))

    return blocks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(stage, schema)


def _file(folder: str, name: str, shard: int) -> str:
    return f"{folder}/{name}-{shard:07d}"


def _save(folder: str, name: str, shard: int, x: np.ndarray) -> None:
    write_file(_file(folder, name, shard), iter([np.ascontiguousarray(x).tobytes()]))


_open: dict[str, np.ndarray] = {}


def _mapped(folder: str, name: str, shard: int, dtype: str) -> np.ndarray:
    """A memory-mapped array; a shard without a file is empty. Maps are kept for the worker's life."""
    path = _file(folder, name, shard)
    if path not in _open:
        if len(_open) > 4096:
            _open.clear()
        there = os.path.exists(path) and os.path.getsize(path)
        _open[path] = np.memmap(path, dtype, "r") if there else np.empty(0, dtype)
    return _open[path]


@dataclass
class Model:
    """What a task needs besides the files: sizes, discounts, and the contexts dealt over all shards."""

    folder: str
    word_starts: np.ndarray  # the first id of each word shard, and V
    tokens: int
    pair_shards: int
    after_shards: int
    pair_types: int
    hot: np.ndarray  # ids of the contexts dealt over all shards, sorted
    hot_stats: np.ndarray  # their counts, and followers seen once, twice, more often
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    low_mass: float

    @property
    def types(self) -> int:
        return int(self.word_starts[-1])

    def lookup(self, keys: np.ndarray, shard: np.ndarray, name: str, dtype: str = "<u8") -> tuple[np.ndarray, np.ndarray]:
        """(place in its shard, whether it is there) of keys."""
        place, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
            own = _mapped(self.folder, name, int(shard[part[0]]), dtype)
            if len(own):
                at = np.searchsorted(own, keys[part])
                at = np.minimum(at, len(own) - 1)
                place[part], there[part] = at, own[at] == keys[part]
        return place, there

    def gather(self, name: str, dtype: str, shard: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), dtype)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
            out[part] = _mapped(self.folder, name, int(shard[part[0]]), dtype)[place[part]]
        return out

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of token hashes."""
        shard = _range_shard(codes, len(self.word_starts) - 1)
        place, there = self.lookup(codes, shard, "word")
        ids = np.where(there, self.word_starts[shard] + place, -1)
        counts = np.zeros(len(codes), np.uint64)
        counts[there] = self.gather("word-count", "<u8", shard[there], place[there])
        return ids, counts

    def low(self, ids: np.ndarray) -> np.ndarray:
        """p(w)."""
        before = np.zeros(len(ids), np.int64)
        known = ids >= 0
        per = _range_size(self.types, self.after_shards)
        before[known] = self.gather("after", "<u4", ids[known] // per, ids[known] % per)
        return _discounted(before, self.low_discounts) / max(self.pair_types, 1) + self.low_mass / (self.types + 1)

    def probability(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """p(w | v) for ids of v (V: the start; -1: unknown) and w."""
        low = self.low(ids)
        base = np.uint64(self.types + 1)
        both = (context >= 0) & (ids >= 0)
        keys = np.where(both, context, 0).astype(np.uint64) * base + np.where(both, ids, 0).astype(np.uint64)
        count = np.zeros(len(ids), np.int64)
        if both.any():
            shard = _pair_shard(keys[both], base, self.hot, self.pair_shards)
            place, there = self.lookup(keys[both], shard, "pair")
            at = np.flatnonzero(both)[there]
            count[at] = self.gather("pair-count", "u1", shard[there], place[there])
            many = np.flatnonzero(there)[count[at] == _MANY]
            if len(many):
                where, _ = self.lookup(place[many].astype(np.uint64), shard[many], "pair-many")
                count[at[count[at] == _MANY]] = self.gather("pair-many-count", "<u8", shard[many], where)
        seen, inverse = np.unique(context, return_inverse=True)
        stats = self._context(seen)[inverse]
        total = stats[:, 0]
        mass = stats[:, 1:] @ np.array(self.discounts)
        some = np.maximum(total, 1)
        return np.where(total > 0, _discounted(count, self.discounts) / some + mass / some * low, low)

    def _context(self, ids: np.ndarray) -> np.ndarray:
        """(count, followers seen once, twice, more often) of contexts."""
        out = np.zeros((len(ids), 4))
        at = np.minimum(np.searchsorted(self.hot, ids), max(len(self.hot) - 1, 0))
        hot = self.hot[at] == ids if len(self.hot) else np.zeros(len(ids), bool)
        out[hot] = self.hot_stats[at[hot]] if hot.any() else 0
        rest = np.flatnonzero((ids >= 0) & ~hot)
        if len(rest):
            key = ids[rest].astype(np.uint64)
            shard = (mix(key) % np.uint64(self.pair_shards)).astype(np.int64)
            place, there = self.lookup(key, shard, "context")
            for k in range(4):
                out[rest[there], k] = self.gather(f"context-{k}", "<u4", shard[there], place[there])
        return out


def _range_shard(codes: np.ndarray, shards: int) -> np.ndarray:
    """Hashes dealt by range: the shards in order hold all hashes in order."""
    return ((codes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _range_size(types: int, shards: int) -> int:
    return max(1, -(-types // shards))


def _pair_shard(keys: np.ndarray, base: np.uint64, hot: np.ndarray, shards: int) -> np.ndarray:
    context = keys // base
    by = context
    if len(hot):
        at = np.minimum(np.searchsorted(hot, context.astype(np.int64)), len(hot) - 1)
        by = np.where(hot[at] == context.astype(np.int64), keys, context)
    return (mix(by) % np.uint64(shards)).astype(np.int64)


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    off = np.array([0.0, *d])[np.minimum(count, 3)]
    return np.maximum(count - off, 0)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's, from how many keys have count 1, 2, 3 and 4."""
    if n[0] + 2 * n[1] == 0:
        return (0.5, 0.5, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5
        out.append(min(max(d, 0.0), float(k)) or 0.5)
    return tuple(out)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count the texts of docs into arrays in the shared folder."""
    spark = docs.sparkSession
    prepare(spark)
    folder = mounted(scratch(spark, "ngram-lm"))
    os.makedirs(folder, exist_ok=True)
    own = docs.select(F.col(f"`{text}`").alias("text"))
    size = own.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(size / 6 / SHARD_KEYS))  # about six bytes a token

    hot_share = max(1, SHARD_KEYS // 8)

    def save_words(shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _save(folder, "word", shard, keys)
        _save(folder, "word-count", shard, counts)
        often = np.flatnonzero(counts >= hot_share)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()),
                                          pa.array([often.tolist()], pa.list_(pa.int64()))], ["shard", "types", "tokens", "often"])

    rows = _merged(_counted(own, lambda code, first: code, lambda keys: _range_shard(keys, shards)), shards, save_words,
                   "shard int, types bigint, tokens bigint, often array<bigint>").collect()
    sizes = np.zeros(shards + 1, np.int64)
    for r in rows:
        sizes[r["shard"] + 1] = r["types"]
    starts = np.cumsum(sizes)
    tokens, types = sum(r["tokens"] for r in rows), int(starts[-1])
    # a context's count is its token's count, and the start's the number of documents
    hot = sorted([int(starts[r["shard"]]) + i for r in rows for i in r["often"]])
    hot = np.array([*hot, types], np.int64)  # the start stands before every document
    model = Model(folder, starts, tokens, shards, shards, 0, hot, np.zeros((len(hot), 4)), (0.5,) * 3, (0.5,) * 3, 1.0)
    if not tokens:
        return model
    base = np.uint64(types + 1)

    def pair_keys(code: np.ndarray, first: np.ndarray) -> np.ndarray:
        some, inverse = np.unique(code, return_inverse=True)
        ids = model.words(some)[0][inverse]
        return _contexts(ids, first, types).astype(np.uint64) * base + ids.astype(np.uint64)

    per = _range_size(types, shards)

    def save_pairs(shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _save(folder, "pair", shard, keys)
        _save(folder, "pair-count", shard, np.minimum(counts, _MANY).astype("u1"))
        many = np.flatnonzero(counts >= _MANY)
        _save(folder, "pair-many", shard, many.astype("<u8"))
        _save(folder, "pair-many-count", shard, counts[many])
        context, nxt = keys // base, keys % base
        at = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        stats = np.stack([np.add.reduceat(x.astype(np.uint64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)])
        ids = context[at]
        is_hot = np.isin(ids.astype(np.int64), hot)
        _save(folder, "context", shard, ids[~is_hot])
        for k in range(4):
            _save(folder, f"context-{k}", shard, stats[k][~is_hot].astype("<u4"))  # below hot_share
        followers, before = np.unique(nxt, return_counts=True)
        blocks = _blocks(followers, before, (followers // np.uint64(per)).astype(np.int64))
        n = len(blocks)
        yield pa.RecordBatch.from_arrays([*blocks.columns, *[pa.nulls(n, t) for t in (_LONGS, _LONGS)]], [*_BLOCK_NAMES, "tally", "hot"])
        tally = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)]
        flat = np.concatenate([ids[is_hot].astype(np.int64)[None, :], stats[:, is_hot].astype(np.int64)]).T.reshape(-1).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                                          pa.array([tally], _LONGS), pa.array([flat], _LONGS)], [*_BLOCK_NAMES, "tally", "hot"])

    pairs = _merged(_counted(own, pair_keys, lambda keys: _pair_shard(keys, base, hot, shards)), shards, save_pairs,
                    f"{BLOCK}, tally array<bigint>, hot array<bigint>")
    path = scratch(spark, "ngram-lm-after")
    pairs.write.parquet(path)
    pairs = spark.read.schema(f"{BLOCK}, tally array<bigint>, hot array<bigint>").parquet(path)
    tally = np.zeros(5, np.int64)
    for r in pairs.filter("shard < 0").select("tally", "hot").toLocalIterator():
        tally += np.array(r["tally"])
        part = np.array(r["hot"], np.int64).reshape(-1, 5)
        model.hot_stats[np.searchsorted(hot, part[:, 0])] += part[:, 1:]
    model.discounts, model.pair_types = discounts(tally[:4].tolist()), int(tally[4])

    def save_after(shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = np.zeros(min(per, types - shard * per), "<u4")
        out[(keys - np.uint64(shard * per)).astype(np.int64)] = counts
        _save(folder, "after", shard, out)
        yield pa.RecordBatch.from_arrays([pa.array([int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum())])], ["n"])

    found = _merged(pairs.filter("shard >= 0").select(*_BLOCK_NAMES), shards, save_after, "n bigint").collect()
    n = np.array([r["n"] for r in found]).reshape(-1, 5).sum(0)
    model.low_discounts = discounts(n[:4].tolist())
    d = model.low_discounts
    model.low_mass = float(d[0] * n[0] + d[1] * n[1] + d[2] * n[4]) / model.pair_types
    return model


_LONGS = pa.list_(pa.int64())


def _contexts(ids: np.ndarray, first: np.ndarray, types: int) -> np.ndarray:
    """The token before each, or the start for a text's first."""
    out = np.empty(len(ids), np.int64)
    out[1:] = ids[:-1]
    out[first[:-1]] = types
    return out


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with n_tokens, n_known, train_tokens, base_score (add-one unigram)
    and score, the model's log10 probability of the text. Perplexity: 10 ** (-score / n_tokens)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = shared.value
        base = math.log10(own.tokens + own.types + 1)
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for _, code, first in token_batches(batch.column(text).to_pylist()):
            some, inverse = np.unique(code, return_inverse=True)
            ids, counts = own.words(some)
            ids, counts = ids[inverse], counts[inverse].astype(np.int64)
            context = _contexts(ids, first, own.types)
            pair, back = np.unique((context + 1) * (own.types + 2) + ids + 1, return_inverse=True)
            p = own.probability(pair // (own.types + 2) - 1, pair % (own.types + 2) - 1)
            at = first[:-1]
            cols[0].append(np.diff(first))
            for c, x in zip(cols[1:], ((counts > 0).astype(np.int64), np.log10(counts + 1) - base, np.log10(p)[back])):
                c.append(np.add.reduceat(x, at))
        n, known, low, high = (np.concatenate(c) if c else np.empty(0) for c in cols)
        return [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), own.tokens), pa.int64()),
                pa.array(low, pa.float64()), pa.array(high, pa.float64())]

    return with_columns(docs, make, OUT, keep)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
