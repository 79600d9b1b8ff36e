"""Byte-level BPE encoding and decoding over a rank file.

The distinct new pre-tokens of a batch lie end to end in one doubly linked list of parts; links do
not cross from one to the next. Each merge rank has a bucket of list positions whose part merges
with its successor at that rank, and a hierarchical bitmap over the ranks gives the lowest bucket
that is not empty by find-first-set. An entry is stale, and skipped, if its pair has changed since.
Pre-tokens don't touch each other, so taking ranks in order over all of them merges each as on its
own: lowest rank first, leftmost first. A large bucket is merged by numpy, one entry a pre-token at
a time; a small one entry by entry. The work is in proportion to the merges, not to the square of
a long pre-token's length.

``encode`` adds the ids packed as little-endian unsigned 32-bit integers, ``decode`` the bytes.
A null text encodes as an empty one; null ids decode to no bytes. Other columns stay, except one
that has the name of the new column. Ids outside the vocabulary fail the decoding.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bundlescan.llm.common import prepare, with_columns

_BITS = 256
_SMALL = 12  # entries of a bucket that are merged one by one


class RankQueue:
    """Buckets of positions by rank, each a heap, under a bitmap of two or more levels."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        while not self.levels or n_ranks > 1:
            n_ranks = -(-n_ranks // _BITS)
            self.levels.append([0] * n_ranks)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
        else:
            self.fill(rank, [position])

    def fill(self, rank: int, positions: list[int]) -> None:
        """Positions, as a heap, of a rank that has none."""
        self.buckets[rank] = positions
        for level in self.levels:
            rank, bit = divmod(rank, _BITS)
            was = level[rank]
            level[rank] = was | 1 << bit
            if was:
                break

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank that has entries, and all of them."""
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank * _BITS + (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            at, bit = divmod(at, _BITS)
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        return rank, self.buckets.pop(rank)


class Vocabulary:
    """Byte strings by rank, and the rank at which two of them merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.tokens = np.full(self.size, None, object)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        get, step = self.ranks.get, self.size + 1
        pairs = [(a * step + b, r) for t, r in self.ranks.items() for i in range(1, len(t))
                 if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        self.pairs = dict(pairs)
        keys = np.array(sorted(self.pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.merged = np.append(np.array([self.pairs[k] for k in keys.tolist()], np.int32), np.int32(-1))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs of ids, -1 where they don't merge."""
        key = left.astype(np.int64) * (self.size + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], np.int32(-1))

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, end to end, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, none, step = int(sizes.sum()), self.size, self.size + 1
        own = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        # position n stands for the end of any piece
        ids_, next_, prev_, pair_ = (array("i", bytes(4 * n + 4)) for _ in range(4))
        ids, nxt, prv, pair = (np.frombuffer(x, np.int32) for x in (ids_, next_, prev_, pair_))
        ids[:n] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ids[n] = none
        ends = np.cumsum(sizes)
        nxt[:n] = np.arange(1, n + 1)
        nxt[ends - 1] = n
        prv[:n] = np.arange(-1, n - 1)
        prv[ends - sizes] = n
        pair[:n] = self.rank(ids[:n], ids[nxt[:n]])
        pair[n] = -1
        live = np.ones(n + 1, bool)
        queue, pairs = RankQueue(self.size), self.pairs
        order = np.argsort(pair[:n], kind="stable")
        order = order[np.searchsorted(pair[:n][order], 0):]
        if len(order):
            cut = np.flatnonzero(np.diff(pair[order])) + 1
            for part in np.split(order, cut):
                queue.fill(int(pair[part[0]]), part.tolist())
        while (top := queue.pop()) is not None:
            r, entries = top
            if len(entries) > _SMALL:
                p = np.sort(np.array(entries, np.int32))
                p = p[pair[p] == r]
                if not len(p):
                    continue
                lead = np.append(True, own[p[1:]] != own[p[:-1]])
                if 2 * lead.sum() > len(p):
                    if not lead.all():
                        queue.fill(r, p[~lead].tolist())
                        p = p[lead]
                    gone = nxt[p]
                    stop = nxt[gone]
                    live[gone], pair[gone] = False, -1
                    ids[p], nxt[p] = r, stop
                    prv[stop] = p
                    q = prv[p]
                    new = self.rank(np.concatenate([ids[p], ids[q]]), np.concatenate([ids[stop], ids[p]]))
                    at = np.concatenate([p, q])
                    pair[at], pair[n] = new, -1
                    keep = (new >= 0) & (at != n)
                    for rank, x in zip(new[keep].tolist(), at[keep].tolist()):
                        queue.push(rank, x)
                    continue
            while entries:
                p = heappop(entries)
                if pair_[p] != r:
                    continue
                gone = next_[p]
                stop = next_[gone]
                live[gone], pair_[gone] = False, -1
                ids_[p], next_[p], prev_[stop] = r, stop, p
                new = pair_[p] = pairs.get(r * step + ids_[stop], -1)
                if new >= 0:
                    queue.push(new, p)
                q, early = prev_[p], 0 <= new < r
                if q != n:
                    new = pair_[q] = pairs.get(ids_[q] * step + r, -1)
                    if new >= 0:
                        queue.push(new, q)
                        early |= new < r
                if early and entries:  # something now comes before the other entries
                    queue.fill(r, entries)
                    break
        live[n] = False
        return ids[live].astype("<u4"), np.bincount(own[live[:n]], minlength=len(pieces))


class Index(dict):
    """Numbers keys in the order in which they first come."""

    def __missing__(self, key: str) -> int:
        got = self[key] = len(self)
        return got


class Codec:
    """Encodes batches of texts. Ids of pre-tokens are kept for reuse, and all forgotten once there
    are more than memo of them; that changes no result."""

    def __init__(self, path: str, pattern: str, memo: int = 200_000):
        self.vocabulary = Vocabulary(path)
        self.find = regex.compile(pattern).findall
        self.memo = memo
        self.forget()

    def forget(self) -> None:
        self.index = Index()
        self.ids = np.empty(0, "<u4")
        self.starts = np.zeros(1, np.int64)

    def learn(self) -> None:
        """Ids of the pieces that are new in the index."""
        known = len(self.starts) - 1
        fresh = [p.encode("utf-8") for p in list(self.index)[known:]]
        if not fresh:
            return
        whole = np.fromiter((self.vocabulary.ranks.get(p, -1) for p in fresh), np.int64, len(fresh))
        counts = np.ones(len(fresh), np.int64)
        other = np.flatnonzero(whole < 0)
        got, n = self.vocabulary.merge([fresh[i] for i in other.tolist()]) if len(other) else (np.empty(0, "<u4"), 0)
        counts[other] = n
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(starts[-1], "<u4")
        is_other = np.repeat(whole < 0, counts)
        ids[is_other] = got
        ids[~is_other] = whole[whole >= 0]
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.index) > self.memo:
            self.forget()
        number = self.index.__getitem__
        numbers = [np.fromiter(map(number, self.find(t)), np.int32) if t else None for t in texts]
        self.learn()
        return [b"" if x is None else self._gather(x) for x in numbers]

    def _gather(self, pieces: np.ndarray) -> bytes:
        first = self.starts[pieces]
        size = self.starts[pieces + 1] - first
        stop = np.cumsum(size)
        return self.ids[np.arange(stop[-1]) + np.repeat(first - stop + size, size)].tobytes()

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(self.vocabulary.tokens[np.frombuffer(packed, "<u4")].tolist()) if packed else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids",
           decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df with the packed ids of the column text, and in the column decoded, if it is named, the bytes
    that these ids decode to. path: rank file, at the same place on every node."""
    prepare(df.sparkSession)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = codec(path, pattern)
        packed = own.encode(batch.column(text).to_pylist())
        out = [packed] if decoded is None else [packed, [own.decode(x) for x in packed]]
        return [pa.array(x, pa.binary()) for x in out]

    return with_columns(df, make, f"`{ids}` binary" + (f", `{decoded}` binary" if decoded else ""), keep)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """df with the bytes that the packed ids stand for."""
    prepare(df.sparkSession)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = codec(path, pattern)
        return [pa.array([own.decode(t.as_py()) for t in batch.column(ids)], pa.binary())]

    return with_columns(df, make, f"`{decoded}` binary", keep)
