"""Benchmark decontamination: find and remove passages of benchmark items in documents.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one
window. Windows are hashed into a sorted array that every task holds; a task hashes the windows of
its documents, looks them up, compares the words of each hit, and marks the words inside.

The array is made from at most ``block_bytes`` of item text at once. A larger benchmark is cut into
blocks by a hash of item_id, and the documents pass through one block after the other, written to
the shared folder between them, so a task never holds more than one block.

Defined results: a null or empty text has no words and no hits; a null item text has no windows; a
null item_id counts as an item named by the empty string; repeated items are one item; items of the
same text are all named; columns of the documents that clash with new names give way.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlescan.llm.common import named, prepare, with_columns, written
from bundlescan.llm.tokens import ALNUM, Words, grams, groups

FOUND = "n_words bigint, hit_items array<string>, hit_words array<int>, hit_spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_BITS = 20


class Windows:
    """The windows of some items: their hashes by width, and the words and items behind a hash."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.behind: dict[tuple[int, int], dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        words = Words([text for _, text in items], ALNUM)
        hashes: dict[int, list[np.ndarray]] = defaultdict(list)
        for k, (item, _) in enumerate(items):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if a == b:
                continue
            n = min(width, b - a)
            own = grams(words.code[a:b], n)
            hashes[n].append(own)
            for i, h in enumerate(own.tolist()):
                self.behind[n, h][phrase(words, a + i, n)].add(item)
        self.behind = {k: dict(v) for k, v in self.behind.items()}
        self.hashes = {n: np.unique(np.concatenate(h)) for n, h in hashes.items()}
        self.maybe = {}
        for n, h in self.hashes.items():
            self.maybe[n] = np.zeros(1 << _BITS, bool)
            self.maybe[n][h >> np.uint64(64 - _BITS)] = True

    def hits(self, words: Words) -> list[tuple[int, int, set[str]]]:
        """(first word, number of words, items) of each verified window."""
        found = []
        text = words.text_of()
        for n, own in self.hashes.items():
            h = grams(words.code, n)
            at = np.flatnonzero(self.maybe[n][h >> np.uint64(64 - _BITS)])
            at = at[text[at] == text[at + n - 1]]
            place = np.minimum(np.searchsorted(own, h[at]), len(own) - 1)
            for i in at[own[place] == h[at]].tolist():
                items = self.behind[n, int(h[i])].get(phrase(words, i, n))
                if items:
                    found.append((i, n, items))
        return found


def phrase(words: Words, first: int, n: int) -> bytes:
    return b" ".join(words.data[words.start[first]:words.end[first + n - 1]].split())


def _merged(old: list[dict] | None, new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([*((s["start"], s["end"]) for s in old or ()), *new]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(text: str, windows, earlier: bool) -> Callable:
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = windows.value
        texts = batch.column(text).to_pylist()
        # what earlier blocks found; a document's own columns of these names are none of that
        old = {c: batch.column(c).to_pylist() if earlier else [None] * len(texts) for c in ("hit_items", "_hit_runs")}
        n_words, items, runs, hit_words, spans = [], [], [], [], []
        for first, part in groups(texts):
            words = Words(part, ALNUM)
            by_text: dict[int, list] = defaultdict(list)
            for i, n, found in own.hits(words):
                by_text[bisect_left(words.first, i + 1) - 1].append((i, n, found))
            for k in range(len(part)):
                a, at = int(words.first[k]), int(words.at[k])
                hits = by_text.get(k, ())
                run = _merged(old["_hit_runs"][first + k], [(i - a, i - a + n) for i, n, _ in hits])
                n_words.append(int(words.first[k + 1]) - a)
                items.append(sorted({*(old["hit_items"][first + k] or ()), *(x for *_, found in hits for x in found)}))
                runs.append([{"start": s, "end": e} for s, e in run])
                hit_words.append([i for s, e in run for i in range(s, e)])
                spans.append([{"start": int(words.start[a + s]) - at, "end": int(words.end[a + e - 1]) - at} for s, e in run])
        return [pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())),
                pa.array(hit_words, pa.list_(pa.int32())), pa.array(spans, _SPANS), pa.array(runs, _SPANS)]
    return make


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         width: int = 13, block_bytes: int = 4 << 20, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with n_words; hit_items: the items found, sorted as strings;
    hit_words: the numbers of the words hit; hit_spans: their runs as byte offsets into the UTF-8
    text."""
    spark = docs.sparkSession
    prepare(spark)
    items = (named(benchmark, item, item_text)
             .select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("item_text"))
             .filter(F.col("item_text").isNotNull()))
    size = items.select(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    wanted = docs.columns if keep is None else keep
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], width))
        out = with_columns(out, _scan(text, windows, k > 0), f"{FOUND}, _hit_runs array<struct<start:int,end:int>>",
                           wanted if k == blocks - 1 else None)
        if k < blocks - 1:
            out = written(out, "decontaminate")
    return out.drop("_hit_runs")


def verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """found with n_hit, n_items and contaminated: some word hit, and at least one in share."""
    n_hit = F.size("hit_words").cast("long")
    return (found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("hit_items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """found with the hit spans cut out of the texts; the rest stays byte for byte."""
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for t, spans in zip(batch.column(text).to_pylist(), batch.column("hit_spans").to_pylist()):
            if t and spans:
                raw, cut, at = t.encode("utf-8", "surrogatepass"), [], 0
                for s in spans:
                    cut.append(raw[at:s["start"]])
                    at = s["end"]
                t = b"".join([*cut, raw[at:]]).decode("utf-8", "surrogatepass")
            out.append(t)
        return [pa.array(out, pa.string())]

    kept = found.columns
    return with_columns(found, make, f"`{text}` string").select(*(f"`{c}`" for c in kept))
