"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line with ASCII white space stripped from both ends and A-Z lower-cased. Keys of
at least ``min_chars`` code points that are found in at least ``min_docs`` documents lose all their
lines, except in the document with the largest id that holds them.

Documents come in batches, by descending id. The runs are written tables of (hash, documents so far,
largest id), sorted by hash. Each new batch is anti-joined with the settled runs, those of keys that
have reached min_docs: their largest id is known already, and no later batch changes it. The rest of
the batch is added as a run of level 0. Whenever a level holds ``fanout`` runs they are compacted
into one of the next level, and keys that reach min_docs then move to the settled runs. An older
level may still hold a part of such a key, and with it the largest id; so at the end all levels and
the settled runs are compacted into one, and the lines are joined with its keys once.

Defined results: a null or empty text is one empty line; rows with a null id keep their text and
count for no key; rows that repeat an id are one document when documents are counted, and each loses
its lines; other columns stay, except those that clash with new names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlescan.llm.common import prepare, with_columns, written

KEY = ["h0", "h1"]
_HASH = pa.struct([("h0", pa.int64()), ("h1", pa.int64())])


def digest(line: str, min_chars: int) -> tuple[int, int] | None:
    """128 bits for the key of a line, None for keys that are too short to count."""
    key = line.strip(" \t\n\v\f\r")
    if len(key) < min_chars:
        return None
    raw = hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, h0, h1), once for each key of a document."""
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for t in batch.column(text).to_pylist():
            found = {digest(x, min_chars) for x in t.split("\n")} if t else set()
            out.append([{"h0": h[0], "h1": h[1]} for h in found - {None}])
        return [pa.array(out, pa.list_(_HASH))]

    own = docs.filter(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias(text))
    return (with_columns(own, make, "keys array<struct<h0:bigint,h1:bigint>>", ["doc_id"])
            .select("doc_id", F.inline("keys")).distinct())


class Runs:
    """Levels of sorted runs, and the settled runs below them."""

    def __init__(self, min_docs: int, fanout: int):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: DataFrame | None = None

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """The lines whose keys no settled run holds."""
        return lines if self.settled is None else lines.join(self.settled.select(*KEY), KEY, "left_anti")

    def add(self, lines: DataFrame) -> None:
        run = self.unsettled(lines).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        self.levels[0].append(self._write(run))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self.compact(level)

    def compact(self, level: int) -> None:
        """The runs of a level as one run of the next; keys that now have min_docs settle."""
        merged = self._write(self._merge(self.levels[level]))
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self._settle(merged.filter(F.col("n") >= self.min_docs))
        self.levels[level + 1].append(merged.filter(F.col("n") < self.min_docs))

    def finish(self) -> DataFrame:
        """All runs compacted: (h0, h1, n, top) of the keys that min_docs documents hold."""
        runs = [r for level in self.levels for r in level] + ([] if self.settled is None else [self.settled])
        return self._write(self._merge(runs).filter(F.col("n") >= self.min_docs).select(*KEY, "n", "top"))

    def _settle(self, run: DataFrame) -> None:
        self.settled = run if self.settled is None else self.settled.unionByName(run)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        return every.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    @staticmethod
    def _write(run: DataFrame) -> DataFrame:
        return written(run.sortWithinPartitions(*KEY), "line-run")


def repeated_keys(lines: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(h0, h1, n, top): keys in at least min_docs documents, with their number and the largest id."""
    edges = lines.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    edges = sorted(set(edges))
    runs = Runs(min_docs, fanout)
    bounds = [None, *edges, None]
    for lo, hi in reversed(list(zip(bounds, bounds[1:]))):
        part = lines
        if lo is not None:
            part = part.filter(F.col("doc_id") > lo)
        if hi is not None:
            part = part.filter(F.col("doc_id") <= hi)
        runs.add(part)
    return runs.finish()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
          batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with the text that is left, n_lines (before) and n_dropped. doc_id: a whole number."""
    prepare(docs.sparkSession)
    lines = written(line_hashes(docs, doc_id, text, min_chars), "lines")
    keys = repeated_keys(lines, min_docs, batches, fanout)
    # keys that each hold a thousandth of all lines are a thousand at most: they go to the lines, not
    # the lines to them
    often = F.col("n") >= F.lit(lines.count() / 1000)
    hot = F.broadcast(keys.filter(often))
    found = (lines.join(hot, KEY).unionByName(lines.join(hot.select(*KEY), KEY, "left_anti").join(keys.filter(~often), KEY)))
    drop = (found.filter(F.col("doc_id") < F.col("top"))
            .groupBy(F.col("doc_id").alias("_drop_id")).agg(F.collect_list(F.struct(*KEY)).alias("_drop")))
    joined = docs.join(drop, docs[f"`{doc_id}`"] == drop["_drop_id"], "left").drop("_drop_id")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, n_lines, n_dropped = [], [], []
        for t, keys_ in zip(batch.column(text).to_pylist(), batch.column("_drop").to_pylist()):
            t = t or ""
            gone = 0
            n_lines.append(t.count("\n") + 1)
            if keys_:
                out = {(k["h0"], k["h1"]) for k in keys_}
                split = t.split("\n")
                left = [x for x in split if digest(x, min_chars) not in out]
                gone, t = len(split) - len(left), "\n".join(left)
            texts.append(t)
            n_dropped.append(gone)
        return [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

    kept = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    out = with_columns(joined, make, f"`{text}` string, n_lines bigint, n_dropped bigint", kept)
    order = [*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped"]
    return out.select(*(f"`{c}`" for c in order))
