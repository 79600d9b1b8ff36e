"""Exact Jaccard self-join of documents over word n-grams, returned as components.

A document's set holds the hashes of its distinct n-word shingles. Documents with equal sets are one
class, stood for by the smallest id. Sets are sorted by (how often a shingle occurs, hash); the
counts come from a hashed table of fixed size that covers all documents, so that they only order.
Two sets of the wanted similarity share a shingle among their first n - ceil(t n) + 1: these prefixes
are the index lists, and each entry carries the set's size and the shingle's position.

Index skipping: a list is cut into blocks of similar set sizes; blocks too far apart in size are
never joined, and a block whose sizes and positions leave too little room for the overlap is skipped.

Answer skipping: in each block every set is first compared with one pivot, the smallest id. Sets
linked to one pivot are in one component and need not meet. For sets x, y of different components the
answers of their roots A and B are computed once; Jaccard distance is a metric, so d(A, B) above
1 - t + d(x, A) + d(y, B) rules the pair out, and where it exceeds 1 - t + both radii, all pairs of the two
components are. Only what is left is compared. So no link between components is lost, and a
group of near copies costs a few comparisons a document.

Defined results: a text without words (null, empty, white space) has an empty set and links with
nothing; fewer words than n make one shingle; a null id is in no component; repeated rows are one
document. Texts are compared whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlescan.llm.common import prepare, release, written
from bundlescan.llm.components import components
from bundlescan.llm.tokens import SPACED, Words, grams, groups

_BITS = 22  # of the table of counts
_SLICES = 64
_FILTER_BITS = 20
_EPS = 1e-9


def shingles(words: Words, k: int, n: int) -> np.ndarray:
    """The sorted set of text k."""
    code = words.code[words.first[k]:words.first[k + 1]]
    return np.unique(grams(code, min(n, len(code)))) if len(code) else code


def sets_of(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    for _, part in groups(texts):
        words = Words(part, SPACED)
        for k in range(len(part)):
            yield shingles(words, k, n)


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, f0, f1) of a document, or a slice of a partition's counts."""
    names = ["doc_id", "n", "f0", "f1", "slice", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            size, f0, f1 = [], [], []
            for own in sets_of(batch.column("text").to_pylist(), n):
                if counts is None:
                    counts = np.zeros(1 << _BITS, np.uint32)
                np.add.at(counts, own >> np.uint64(64 - _BITS), 1)
                raw = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                size.append(len(own))
                f0.append(int.from_bytes(raw[:8], "little", signed=True))
                f1.append(int.from_bytes(raw[8:], "little", signed=True))
            m = len(size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (size, f0, f1)), pa.nulls(m, types[4]), pa.nulls(m, types[5])], names)
        if counts is not None:
            squeeze = zstandard.ZstdCompressor(level=1).compress
            blobs = [squeeze(x.tobytes()) for x in np.split(counts, _SLICES)]
            none = [pa.nulls(_SLICES, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(_SLICES), types[4]), pa.array(blobs, types[5])], names)

    return docs.mapInArrow(stage, "doc_id bigint, n bigint, f0 bigint, f1 bigint, slice int, counts binary")


def _order(survey: DataFrame) -> np.ndarray:
    """For each counter a number from 0 to 255 that grows with its count over all documents."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(unsqueeze(raw), np.uint32)
                total[k] = own.astype(np.uint64) + total.get(k, np.uint64(0))
        if total:
            ranks = [np.minimum(255, 8 * np.log2(1 + x.astype(np.float64))).astype(np.uint8).tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], ["slice", "ranks"])

    slices = (survey.filter(F.col("slice").isNotNull()).select("slice", "counts").repartition(_SLICES, "slice")
              .mapInArrow(stage, "slice int, ranks binary").collect())
    out = np.zeros((_SLICES, (1 << _BITS) // _SLICES), np.uint8)
    for r in slices:
        out[r["slice"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.reshape(-1)


def prefix(size: int, t: Fraction) -> int:
    return size - math.ceil(t * size) + 1


def _postings(docs: DataFrame, n: int, t: Fraction, order: np.ndarray) -> DataFrame:
    """(token, doc_id, n, pos) of the prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            out = [[], [], [], []]
            for doc, own in zip(batch.column("doc_id").to_pylist(), sets_of(batch.column("text").to_pylist(), n)):
                if not len(own):
                    continue
                first = prefix(len(own), t)
                key = (rank[own >> np.uint64(64 - _BITS)].astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8))
                if first < len(own):
                    at = np.argpartition(key, first - 1)[:first]
                    at = at[np.lexsort((own[at], key[at]))]
                else:
                    at = np.lexsort((own, key))
                for column, x in zip(out, (own[at].view(np.int64), np.full(first, doc), np.full(first, len(own)), np.arange(first))):
                    column.append(x)
            if out[0]:
                token, doc, size, pos = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(doc, pa.int64()), pa.array(size, pa.int32()), pa.array(pos, pa.int32())],
                                                 ["token", "doc_id", "n", "pos"])
        release()

    return docs.mapInArrow(stage, "token bigint, doc_id bigint, n int, pos int")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ids. Most others go before the exchange, by a table of the
    ids' hash buckets, of which there are at most 1 << _FILTER_BITS; the join that follows is exact."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _FILTER_BITS)).cast("int").alias("bucket")
    near = docs.select("doc_id", "text", bucket).join(F.broadcast(ids.select(bucket).distinct()), "bucket", "left_semi")
    return near.join(ids, "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"])


def _verified(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(lo, hi, both, n_lo, n_hi): the exact overlap of each pair's sets."""
    ids = written(pairs.select(F.explode(F.array("lo", "hi")).alias("doc_id")).distinct(), "ids")
    texts = written(_texts(docs, ids), "texts")
    rows = (pairs.join(texts.select(F.col("doc_id").alias("hi"), F.col("text").alias("text_hi")), "hi")
            .join(texts.select(F.col("doc_id").alias("lo"), F.col("text").alias("text_lo")), "lo")
            .select("lo", "hi", "text_lo", "text_hi"))
    names = ["lo", "hi", "both", "n_lo", "n_hi"]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            out = []
            los, his = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, right in enumerate(sets_of(batch.column(3).to_pylist(), n)):
                if los[i] != last:
                    last, left = los[i], next(sets_of([batch.column(2)[i].as_py()], n))
                out.append((len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right)))
            yield pa.RecordBatch.from_arrays([pa.array(los, pa.int64()), pa.array(his, pa.int64()), *(pa.array(list(c), pa.int64()) for c in zip(*out))], names)
        release()

    return rows.mapInArrow(stage, ", ".join(f"{c} bigint" for c in names))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id. Documents link when 100 * overlap >=
    percent * union."""
    prepare(docs.sparkSession)
    t = Fraction(percent, 100)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    survey = written(_survey(own, n), "shingle-sets")
    sets = survey.filter(F.col("slice").isNull()).select("doc_id", "n", "f0", "f1")
    classes = (sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
               .groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    classes = written(classes, "classes")
    copies = written(sets.join(classes.filter("rep < last"), ["f0", "f1"]).filter(F.col("doc_id") > F.col("rep"))
                     .select("doc_id", "rep").distinct(), "copies")
    postings = written(_postings(own.filter(F.col("doc_id").isNotNull()), n, t, _order(survey)), "prefixes")

    lists = (postings.groupBy("token").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .filter("least < most").select("token"))
    block = F.floor(F.log(F.col("n")) / F.lit(-math.log(percent / 100))).cast("int")
    members = (postings.join(lists, "token").join(copies, "doc_id", "left")
               .select("token", F.coalesce("rep", "doc_id").alias("rep"), "n", (F.col("n") - F.col("pos")).alias("room"), block.alias("block"))
               .distinct())
    members = written(members, "lists")
    # 100 both >= percent (n1 + n2 - both); the overlap is at most the room that either set has left
    fits = lambda n1, n2, r1, r2: ((100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
                                   & ((100 + percent) * F.least(r1, r2) >= percent * (n1 + n2)))

    pivots = members.groupBy("token", "block").agg(F.min(F.struct("rep", "n", "room")).alias("p"))
    pivots = pivots.select("token", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"),
                           F.col("p.rep").alias("pivot"), F.col("p.n").alias("p_n"), F.col("p.room").alias("p_room"))
    first = (members.join(pivots, ["token", "block"]).filter(F.col("rep") != F.col("pivot"))
             .filter(fits(F.col("n"), F.col("p_n"), F.col("room"), F.col("p_room")))
             .select(F.least("rep", "pivot").alias("lo"), F.greatest("rep", "pivot").alias("hi")).distinct())
    distance = 1 - F.col("both") / (F.col("n_lo") + F.col("n_hi") - F.col("both"))
    is_link = 100 * F.col("both") >= percent * (F.col("n_lo") + F.col("n_hi") - F.col("both"))

    def answers(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        return written(_verified(pairs, own, n).withColumn("d", distance).withColumn("link", is_link), "answers")

    known = answers(first)
    roots = components(known.filter("link"), "lo", "hi")

    # the distance of each set to the root of its component
    to_root = roots.filter("node <> root").select(F.col("root").alias("lo"), F.col("node").alias("hi"))
    to_root = written(to_root.join(known.select("lo", "hi", "d"), ["lo", "hi"], "left"), "roots")
    rest = answers(to_root.filter(F.col("d").isNull()).select("lo", "hi"))
    away = to_root.filter(F.col("d").isNotNull()).unionByName(rest.select("lo", "hi", "d"))
    away = away.groupBy("lo", "hi").agg(F.min("d").alias("d"))
    placed = (members.join(away.select(F.col("hi").alias("rep"), F.col("lo").alias("root"), F.col("d").alias("away")), "rep", "left")
              .withColumn("root", F.coalesce("root", "rep")).withColumn("away", F.coalesce("away", F.lit(0.0))))
    placed = written(placed, "placed")
    radius = placed.groupBy("root").agg(F.max("away").alias("radius"))

    # pairs of components that share a list: their roots' distance rules out most
    held = (placed.groupBy("token", "block", "root")
            .agg(F.min("n").alias("n"), F.max("n").alias("n_max"), F.max("room").alias("room")))
    right = held.select("token", "block", *(F.col(c).alias(f"{c}_2") for c in ("root", "n", "n_max", "room")))
    left = held.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    room = ((100 * F.col("n_max") >= percent * F.col("n_2")) & (100 * F.col("n_max_2") >= percent * F.col("n"))
            & ((100 + percent) * F.least("room", "room_2") >= percent * (F.col("n") + F.col("n_2"))))
    shared = written(left.join(right, ["token", "block"]).filter(F.col("root") < F.col("root_2")).filter(room)
                     .select("token", F.col("root").alias("lo"), F.col("root_2").alias("hi")).distinct(), "shared")
    asked = shared.select("lo", "hi").distinct().join(known.select("lo", "hi", "d", "link"), ["lo", "hi"], "left")
    asked = written(asked, "asked")
    new = answers(asked.filter(F.col("d").isNull()).select("lo", "hi"))
    root_answers = asked.filter(F.col("d").isNotNull()).unionByName(new.select("lo", "hi", "d", "link"))
    slack = 1 - percent / 100 + _EPS
    open_ = (root_answers.filter(~F.col("link"))
             .join(radius.select(F.col("root").alias("lo"), F.col("radius").alias("r_lo")), "lo")
             .join(radius.select(F.col("root").alias("hi"), F.col("radius").alias("r_hi")), "hi")
             .filter((F.col("r_lo") + F.col("r_hi") > 0) & (F.col("d") <= slack + F.col("r_lo") + F.col("r_hi")))
             .select("lo", "hi", F.col("d").alias("d_roots"), "r_hi"))
    slots = shared.join(open_, ["lo", "hi"])
    mine = placed.select("token", "rep", "n", "room", F.col("root").alias("lo"), "away")
    other = placed.select("token", *(F.col(c).alias(f"{c}_2") for c in ("rep", "n", "room", "away")), F.col("root").alias("hi"))
    left_pairs = (slots.join(mine, ["token", "lo"]).filter(F.col("d_roots") <= slack + F.col("away") + F.col("r_hi"))
                  .join(other, ["token", "hi"]).filter(F.col("d_roots") <= slack + F.col("away") + F.col("away_2"))
                  .filter(fits(F.col("n"), F.col("n_2"), F.col("room"), F.col("room_2")))
                  .select(F.least("rep", "rep_2").alias("lo"), F.greatest("rep", "rep_2").alias("hi")).distinct())
    last = answers(left_pairs.join(known.select("lo", "hi"), ["lo", "hi"], "left_anti"))

    links = known.filter("link").select("lo", "hi")
    for more in (new, last):
        links = links.unionByName(more.filter("link").select("lo", "hi"))
    final = written(components(links, "lo", "hi"), "components")
    by_class = (classes.join(final, classes["rep"] == final["node"], "left")
                .select(F.col("f0").alias("c0"), F.col("f1").alias("c1"), F.coalesce("root", "rep").alias("component")))
    return (sets.join(by_class, (F.col("f0") == F.col("c0")) & (F.col("f1") == F.col("c1")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
