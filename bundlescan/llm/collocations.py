"""Collocations of each language by the stripes pattern.

A stripe is a prefix of zero, one or two words and an associative counter of the words that follow
it. Tasks count the stripes of some megabytes of text at a time, merge them with their neighbours'
by adding the counters elementwise, and the merged stripes hold all that is asked: a stripe's
entries are the counts of its extensions, which are the totals of the prefixes one word longer, and
the largest of them is what could subsume the prefix.

A phrase occurs no more often than the phrases in it. So the stripes of one word are counted only for
pairs of words that each occur at_least times, and those of two words only for pairs that do. Which
do is told by a bit array of at most FILTER_BITS that tasks hold: it knows every such word or pair,
and what it lets through in error has its exact count tested later. A prefix that holds a large share
of all words is cut into stripes by the next word's hash, so no task holds all of it.

Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words at
spaces and tabs. Defined results: a null text is empty, a null language ``und``; other columns are not
read; repeated rows count each. Counts and products are exact (decimals of 38 digits; counts of up
to 15).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundlescan.llm.common import prepare, release, written
from bundlescan.llm.tokens import _codes, mix

AT_LEAST = 10
SUBSUMED = 50  # percent
BEST = 2000
FILTER_BITS = 1 << 27
CHUNK = 8 << 20  # bytes of text whose stripes a task counts at once
PARTS = 16384  # a prefix's share of all words is cut into so many parts of the whole

#: The bytes of pieces' ends become a line feed, tabs a space.
_TABLE = bytes(10 if i in b".,;:!?\n\v\f\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_END = b"\xff"  # in no UTF-8 text
_M = np.uint64(0x9E3779B97F4A7C15)

STRIPE = "lang string, prefix string, part int, next array<binary>, n array<bigint>"


def _hash(words: pa.Array) -> np.ndarray:
    """A hash of each of some binary values."""
    words = words.cast(pa.large_binary())
    edge = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    out = np.zeros(len(words), np.uint64)
    some = np.flatnonzero(np.diff(edge))
    out[some] = _codes(data, edge[:-1][some], edge[1:][some])
    return out


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in an array of so many."""
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) * _M >> np.uint64(20) & mask


class Known:
    """A bit array that knows each of some hashes, and a few others in error."""

    def __init__(self, bits: int):
        self.bits, self.cells = bits, np.zeros(bits // 64, np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in _places(h, self.bits):
            out &= (self.cells[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _known(stripes: DataFrame, depth: int) -> Known:
    """What the entries of merged stripes are, as words (depth 0) or pairs of words (1)."""
    bits, count = 1 << 16, stripes.count()
    while bits < 16 * count and bits < FILTER_BITS:
        bits *= 2

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, prefix, after = (_hash(batch.column(c).cast(pa.binary())) for c in ("lang", "prefix", "next"))
            h = word_hash(lang, after)
            if depth:
                h = pair_hash(word_hash(lang, prefix), h)
            p = np.unique(np.concatenate(_places(h, bits)))
            cell = (p >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            bit = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(bit.view(np.int64))], ["cell", "bits"])

    cells = stripes.select("lang", "prefix", "next").mapInArrow(stage, "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = Known(bits)
    out.cells[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)  # at most FILTER_BITS
    return out


def word_hash(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(lang * _M + word)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _M + (second ^ np.uint64(0x5555)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, bytes) of some texts of one language at a time."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                held.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                if sizes[lang] >= CHUNK:
                    yield lang, b"\n".join(held.pop(lang))
                    sizes.pop(lang)
        if sum(sizes.values()) >= 2 * CHUNK:  # many languages, each with little
            for lang in list(held):
                yield lang, b"\n".join(held.pop(lang))
            sizes.clear()
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _words(data: bytes) -> tuple[np.ndarray, pa.Array, int]:
    """(numbers, names, end): each word's number, -- end after a piece --, and what the numbers name."""
    data = data.translate(_TABLE).replace(b"\n", b" " + _END + b" ")
    parts = pc.split_pattern(pa.array([data], pa.large_binary()), b" ").flatten().dictionary_encode()
    names = parts.dictionary
    number = parts.indices.to_numpy()
    empty, end = (pc.index(names, pa.scalar(x, names.type)).as_py() for x in (b"", _END))
    return (number[number != empty] if empty >= 0 else number).astype(np.int64), names, end


def _count(depth: int, words: Known | None, pairs: Known | None, cuts: dict[tuple[str, str], int],
           whole: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The stage that counts the stripes of prefixes of depth words. cuts: into how many parts the
    stripe of a language's prefix is cut; whole: those of the empty prefix."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _chunks(batches):
            number, names, end = _words(data)
            size = len(names)
            own = _hash(names)
            if depth == 0:
                n = np.bincount(number, minlength=size)
                if end >= 0:
                    n[end] = 0
                prefix, follow = np.zeros(size, np.int64), np.arange(size)
                prefix, follow, n = prefix[n > 0], follow[n > 0], n[n > 0]
                prefixes = pa.array([b""])
            else:
                of_lang = np.repeat(_hash(pa.array([lang.encode()])), size)
                h = word_hash(of_lang, own)
                often = words.has(h)
                if end >= 0:
                    often[end] = False
                a, b = number[:-1], number[1:]
                both = often[a] & often[b]
                if depth == 1:
                    key, n = np.unique(a[both] * size + b[both], return_counts=True)
                    first, follow = key // size, key % size
                    used, prefix = np.unique(first, return_inverse=True)
                    prefixes = names.take(pa.array(used))
                else:
                    at = np.flatnonzero(both)
                    key, back = np.unique(a[at] * size + b[at], return_inverse=True)
                    often_pair = pairs.has(pair_hash(h[key // size], h[key % size]))
                    pair = np.full(len(a), -1, np.int64)
                    pair[at] = np.where(often_pair[back], back, -1)
                    i = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
                    triple, n = np.unique(pair[i] * size + number[i + 2], return_counts=True)
                    first, follow = triple // size, triple % size
                    used, prefix = np.unique(first, return_inverse=True)
                    prefixes = pc.binary_join_element_wise(names.take(pa.array(key[used] // size)).cast(pa.binary()),
                                                           names.take(pa.array(key[used] % size)).cast(pa.binary()), pa.scalar(b" ", pa.binary()))
            if not len(n):
                continue
            # the parts of a stripe that holds much
            text = prefixes.cast(pa.binary()).to_pylist() if cuts or not depth else []
            many = np.array([whole if not depth else cuts.get((lang, t.decode("utf-8", "surrogatepass")), 1) for t in text] or [1], np.uint64)
            many = many[prefix] if len(text) else np.ones(len(prefix), np.uint64)
            part = (own[follow] >> np.uint64(20)) % many
            order = np.lexsort((follow, part, prefix))
            prefix, part, follow, n = prefix[order], part[order].astype(np.int64), follow[order], n[order]
            edge = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])))
            for low in range(0, len(edge), 50_000):
                e = edge[low:low + 50_001]
                stop = e[50_000] if len(e) > 50_000 else len(n)
                e = e[:50_000]
                offsets = pa.array(np.append(e, stop) - e[0], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(e)), prefixes.take(pa.array(prefix[e])).cast(pa.binary()).cast(pa.string()), pa.array(part[e], pa.int32()),
                    pa.ListArray.from_arrays(offsets, names.take(pa.array(follow[e[0]:stop])).cast(pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(n[e[0]:stop]))], ["lang", "prefix", "part", "next", "n"])

    return stage


def _merged(stripes: DataFrame) -> DataFrame:
    """(lang, prefix, next, f): stripes added up. One exchange brings a stripe's parts together; their
    entries are added there."""
    dealt = stripes.repartition(int(stripes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "prefix", "part")
    entries = dealt.select("lang", "prefix", "part", F.inline(F.arrays_zip("next", "n")))
    return entries.groupBy("lang", "prefix", "part", "next").agg(F.sum("n").alias("f")).select(
        "lang", "prefix", F.col("next").cast("string").alias("next"), "f")


def stripes(docs: DataFrame, at_least: int = AT_LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(stripes, totals): the entries (depth, lang, prefix, next, f) of prefixes of 0 to 2 words that
    occur at_least times, and the number n of word occurrences of each language."""
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    share = spark.sparkContext.broadcast
    whole = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = written(_merged(own.mapInArrow(_count(0, None, None, {}, whole), STRIPE)), "stripes-0")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [words.filter(F.col("f") >= at_least)]
    total = max(1, totals.agg(F.sum("n")).first()[0] or 1)
    known: list = [None, None]
    for depth in (1, 2):
        last = found[-1]
        known[depth - 1] = share(_known(last, depth - 1))  # at most FILTER_BITS
        name = F.col("next") if depth == 1 else F.concat_ws(" ", "prefix", "next")
        # at most PARTS prefixes hold that share each
        cuts = {(r[0], r[1]): min(1024, 1 + r[2] * PARTS // total)
                for r in last.filter(F.col("f") >= F.lit(-(-total // PARTS))).select("lang", name, "f").toLocalIterator()}
        stage = _shared_count(depth, known, share(cuts))
        found.append(written(_merged(own.mapInArrow(stage, STRIPE)).filter(F.col("f") >= at_least), f"stripes-{depth}"))
    whole_table = found[0].withColumn("depth", F.lit(0))
    for depth in (1, 2):
        whole_table = whole_table.unionByName(found[depth].withColumn("depth", F.lit(depth)))
    return whole_table, totals


def _shared_count(depth: int, known: list, cuts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_count over what the tasks share; it is unpacked in the task."""
    held = list(known)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count(depth, *(k.value if k is not None else None for k in held), cuts.value, 1)(batches)
        release()

    return stage


def _score(a: Column, left: Column, right: Column) -> Column:
    """1,000,000 a a / (left right), rounded down."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big(a) * big(a), big(left) * big(right))


def collocations(docs: DataFrame, at_least: int = AT_LEAST, subsumed: int = SUBSUMED, best: int = BEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two or three words."""
    table, totals = stripes(docs, at_least, text, lang)
    at = lambda depth: table.filter(F.col("depth") == depth)
    one = at(0).select("lang", F.col("next").alias("w"), "f")
    two = at(1).select("lang", F.col("prefix").alias("w1"), F.col("next").alias("w2"), "f")
    three = at(2).select("lang", F.split_part("prefix", F.lit(" "), F.lit(1)).alias("w1"), F.split_part("prefix", F.lit(" "), F.lit(2)).alias("w2"),
                         F.col("next").alias("w3"), F.col("f").alias("a"))
    word = lambda name, out: one.select("lang", F.col("w").alias(name), F.col("f").alias(out))
    pair = lambda x, y, out: two.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("f").alias(out))
    # the largest extension to either side
    above = (three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
             .groupBy("lang", "w1", "w2").agg(F.max("a").alias("above")))
    pairs = (two.withColumnRenamed("f", "a").join(above, ["lang", "w1", "w2"], "left")
             .filter(F.col("above").isNull() | (100 * F.col("above") < subsumed * F.col("a")))
             .join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
             .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score")))
    cut = lambda l, r: F.struct(_score(F.col("a"), F.col(l), F.col(r)).alias("score"), F.lit(1 if l == "f1" else 2).alias("k"),
                                F.col(l).alias("l"), F.col(r).alias("r"))
    triples = (three.join(pair("w1", "w2", "f12"), ["lang", "w1", "w2"]).join(pair("w2", "w3", "f23"), ["lang", "w2", "w3"])
               .join(word("w1", "f1"), ["lang", "w1"]).join(word("w3", "f3"), ["lang", "w3"])
               .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut("f1", "f23"), cut("f12", "f3")).alias("c"))
               .select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a language's phrases are ranked in parts first, so that no task sorts all of them
    found = (pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
