"""Ranked lexical search by pipelined term partitioning.

The terms of the queries are dealt to owners by weight, the rarest terms to the first. A pass over
the documents writes the index: for each block of documents (an Arrow batch) and owner, the postings
of the owner's terms. Then bundles of queries go through the owners one after the other: at each
stage the bundles' accumulators, sparse (query, document, score) triples by block, are cogrouped with
the owner's postings of the block, whose integer contributions are added, and passed on.

Between stages the k-th best score so far of each query is a lower bound of its k-th best in the end.
A document that could not reach it even with the largest contributions of all terms to come leaves
the accumulators, and if those terms alone could not reach it, documents new to the query are no
longer taken up. So the common terms, whose postings are long, are added to few documents; no
document that belongs to the result is lost. The last stage hands out each block's k best, and the
best of those are the result.

Memory: queries are taken in parts of QUERY_ROWS or QUERY_BYTES of text, each with an index of its own
(a query is never cut); a task holds the postings of one block and the accumulators of BUNDLE queries over it.

Terms: runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. Defined
results: null or empty texts have no terms; such documents don't count, such queries have no rows.
Every row is a document and every row of queries a query of its own, repeated ids too. Documents
with a null id count and rank after others of their score. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bundlescan.llm.common import prepare, written
from bundlescan.llm.tokens import ALNUM, Words, groups

QUERY_BYTES = 8 << 20
QUERY_ROWS = 20_000
BUNDLE = 128
OWNERS = 4
_TOP = 1_000_000  # above any contribution of a term of weight 1

POSTINGS = "block bigint, ids array<bigint>, sizes binary, term binary, doc binary, tf binary"
INDEX = "owner int, block bigint, ids array<bigint>, term binary, doc binary, gain binary"
BUNDLES = "block bigint, query binary, doc binary, score binary"


class Terms:
    """The queries' terms: sorted hashes, and what tells a term from another of the same hash."""

    def __init__(self, texts: list[str]):
        words = Words(texts, ALNUM)
        raw = [words.data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist())]
        code = dict(zip(raw, words.code.tolist()))
        self.names = sorted(code, key=lambda t: (code[t], t))
        self.codes = np.array([code[t] for t in self.names], np.uint64)
        number = {t: i for i, t in enumerate(self.names)}
        bounds = words.first.tolist()
        self.of = [Counter(number[t] for t in raw[a:b]) for a, b in zip(bounds, bounds[1:])]
        data = b" ".join(self.names)
        size = np.array([len(t) for t in self.names], np.int64)
        end = np.cumsum(size + 1) - 1
        self.marks = _marks(data, end - size, end)
        self.most = max(Counter(self.codes.tolist()).values(), default=0)  # terms of one hash

    def find(self, words: Words) -> np.ndarray:
        """Of each word, the number of the term that it is, or -1."""
        out = np.full(len(words.code), -1, np.int64)
        if not len(self.codes):
            return out
        at = np.searchsorted(self.codes, words.code)
        for _ in range(self.most):
            own = np.flatnonzero((out < 0) & (at < len(self.codes)))
            own = own[self.codes[at[own]] == words.code[own]]
            found = _marks(words.data, words.start[own], words.end[own])
            same = np.logical_and.reduce([a == b[at[own]] for a, b in zip(found, self.marks)])
            for i in np.flatnonzero(same & (found[0] > 16)).tolist():  # the middle of a long word
                w = own[i]
                same[i] = words.data[words.start[w]:words.end[w]] == self.names[at[w]]
            out[own[same]] = at[own[same]]
            at = at + 1
        return out


def _marks(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, first and last eight bytes of words; these are all of a word of up to 16 bytes."""
    held = np.frombuffer(bytes(8) + data + bytes(8), np.uint8)
    size = end - start
    eight = np.lib.stride_tricks.sliding_window_view(held, 8)
    head = np.ascontiguousarray(eight[start + 8]).view("<u8").reshape(-1)
    short = size < 8
    head[short] &= (np.uint64(1) << (size[short] * 8).astype(np.uint64)) - np.uint64(1)
    tail = np.ascontiguousarray(eight[end]).view("<u8").reshape(-1)
    tail[size <= 8] = 0
    return size, head, tail


def _postings(docs: DataFrame, terms: Terms) -> DataFrame:
    """A row for each block of documents: its ids, sizes and the postings of the terms, by term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most QUERY_BYTES of text

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = shared.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes, triples, before = [], [], 0
            for _, texts in groups(batch.column("text").to_pylist()):
                words = Words(texts, ALNUM)
                sizes.append(np.diff(words.first))
                found = own.find(words)
                hit = found >= 0
                key, tf = np.unique(found[hit] << 32 | words.text_of()[hit] + before, return_counts=True)
                triples.append((key, tf))
                before += len(texts)
            key, tf = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*triples)) if triples else (np.empty(0, np.int64),) * 2
            order = np.argsort(key)
            key, tf = key[order], tf[order]
            yield _row(POSTINGS, block, batch.column("doc_id"), np.concatenate(sizes).astype("<u4") if sizes else np.empty(0, "<u4"),
                       (key >> 32).astype("<u4"), (key & 0xFFFFFFFF).astype("<u4"), tf.astype("<u4"))
            block += 1

    return docs.mapInArrow(stage, POSTINGS)


def _row(schema: str, *values) -> pa.RecordBatch:
    """One row: arrays of numpy as bytes, Arrow arrays as a list, whole numbers as they are."""
    out = []
    for (name, kind), v in zip((c.split() for c in schema.split(", ")), values):
        if kind == "binary":
            out.append(pa.array([v.tobytes()], pa.binary()))
        elif kind.startswith("array"):
            out.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
        else:
            out.append(pa.array([v], pa.int32() if kind == "int" else pa.int64()))
    return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in schema.split(", ")])


def _statistics(postings: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and of each query term the documents that hold it."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for sizes, term in zip(batch.column("sizes"), batch.column("term")):
                sizes = np.frombuffer(sizes.as_py(), "<u4").astype(np.int64)
                n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
                df += np.bincount(np.frombuffer(term.as_py(), "<u4"), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[n, total], df[held]]))], ["term", "n"])

    rows = postings.select("sizes", "term").mapInArrow(stage, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist()))  # a row a query term
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(t, 0) for t in range(n_terms)], np.int64)


def _index(postings: DataFrame, owner_of: np.ndarray, n: int, total: int) -> DataFrame:
    """The postings by owner, with what an occurrence gives at weight 1, written by owner."""
    n_owners = int(owner_of.max()) + 1

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, term, doc, tf = (np.frombuffer(batch.column(c)[i].as_py(), "<u4").astype(np.int64) for c in ("sizes", "term", "doc", "tf"))
                norm = 25 + 75 * sizes * n // max(total, 1)
                gain = 1_000_000_000 * tf // (1000 * tf + 8 * norm[doc])
                of = owner_of[term]
                for owner in range(n_owners):
                    own = of == owner
                    if own.any():
                        yield _row(INDEX, owner, batch.column("block")[i].as_py(), batch.column("ids")[i].values, term[own].astype("<u4"),
                                   doc[own].astype("<u4"), gain[own].astype("<u4"))

    return written(postings.mapInArrow(stage, INDEX), "term-owners", ("owner",))


class Plan:
    """What all tasks know of the queries: for each bundle, the queries and weights of each term."""

    def __init__(self, of: list[Counter], weight: np.ndarray, owner_of: np.ndarray, n_owners: int, bundle: int):
        self.bundle = bundle
        self.bundles: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        self.sizes = []
        # the most that the owners from each on can give a query
        self.rest = np.zeros((n_owners + 1, len(of)), np.int64)
        for low in range(0, len(of), bundle):
            by_term: dict[int, list[tuple[int, int]]] = {}
            for q, counts in enumerate(of[low:low + bundle]):
                for t, times in counts.items():
                    by_term.setdefault(t, []).append((q, times * int(weight[t])))
                    self.rest[:owner_of[t] + 1, low + q] += times * int(weight[t]) * _TOP
            self.bundles.append({t: (np.array([q for q, _ in x]), np.array([w for _, w in x], np.int64)) for t, x in by_term.items()})
            self.sizes.append(min(bundle, len(of) - low))


def _advance(plan: Plan, owner: int, least: np.ndarray, held: pa.Table, postings: pa.Table) -> tuple[list, pa.Array | None]:
    """(queries, documents, scores) of each bundle over a block after an owner's stage, and the
    documents' ids."""
    old = [[np.frombuffer(held.column(c)[i].as_py(), k) for c, k in (("query", "<u4"), ("doc", "<u4"), ("score", "<i8"))] for i in range(held.num_rows)]
    query, doc, score = (np.concatenate(x).astype(np.int64) for x in zip(*old)) if old else (np.empty(0, np.int64),) * 3
    term, at, gain = (np.frombuffer(postings.column(c)[0].as_py(), "<u4").astype(np.int64) if postings.num_rows else np.empty(0, np.int64)
                      for c in ("term", "doc", "gain"))
    n_docs = int(max(doc.max(initial=-1), at.max(initial=-1))) + 1
    out = []
    for b, by_term in enumerate(plan.bundles):
        low, size = b * plan.bundle, plan.sizes[b]
        mine = (query >= low) & (query < low + size)
        sums = np.zeros((size, n_docs), np.int64)
        live = np.zeros((size, n_docs), bool)
        sums[query[mine] - low, doc[mine]] = score[mine]
        live[query[mine] - low, doc[mine]] = True
        # a query whose terms to come can reach its bound takes up new documents
        live[plan.rest[owner, low:low + size] >= least[low:low + size]] = True
        wanted = live.any(0)
        own = np.flatnonzero(wanted[at])
        t, d, g = term[own], at[own], gain[own]
        cuts = np.flatnonzero(np.diff(t, prepend=-1))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(t)]):
            pair = by_term.get(int(t[a]))
            if pair is not None:
                sums[np.ix_(pair[0], d[a:z])] += pair[1][:, None] * g[None, a:z]
        keep = live & (sums > 0) & (sums + plan.rest[owner + 1, low:low + size, None] >= least[low:low + size, None])
        q, d = np.nonzero(keep)
        out.append((q + low, d, sums[q, d]))
    ids = postings.column("ids")[0].values if postings.num_rows else None
    return out, ids


def _bounds(bundles: DataFrame, n_queries: int, k: int) -> np.ndarray:
    """Of each query, its k-th best score so far, or 1."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((n_queries, k), np.int64)
        for batch in batches:
            for q, s in zip(batch.column("query"), batch.column("score")):
                q, s = np.frombuffer(q.as_py(), "<u4"), np.frombuffer(s.as_py(), "<i8")
                order = np.lexsort((-s, q))
                q, s = q[order], s[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                top = place < k
                new = np.zeros((n_queries, k), np.int64)
                new[q[top], place[top]] = s[top]
                best = -np.sort(-np.concatenate([best, new], 1), 1)[:, :k]
        some = np.flatnonzero(best[:, 0])
        salt = np.full(len(some), TaskContext.get().partitionId() % 64)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(salt), pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * k, pa.array(best[some].reshape(-1)))],
                                         ["query", "salt", "best"])

    def merged(df: DataFrame, *keys) -> DataFrame:
        return df.groupBy("query", *keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best"))

    parts = bundles.select("query", "score").mapInArrow(stage, "query bigint, salt bigint, best array<bigint>")
    found = merged(merged(parts, "salt")).toArrow()  # k numbers a query
    out = np.ones(n_queries, np.int64)
    for q, best in zip(found.column("query").to_pylist(), found.column("best").to_pylist()):
        out[q] = max(1, best[-1]) if len(best) == k else 1
    return out


def _search(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(query, doc_id, score): every block's k best documents of each query, the result's among them."""
    spark = docs.sparkSession
    terms = Terms(texts)
    postings = written(_postings(docs, terms), "postings")
    n, total, df = _statistics(postings, len(terms.names))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    # owners by descending weight, of like numbers of postings
    order = np.argsort(-weight, kind="stable")
    owner_of = np.zeros(max(1, len(terms.names)), np.int64)
    owner_of[order] = np.minimum(np.cumsum(df[order]) * OWNERS // max(1, int(df.sum()) + 1), OWNERS - 1)
    index = _index(postings, owner_of, n, total)
    plan = spark.sparkContext.broadcast(Plan(terms.of, weight, owner_of, OWNERS, BUNDLE))
    least = np.ones(len(texts), np.int64)
    bundles = spark.createDataFrame([], BUNDLES)
    result = "query bigint, doc_id bigint, score bigint"
    for owner in range(OWNERS):
        last = owner == OWNERS - 1

        own = index.filter(F.col("owner") == owner)
        if last:  # documents' ids come with the last owner's rows, of which a block may have none
            ids = index.groupBy("block").agg(F.any_value("ids").alias("ids"))
            own = ids.join(own.select("block", "term", "doc", "gain"), "block", "left").select(
                "block", "ids", *[F.coalesce(c, F.lit(b"")).alias(c) for c in ("term", "doc", "gain")])
        else:
            own = own.drop("owner")
        bundles = bundles.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_stage(plan, owner, least, k if last else 0), result if last else BUNDLES)
        if not last:
            bundles = written(bundles, "bundles")
            least = _bounds(bundles, len(texts), k)
    return bundles


def _stage(plan, owner: int, least: np.ndarray, k: int):
    """An owner's stage over a block: accumulators as they are passed on, or of the last owner the k
    best documents of each query."""

    def stage(held: pa.Table, postings: pa.Table) -> pa.Table:
        block = (held if held.num_rows else postings).column("block")[0].as_py()
        parts, ids = _advance(plan.value, owner, least, held, postings)
        if not k:
            rows = [_row(BUNDLES, block, a.astype("<u4"), b.astype("<u4"), c.astype("<i8")) for a, b, c in parts if len(a)]
            return pa.Table.from_batches(rows, _schema(BUNDLES)) if rows else _schema(BUNDLES).empty_table()
        q, d, s = (np.concatenate(x) for x in zip(*parts))
        names = ids.take(pa.array(d)) if len(d) else pa.array([], pa.int64())
        null, name = names.is_null().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy()
        by = np.lexsort((name, null, -s, q))
        by = by[np.arange(len(by)) - np.searchsorted(q[by], q[by]) < k]
        return pa.table([pa.array(q[by]), names.take(pa.array(by)), pa.array(s[by])], ["query", "doc_id", "score"])

    return stage


def _schema(text: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in text.split(", "))])


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): each query's k best documents by whole-number BM25, scores
    above 0, equal ones by ascending id. doc_id: a whole number."""
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = queries.select(F.col(f"`{query_id}`"), F.col(f"`{query_text}`").alias("_text"))
    kind = asked.schema[0].dataType.simpleString()
    found, part, size = [], [], 0

    def flush() -> None:
        names = spark.createDataFrame([(i, row[0]) for i, row in enumerate(part)], f"query bigint, `{query_id}` {kind}")
        best = _search(own, [row[1] or "" for row in part], k)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())))
        found.append(ranked.filter(F.col("rank") <= k).join(names, "query").select(f"`{query_id}`", "rank", "doc_id", "score"))

    for row in asked.toLocalIterator():
        more = len((row[1] or "").encode("utf-8", "surrogatepass"))
        if part and (size + more > QUERY_BYTES or len(part) == QUERY_ROWS):
            flush()
            part, size = [], 0
        part.append(row)
        size += more
    if part:
        flush()
    if not found:
        return spark.createDataFrame([], f"`{query_id}` {kind}, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
