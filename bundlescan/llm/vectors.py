"""Near-duplicate vectors by an inverted multi-index.

A vector is split into halves, and each half is coded by a codebook of its own (k-means on a bounded
sample), so the two codes name a cell of a product grid. A query visits cells in the order of the
summed distances of its halves to the two centroids, by multi-sequence traversal; how many it visits
is read off a sample of queries whose neighbours are found by brute force: the fewest cells that reach
the target recall, as the mean over queries and as the mean over groups of linked queries. The sample
grows until it holds enough groups. If it does not, each query visits all cells that can hold a vector
of the wanted cosine, and no link is lost. Vectors in the cells visited are verified by their cosine in
double precision.

Only vectors with equal labels and equal lengths are compared. Equal vectors are one entry with a
count. The members of a cell, and the queries that visit it, are cut into blocks, and a block of
members meets a block of queries in one matrix product; pairs never leave it: a link is counted for
the query, and for the member too unless that visits the query's cell itself, and the links of a
block become one star for each of its components.

Defined results: a vector that is null, zero or holds a null or non-finite component, and one with a
null label or id, links with nothing; a null id has no component; rows that repeat an id and vector
count as vectors of their own.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlescan.llm.common import prepare, with_columns, written
from bundlescan.llm.components import components

_ROWS = 1024


def packed(batch: pa.RecordBatch) -> list[pa.Array]:
    """The valid vectors' components as float64 bytes, scaled to length 1, and a digest of the original."""
    units, codes = [], []
    for v in batch.column("vector").to_pylist():
        unit = code = None
        if v and None not in v:
            x = np.array(v, np.float64)
            size = np.sqrt((x * x).sum()) if np.isfinite(x).all() else 0.0
            if 0 < size < np.inf:
                unit = (x / size).tobytes()
                code = xxhash.xxh3_128_digest((x + 0.0).tobytes())
        units.append(unit)
        codes.append(code)
    return [pa.array(units, pa.binary()), pa.array(codes, pa.binary())]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


class Grid:
    """Two codebooks over the halves of a vector of dim components; others are cut or filled with 0."""

    def __init__(self, sample: np.ndarray, size: int, rounds: int = 12):
        self.dim = sample.shape[1]
        self.half = (self.dim + 1) // 2
        self.books = [self._book(part, size, rounds) for part in (sample[:, :self.half], sample[:, self.half:])]
        self.size = len(self.books[0]) * len(self.books[1])

    @staticmethod
    def _book(points: np.ndarray, size: int, rounds: int) -> np.ndarray:
        points = np.unique(points, axis=0)
        centres = points[np.random.default_rng(7).permutation(len(points))[:size]]
        for _ in range(rounds):
            near = ((points ** 2).sum(1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(1)).argmin(1)
            count = np.bincount(near, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, near, points)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        return centres

    def distances(self, units: np.ndarray) -> list[np.ndarray]:
        """Of each half, its squared distances to the centroids."""
        if units.shape[1] != self.dim:
            units = np.pad(units[:, :self.dim], ((0, 0), (0, max(0, self.dim - units.shape[1]))))
        return [((h ** 2).sum(1)[:, None] - 2 * h @ b.T + (b ** 2).sum(1))
                for h, b in zip((units[:, :self.half], units[:, self.half:]), self.books)]

    def cells(self, units: np.ndarray) -> np.ndarray:
        a, b = self.distances(units)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def visits(self, units: np.ndarray, n: int) -> list[list[int]]:
        """The n nearest cells of each vector, by multi-sequence traversal of the two sorted lists."""
        out, width = [], len(self.books[1])
        for a, b in zip(*self.distances(units)):
            oa, ob = a.argsort(kind="stable"), b.argsort(kind="stable")
            a, b = a[oa], b[ob]
            heap, seen, cells = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
            while heap and len(cells) < n:
                _, i, j = heapq.heappop(heap)
                cells.append(int(oa[i]) * width + int(ob[j]))
                for x, y in ((i + 1, j), (i, j + 1)):
                    if x < len(a) and y < len(b) and (x, y) not in seen:
                        seen.add((x, y))
                        heapq.heappush(heap, (a[x] + b[y], x, y))
            out.append(cells)
        return out

    def reach(self, units: np.ndarray, cosine: float) -> list[list[int]]:
        """Of each vector, all cells that can hold one of this cosine with it. A member of a cell is
        nearest to its centroids, so it lies beyond the bisectors between them and all others."""
        least = []
        for d, book in zip(self.distances(units), self.books):
            gap = np.sqrt(((book[:, None] - book[None]) ** 2).sum(2))
            gap[gap == 0] = np.inf
            least.append(np.maximum(((d[:, :, None] - d[:, None, :]) / (2 * gap)).max(2), 0) ** 2)
        near = least[0][:, :, None] + least[1][:, None, :] <= 2 - 2 * cosine + 1e-9
        return [np.flatnonzero(x).tolist() for x in near.reshape(len(units), -1)]


def _sampled(entries: DataFrame, rows: int, seed: str) -> DataFrame:
    """About twice rows entries, spread by a hash of the id (all, if there are fewer)."""
    n = entries.count()
    share = min(1.0, 2.0 * rows / n) if n else 1.0
    return entries.filter(F.xxhash64("rep", F.lit(seed)) / F.lit(float(2 ** 64)) + 0.5 < share)


def calibrate(entries: DataFrame, grid: Grid, cosine: float, recall: float, queries: int, groups: int = 64) -> int | None:
    """The fewest visits that find the share recall of the sampled queries' neighbours. The sample is
    enlarged up to 16 times until its linked queries come to so many groups; None: they do not."""
    n = entries.count()
    for size in (queries, 4 * queries, 16 * queries):
        places = _places(entries, grid, cosine, size)
        if n <= 2 * size or sum(r["group"] for r in places) >= groups:
            return max((_reached([(r["place"], r[c]) for r in places], recall) for c in ("query", "group")), default=1)
    return None


def _reached(places: list[tuple[int, float]], recall: float) -> int:
    total, so_far = sum(w for _, w in places), 0.0
    for place, w in places:
        so_far += w
        if so_far >= recall * total - 1e-9:
            return place + 1
    return 1


def _places(entries: DataFrame, grid: Grid, cosine: float, queries: int) -> list:
    """Of each place in the order of visits, the share of neighbours there: summed over the sampled
    queries that have any, and with those linked to each other weighing 1 together."""
    sample = _sampled(entries, queries, "query").select("label", "dim", "rep", "unit").limit(2 * queries).toPandas()
    held, first = {}, 0
    for key, g in sample.groupby(["label", "dim"]):
        units = np.stack([np.frombuffer(u, np.float64) for u in g["unit"]])
        place = np.empty((len(units), grid.size), np.int32)
        weight = np.empty(len(units))
        for lo in range(0, len(units), _ROWS):
            part = units[lo:lo + _ROWS]
            a, b = grid.distances(part)
            total = (a[:, :, None] + b[:, None, :]).reshape(len(part), -1)
            np.put_along_axis(place[lo:lo + _ROWS], total.argsort(1, kind="stable"), np.arange(grid.size, dtype=np.int32)[None, :], 1)
            weight[lo:lo + _ROWS] = 1 / np.maximum((part @ units.T >= cosine).sum(1), 1)
        held[key] = (first, g["rep"].to_numpy(), units, place, weight)
        first += len(units)
    shared = entries.sparkSession.sparkContext.broadcast(held)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[object, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for key, g in frame.groupby(["label", "dim"]):
                if key in shared.value:
                    _, reps, units, place, _ = shared.value[key]
                    own = np.stack([np.frombuffer(u, np.float64) for u in g["unit"]])
                    ids, cell = g["rep"].to_numpy(), g["cell"].to_numpy()
                    for lo in range(0, len(units), _ROWS):
                        q, m = np.nonzero((units[lo:lo + _ROWS] @ own.T >= cosine) & (reps[lo:lo + _ROWS, None] != ids[None, :]))
                        if len(q):
                            if key not in counts:
                                counts[key] = np.zeros(place.shape, np.int32)
                            np.add.at(counts[key], (lo + q, place[lo + q, cell[m]]), 1)
        for key, count in counts.items():
            start, _, _, _, weight = shared.value[key]
            q, at = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(start + q), pa.array(weight[q]), pa.array(at), pa.array(count[q, at].astype(np.int64))],
                                             ["query", "weight", "place", "n"])

    found = (entries.select("label", "dim", "rep", "unit", "cell").mapInArrow(stage, "query bigint, weight double, place bigint, n bigint")
             .groupBy("query", "weight", "place").agg(F.sum("n").alias("n")))
    found = written(found, "places")
    total = found.groupBy("query").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return (found.join(total, "query").groupBy("place")
            .agg(F.sum(share).alias("query"), F.sum(share * F.col("weight")).alias("group")).orderBy("place").collect())


def _links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, members before queries; gives (rep, n, root): n more links, or (n = 0)
    an edge to root."""
    key, members = None, []
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        blocks = list(zip(*(cols[c].to_pylist() for c in ("label", "dim", "at", "member_block", "query_block"))))
        is_query = np.array(cols["is_query"].to_pylist(), bool)
        for k, run in itertools.groupby(range(len(blocks)), lambda i: (blocks[i], is_query[i])):
            run = list(run)
            part = batch.slice(run[0], len(run))
            if blocks[run[0]] != key:
                key, members, ready = blocks[run[0]], [], None
            if not k[1]:
                members.append(part)
                continue
            if not members:
                continue
            if ready is None:
                every = pa.Table.from_batches(members).combine_chunks()
                visits = [set(v) for v in every["visits"].to_pylist()]
                ready = (every["rep"].to_numpy(), every["mult"].to_numpy(), matrix(every["unit"], key[1]), visits)
            reps, mult, units, visits = ready
            for lo in range(0, len(run), _ROWS):
                q = part.slice(lo, _ROWS)
                ids, weight, cell = (q.column(c).to_numpy() for c in ("rep", "mult", "cell"))
                link = (matrix(q.column("unit"), key[1]) @ units.T >= cosine) & (ids[:, None] != reps[None, :])
                rows = np.flatnonzero(link.any(1))
                if not len(rows):
                    continue
                cols_ = np.flatnonzero(link.any(0))
                link = link[np.ix_(rows, cols_)]
                own_cell = cell[rows]
                seen = np.zeros(link.shape, bool)  # the member visits the query's cell, and counts the link there
                for value in np.unique(own_cell):
                    seen[own_cell == value] = np.fromiter((int(value) in visits[c] for c in cols_.tolist()), bool, len(cols_))
                count_q = link @ mult[cols_]
                count_m = weight[rows] @ (link & ~seen)
                root_q, root_m = ids[rows].copy(), reps[cols_].copy()
                while True:
                    new_m = np.minimum(root_m, np.where(link, root_q[:, None], np.iinfo(np.int64).max).min(0))
                    new_q = np.minimum(root_q, np.where(link, new_m[None, :], np.iinfo(np.int64).max).min(1))
                    if (new_m == root_m).all() and (new_q == root_q).all():
                        break
                    root_q, root_m = new_q, new_m
                rep = np.concatenate([ids[rows], reps[cols_], ids[rows], reps[cols_]])
                n = np.concatenate([count_q, count_m, 0 * count_q, 0 * count_m])
                root = np.concatenate([ids[rows], reps[cols_], root_q, root_m])
                use = (n > 0) | (root != rep)
                yield pa.RecordBatch.from_arrays([pa.array(rep[use]), pa.array(n[use]), pa.array(root[use])], ["rep", "n", "root"])


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    cosine: float = 0.93, recall: float = 0.99, codebook: int = 32, sample_rows: int = 4096,
                    sample_queries: int = 256, block: int = 1024) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id. sample_rows bounds the rows that fit the
    codebooks; the recall is measured on sample_queries first, and on up to 16 times as many."""
    spark = df.sparkSession
    prepare(spark)
    own = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                    F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    rows = (with_columns(own, packed, "unit binary, code binary", ["vec_id", "label"])
            .withColumn("code", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.col("code"))))
    rows = written(rows, "vectors")
    entries = (rows.filter(F.col("code").isNotNull()).groupBy("label", "code")
               .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("unit").alias("unit"))
               .withColumn("dim", (F.length("unit") / 8).cast("int")))
    entries = written(entries, "entries")
    sample = _sampled(entries, sample_rows, "grid").select("dim", "unit").limit(2 * sample_rows).collect()
    if sample:
        dim = max({r["dim"] for r in sample}, key=lambda d: (sum(r["dim"] == d for r in sample), d))
        grid = Grid(np.stack([np.frombuffer(r["unit"], np.float64) for r in sample if r["dim"] == dim]), codebook)
    else:
        grid = Grid(np.zeros((1, 2)), 1)

    def cells(batch: pa.RecordBatch) -> list[pa.Array]:
        out = [0] * batch.num_rows
        for i, (u, d) in enumerate(zip(batch.column("unit").to_pylist(), batch.column("dim").to_pylist())):
            out[i] = int(grid.cells(np.frombuffer(u, np.float64).reshape(1, d))[0])
        return [pa.array(out, pa.int32())]

    entries = with_columns(entries, cells, "cell int")
    n_visits = calibrate(entries, grid, cosine, recall, sample_queries)

    def visits(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for u, d in zip(batch.column("unit").to_pylist(), batch.column("dim").to_pylist()):
            unit = np.frombuffer(u, np.float64).reshape(1, d)
            out.append((grid.reach(unit, cosine) if n_visits is None else grid.visits(unit, n_visits))[0])
        return [pa.array(out, pa.list_(pa.int32()))]

    visited = with_columns(entries, visits, "visits array<int>")
    if n_visits is None:  # most cells may be in reach: successive ones are joined to at least a block of members each
        size = entries.groupBy("label", "dim").agg(F.least(F.lit(grid.size), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("size"))
        at = lambda c: F.floor(c * F.col("size") / grid.size).cast("int")
        visited = (visited.join(size, ["label", "dim"]).withColumn("cell", at(F.col("cell")))
                   .withColumn("visits", F.array_distinct(F.transform("visits", at))).drop("size"))
    entries = written(visited, "entries")
    members = entries.withColumn("at", F.col("cell")).withColumn("is_query", F.lit(False))
    queries = entries.withColumn("at", F.explode("visits")).withColumn("is_query", F.lit(True)).withColumn("visits", F.lit(None).cast("array<int>"))
    place = ["label", "dim", "at"]
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    m_blocks = members.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).select(*place, blocks.alias("m_blocks"))
    q_blocks = (queries.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
                .select(*place, F.ceil(F.col("n") / (4 * block)).cast("int").alias("q_blocks")))
    grids = m_blocks.join(q_blocks, place)
    spread = lambda n: F.pmod(F.xxhash64("rep", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = (members.join(grids, place).withColumn("member_block", spread("m_blocks")).withColumn("query_block", every("q_blocks"))
            .unionByName(queries.join(grids, place).withColumn("query_block", spread("q_blocks")).withColumn("member_block", every("m_blocks"))))
    order = [*place, "member_block", "query_block"]
    found = written(both.select(*order, "is_query", "rep", "mult", "unit", "visits", "cell")
                    .repartition(*order).sortWithinPartitions(*order, "is_query")
                    .mapInArrow(lambda b: _links(b, cosine), "rep bigint, n bigint, root bigint"), "links")
    count = found.filter(F.col("n") > 0).groupBy("rep").agg(F.sum("n").alias("more"))
    roots = components(found.filter(F.col("rep") != F.col("root")), "rep", "root")
    reps = (entries.select("label", "code", "rep", "mult").join(count, "rep", "left")
            .join(roots, F.col("rep") == F.col("node"), "left")
            .select(F.col("label").alias("_label"), F.col("code").alias("_code"),
                    (F.col("mult") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root")))
    return (rows.join(reps, (F.col("label") == F.col("_label")) & (F.col("code") == F.col("_code")), "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("root", "vec_id").alias("component_id")))
