"""Nearest neighbours by largest inner product, over learned partitions.

Vectors get one more component that makes their norms equal, so that the largest inner product is the smallest distance. On a sample of at
most SAMPLE distinct vectors, the driver makes the graph of nearest neighbours and cuts it into balanced parts: each part is halved
at the median of the graph's second eigenvector, and pairs of nodes change sides while that cuts fewer edges. A softmax
classifier learns where the neighbours of a vector are. Every row goes to its most probable part; a query goes to its most
probable parts until their probabilities add up to a level, and gets exact scores there.

The level is measured and not guessed: for CALIBRATED queries the neighbours are found by brute force over all rows, and the
level is the least at which TARGET of them lie in searched parts.

Work is dealt in cells: a block of a part's rows and a block of the queries sent there, both of bounded size. Equal vectors are searched for, and searched, once; of
their ids the K + 1 smallest are kept, as no other can be among a query's K nearest. So a vector that a third of the rows hold costs what any other does.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; shorter vectors count as having zeros at
the end; equal rows of an id count once, and different vectors of an id are rows of their own, but never neighbours of their id;
a null id is a candidate, behind others of its score, and no query; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, read, written

K, EVERY = 20, 20
#: Distinct vectors that the graph and the classifier are fitted to, at most; of these, so many make a part.
SAMPLE, PER_PART = 8192, 128
#: Queries whose neighbours are found by brute force, and the share of them that the searched parts must hold.
CALIBRATED, TARGET = 256, 0.97
#: Rows and queries of a cell.
ROWS, QUERIES = 8192, 8192
#: Edges of a vector in the graph.
EDGES = 16
#: Queries whose scores are held at once.
TILE = 256


class Router(NamedTuple):
    """A classifier of vectors to parts: scores are x @ weights + bias; norm: the largest of the data."""

    weights: np.ndarray
    bias: np.ndarray
    norm: float

    @property
    def parts(self) -> int:
        return len(self.bias)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.weights + self.bias
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Arrow lists as rows of doubles, with zeros at the end of short ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows of equal length: divided by the largest norm, and what is missing to one as a further component."""
    x = x / norm
    return np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))]


def aimed(x: np.ndarray) -> np.ndarray:
    """Queries: their direction, without a share in the further component."""
    return np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]


# --- fitting, on the driver, to the sample ---


def graph(x: np.ndarray, edges: int = EDGES) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of each vector's edges to its nearest ones."""
    edges = min(edges, len(x) - 1)
    to = np.empty((len(x), edges), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        to[i : i + 512] = np.argpartition(s, -edges, axis=1)[:, -edges:]
    a, b = np.repeat(np.arange(len(x)), edges), to.ravel()
    return np.r_[a, b], np.r_[b, a]


def halves(label: np.ndarray, value: np.ndarray, parts: int) -> np.ndarray:
    """Whether each node is in the upper half of its part by value."""
    order = np.lexsort((value, label))
    size = np.bincount(label, minlength=parts)
    place = np.empty(len(label), np.int64)
    place[order] = np.arange(len(label)) - np.repeat(np.cumsum(size) - size, size)
    return place >= (size[label] + 1) // 2


def balanced(a: np.ndarray, b: np.ndarray, n: int, levels: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of nodes 0..n-1, of 2 ** levels, that few of the edges a-b cross: all parts are halved at once, level by level."""
    label = np.zeros(n, np.int64)
    for level in range(levels):
        parts = 1 << level
        inside = label[a] == label[b]
        x, y = a[inside], b[inside]
        degree = np.maximum(np.bincount(x, minlength=n), 1)
        value = rng.standard_normal(n)
        size = np.maximum(np.bincount(label, minlength=parts), 1)
        for _ in range(60):
            value = value + np.bincount(x, weights=value[y], minlength=n) / degree
            value -= (np.bincount(label, weights=value, minlength=parts) / size)[label]
            value /= np.sqrt(np.bincount(label, weights=value * value, minlength=parts) / size + 1e-300)[label]
        side = halves(label, value, parts)
        for _ in range(8):
            # What a node gains by changing sides; the best of both sides change in pairs, so the halves stay equal.
            across = np.bincount(x, weights=np.where(side[x] != side[y], 1.0, -1.0), minlength=n)
            group = 2 * label + side
            order = np.lexsort((-across, group))
            size2 = np.bincount(group, minlength=2 * parts)
            place = np.empty(n, np.int64)
            place[order] = np.arange(n) - np.repeat(np.cumsum(size2) - size2, size2)
            best = np.full((2 * parts, place.max() + 1), -np.inf)
            best[group, place] = across
            pair = best[0::2] + best[1::2] > 2
            moves = pair[label, place] & (rng.random((parts, pair.shape[1])) < 0.7)[label, place]
            if not moves.any():
                break
            side = side ^ moves
        label = 2 * label + side
    return label


def classifier(x: np.ndarray, share: np.ndarray, norm: float, steps: int = 150) -> Router:
    """Softmax regression of the shares of parts, by Adam."""
    w, first, second = np.zeros((x.shape[1] + 1, share.shape[1])), 0.0, 0.0
    x1 = np.c_[x, np.ones(len(x))]
    for t in range(1, steps + 1):
        s = x1 @ w
        e = np.exp(s - s.max(axis=1, keepdims=True))
        g = x1.T @ (e / e.sum(axis=1, keepdims=True) - share) / len(x) + 1e-6 * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - 0.3 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return Router(w[:-1], w[-1], norm)


def fitted(x: np.ndarray, norm: float, per_part: int = PER_PART) -> Router:
    """A router fitted to a sample of lifted vectors."""
    levels = max(0, int(np.log2(max(1, len(x) / per_part))))
    if not levels:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), norm)
    a, b = graph(x)
    label = balanced(a, b, len(x), levels, np.random.default_rng(7))
    share = np.zeros((len(x), 1 << levels))
    np.add.at(share, (a, label[b]), 1.0)
    share[np.arange(len(x)), label] += 1
    return classifier(x, share / share.sum(axis=1, keepdims=True), norm)


# --- the index ---


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, equal ones once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return rows.dropDuplicates(["vec_id", "v"])


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(nr, v, ids): the distinct vectors, each with its k smallest ids in order; tasks keep no more than these of a vector before the exchange."""
    by = W.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"))
    first = rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
    out = first.groupBy("v").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    return out.select(F.monotonically_increasing_id().alias("nr"), "v", "ids")


def some(df: DataFrame, n: int, dims: int, seed: int) -> np.ndarray:
    """At most n of the distinct vectors of df, in the order of a hash."""
    return matrix(df.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(n).select("v").toArrow().column("v"), dims)


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, components added from the first to the last, so that equal vectors have equal scores wherever they are."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


def best(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs that can be among the k best of a query."""
    qs, rs = [], []
    slack = 1e-12 * np.abs(rows).sum(axis=1).max(initial=0)
    for i in range(0, len(queries), TILE):
        q = queries[i : i + TILE]
        s = q @ rows.T
        if len(rows) > k:
            least = np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k] - slack * np.abs(q).max(axis=1)
            a, b = np.nonzero(s >= least[:, None])
        else:
            a, b = (m.ravel() for m in np.indices(s.shape))
        qs.append(a + i)
        rs.append(b)
    q, r = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (qs, rs))
    return q, r, dot(queries[q], rows[r])


def first_of(group: np.ndarray, k: int) -> np.ndarray:
    """Which of the rows, sorted by group, are among the first k of theirs."""
    new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.empty(0, bool)
    start = np.flatnonzero(new)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < k


def calibrated(index: DataFrame, router: Router, queries: np.ndarray, dims: int, k: int, target: float) -> tuple[float, float]:
    """(level, recall): the least sum of probabilities before a part at which the searched parts hold `target` of the true neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dims)
            q, r, s = best(queries, x, k + 1)
            copies, part = b.column("copies").to_numpy(), b.column("part").to_numpy()
            yield pa.record_batch([pa.array(q), pa.array(s), pa.array(copies[r]), pa.array(part[r])], names=["q", "score", "copies", "part"])

    near = index.select("v", "part", F.size("ids").cast("long").alias("copies")).mapInArrow(run, "q long, score double, copies long, part int")
    near = near.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "part"))).where(F.col("place") <= k + 1)
    found = near.orderBy("q", "place").toArrow()  # at most CALIBRATED * (k + 1) rows
    q, copies, part = (found.column(c).to_numpy() for c in ("q", "copies", "part"))
    p = router.probabilities(aimed(queries))
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.empty_like(p)
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1), axis=1)
    so_far = np.cumsum(copies) - copies
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    so_far -= np.repeat(so_far[start], np.diff(np.r_[start, len(q)]))
    weight = np.clip(k + 1 - so_far, 0, copies)
    need, by = before[q, part], None
    by = np.argsort(need, kind="stable")
    share = np.cumsum(weight[by]) / weight.sum()
    at = min(int(np.searchsorted(share, target)), len(by) - 1)
    level = float(need[by][at])
    return level, float(weight[need <= level].sum() / weight.sum())


class Index(NamedTuple):
    """rows: nr, v, ids, part, chunk, written. sizes: ids that each part holds, up to k + 1 of a vector. level, recall: see calibrated."""

    rows: DataFrame
    router: Router
    chunks: np.ndarray
    sizes: np.ndarray
    level: float
    recall: float
    dims: int


def indexed(rows: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, per_part: int = PER_PART, target: float = TARGET, chunk: int = ROWS) -> Index | None:
    """The index of rows (vec_id, v); queries: the distinct ones (qn, v), written."""
    all_rows = written(distinct(rows, k + 1), "ann-distinct")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = all_rows.agg(F.max(F.size("v")).alias("dims"), F.max(norm2).alias("norm2")).first()
    if not stats["dims"]:
        return None
    dims, norm = stats["dims"], float(np.sqrt(stats["norm2"]))
    router = fitted(lifted(some(all_rows, sample, dims, 1), norm), norm, per_part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.probabilities(lifted(matrix(b.column("v"), dims), norm)).argmax(axis=1)
            yield b.append_column("part", pa.array(part.astype(np.int32)))

    parted = written(all_rows.mapInArrow(run, "nr long, v array<double>, ids array<bigint>, part int"), "ann-parts")
    counts = parted.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()  # a row per part
    chunks, sizes = np.zeros(router.parts, np.int64), np.zeros(router.parts, np.int64)
    for r in counts:
        chunks[r["part"]], sizes[r["part"]] = -(-r["n"] // chunk), r["ids"]
    level, recall = 1.0, 1.0
    if router.parts > 1 and len(held := some(queries, CALIBRATED, dims, 2)):
        level, recall = calibrated(parted, router, held, dims, k, target)
    return Index(parted, router, chunks, sizes, level, recall, dims)


def routed(queries: DataFrame, index: Index, k: int = K) -> DataFrame:
    """(qn, v, part): each query at the parts it searches, the most probable ones up to the level, and more while they hold too few ids."""
    router, sizes, dims, level = index.router, index.sizes, index.dims, index.level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dims)
            for i in range(0, len(x), TILE):
                p = router.probabilities(aimed(x[i : i + TILE]))
                order = np.argsort(-p, axis=1, kind="stable")
                sorted_p = np.take_along_axis(p, order, axis=1)
                near, held = np.cumsum(sorted_p, axis=1) - sorted_p, sizes[order]
                few = np.cumsum(held, axis=1) - held < 2 * (k + 1)
                q, at = np.nonzero(((near <= level) | few) & (held > 0))
                rows = b.slice(i, TILE).take(pa.array(q))
                yield rows.append_column("part", pa.array(order[q, at].astype(np.int32)))

    return queries.select("qn", "v").mapInArrow(run, "qn long, v array<double>, part int")


def cell(rows: pa.Table, dims: int, k: int) -> pa.Table:
    """The k best ids in a cell for each of its queries. rows: qn (null: a row of the index), v, ids."""
    asks = rows.column("qn").combine_chunks().is_valid()
    queries, rows = rows.filter(asks), rows.filter(pa.compute.invert(asks))
    ids = rows.column("ids").combine_chunks()
    size, all_ids = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten()
    start, number = np.cumsum(size) - size, all_ids.fill_null(0).to_numpy()
    nameless = all_ids.is_null().to_numpy(zero_copy_only=False)
    x, qs = matrix(rows.column("v"), dims), matrix(queries.column("v"), dims)
    qn, out = queries.column("qn").to_numpy(), []
    for i in range(0, len(qs), TILE):
        q, r, s = best(qs[i : i + TILE], x, k)
        n = size[r]
        at = np.repeat(start[r] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        q, s = np.repeat(q, n), np.repeat(s, n)
        order = np.lexsort((number[at], nameless[at], -s, q))
        order = order[first_of(q[order], k)]
        out.append((qn[i + q[order]], s[order], number[at[order]], nameless[at[order]]))
    q, s, i, none = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, bool))
    return pa.table({"qn": pa.array(q, pa.int64()), "score": pa.array(s, pa.float64()), "vec_id": pa.array(i, pa.int64(), mask=none)})


def searched(queries: DataFrame, index: Index, k: int = K, block: int = QUERIES) -> DataFrame:
    """(qn, found): the k best (score, vec_id) of the searched parts for each of the queries (qn, v), best first."""
    dims = index.dims
    blocks = -(-queries.count() // block)
    asks = routed(queries, index, k)
    chunks = F.element_at(F.lit([int(c) for c in index.chunks]), F.col("part") + 1)
    asks = asks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).withColumn("block", F.pmod(F.xxhash64("qn"), F.lit(blocks)))
    rows = index.rows.withColumn("chunk", F.pmod(F.xxhash64("nr"), chunks)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    both = asks.select("part", "chunk", "block", "qn", "v", F.lit(None).cast("array<bigint>").alias("ids"))
    both = both.unionByName(rows.select("part", "chunk", "block", F.lit(None).cast("long").alias("qn"), "v", "ids"))
    # Few bytes and much work: the number of cells, and not their bytes, is what tasks are made of.
    tasks = int(index.chunks.sum()) * blocks
    cells = both.repartition(max(1, tasks), "part", "chunk", "block").groupBy("part", "chunk", "block")
    found = cells.applyInArrow(lambda rows: cell(rows, dims, k), "qn long, score double, vec_id long")
    order = W.partitionBy("qn").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return found.groupBy("qn").agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id"))).alias("found"))


def neighbours(rows: DataFrame, every: int = EVERY, k: int = K, **how: object) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`, among all other rows. how: see indexed."""
    spark = rows.sparkSession
    rows = written(usable(rows), "ann-rows")
    asks = rows.where(F.col("vec_id") % every == 0)
    queries = written(asks.select("v").distinct().select(F.monotonically_increasing_id().alias("qn"), "v"), "ann-queries")
    index = indexed(rows, queries, k, **how)
    if not index or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = written(searched(queries, index, k + 1), "ann-found")
    asks = attach(attach(asks, queries, ["v"], "inner").select(F.col("vec_id").alias("query_id"), "qn"), found, ["qn"], "inner")
    other = F.slice(F.filter("found", lambda x: ~x["vec_id"].eqNullSafe(F.col("query_id"))), 1, k)
    return asks.select("query_id", F.posexplode(other).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"))
