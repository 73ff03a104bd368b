"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: 64 bits over the XXH64 hashes (seed 42) of all word shingles of the whole lower-cased text, repeats included.
Two texts link if their fingerprints differ in at most `radius` bits; the result is the connected component of each document.

Search: of radius + 1 segments of the bits, two linked fingerprints agree in one, so each distinct fingerprint goes to one
group per segment. Groups above a size are dealt again, by segments of the bits left over, until they are small: a group
is never cut, and no link is lost. Within a group, fingerprints are sorted by Gray rank, runs of them become leaves and runs
of leaves upper nodes. A node holds the bits its members share; bits that the parent has are not held again. Pairs of nodes
are compared from the top, adding up the differences in shared bits, and dropped whole once these exceed the radius. What a
group hands on is a spanning forest of its links, so its rows grow with its size and not with its square.

Defined results: texts without words (null, empty, blank) have fingerprint zero and link like others; with fewer words than a shingle
the whole sequence is the one shingle; repeated rows share a component; a null id takes part but is never the smallest, unless
a component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, attach, packed, read, unpacked, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Groups of more distinct fingerprints are dealt again by further bits.
GROUP = 2048
LEAF, FAN = 16, 8
#: Shingles whose bits are unpacked at once, and pairs of fingerprints compared at once.
BLOCK = 1 << 16
PAIRS = 1 << 22


# --- fingerprints ---


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of UTF-8 bytes: bytes.lower and bytes.split know ASCII letters and white space only, as wanted."""
    found = text.lower().split()
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    starts, ends = (end - size)[:n].tolist(), end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        bits += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): th is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(fp.view(np.int64))], names=["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


# --- the index within groups ---


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code word in Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def runs(group: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of at most `size` rows of one group; group: sorted numbers."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    inside = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    return np.flatnonzero(inside % size == 0)


def product(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of rows of range a0..a1 with rows of b0..b1, for many ranges; and the number of the range."""
    wide = b1 - b0
    n = (a1 - a0) * wide
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return a0[of] + k // wide[of], b0[of] + k % wide[of], of


def near_pairs(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) within `radius` bits in the same group; rows are sorted by group and Gray rank."""
    levels = []  # from the leaves up: first row below, of each node; shared bits; their pattern
    start = runs(group, LEAF)
    low, high, owner = np.bitwise_and.reduceat(fp, start), np.bitwise_or.reduceat(fp, start), group[start]
    levels.append((np.r_[start, len(fp)], ~(low ^ high), low))
    while len(np.unique(owner)) < len(owner):
        start = runs(owner, FAN)
        low, high, owner = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start), owner[start]
        levels.append((np.r_[start, len(levels[-1][0]) - 1], ~(low ^ high), low))
    a = b = np.arange(len(owner))
    differ = np.zeros(len(a), np.uint8)
    for k in range(len(levels) - 1, 0, -1):
        below, shared, _ = levels[k]
        _, own, pattern = levels[k - 1]
        x, y, of = product(below[a], below[a + 1], below[b], below[b + 1])
        held = own[x] & own[y] & ~(shared[a] & shared[b])[of]
        d = differ[of] + np.bitwise_count((pattern[x] ^ pattern[y]) & held)
        keep = (d <= radius) & (x <= y)
        a, b, differ = x[keep], y[keep], d[keep]
    rows = levels[0][0]
    x, y, _ = product(rows[a], rows[a + 1], rows[b], rows[b + 1])
    keep = (x < y) & (np.bitwise_count(fp[x] ^ fp[y]) <= radius)
    return x[keep], y[keep]


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def group_links(key: np.ndarray, path: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forests of the links within the groups (path, key), some groups at a time."""
    order = np.lexsort((gray_rank(fp), key, path))
    key, path, fp = key[order], path[order], fp[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (path[1:] != path[:-1])]
    group = np.cumsum(new) - 1
    start = np.r_[np.flatnonzero(new), len(fp)]
    part = np.cumsum(np.diff(start) ** 2) // PAIRS
    for p in np.unique(part):
        of = np.flatnonzero(part == p)
        a, b = start[of[0]], start[of[-1] + 1]
        x, y = near_pairs(group[a:b], fp[a:b], radius)
        label = forest(b - a, x, y)
        child = np.flatnonzero(label != np.arange(b - a))
        yield fp[a:b][child], fp[a:b][label[child]]


def find_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Over rows (path, key, fp) sorted by path and key; the last group of a batch waits for its other rows."""
    names = ("path", "key", "fp")
    rest = [np.empty(0, np.int64)] * 3

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b in group_links(cols[1], cols[0], cols[2].view(np.uint64), radius):
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        cols = [np.r_[r, batch.column(n).to_numpy(zero_copy_only=False)] for r, n in zip(rest, names, strict=True)]
        if not len(cols[0]):
            continue
        whole = int(np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])[-1])
        rest = [c[whole:] for c in cols]
        if whole:
            yield from out([c[:whole] for c in cols])
    if len(rest[0]):
        yield from out(rest)


# --- dealing fingerprints to groups, and components ---


def segments(mask: int, parts: int) -> list[int]:
    """The bits that mask lacks, in `parts` segments, each added to mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k * len(free) // parts : (k + 1) * len(free) // parts]) for k in range(parts)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, limit: int = GROUP) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints in fps that can be connected. fps: a written table."""
    masks, out = [0], None
    rows = fps.select(F.lit(0).cast("long").alias("path"), "fp")
    while True:
        finer = [m for mask in masks for m in segments(mask, radius + 1)]
        last = all(m.bit_count() >= 64 - radius for m in finer)
        pick = F.element_at(F.lit([signed(m) for m in finer]), (F.col("path") + 1).cast("int"))
        rows = rows.withColumn("path", F.explode(F.sequence(F.col("path") * (radius + 1), F.col("path") * (radius + 1) + radius))).select("path", pick.bitwiseAND(F.col("fp")).alias("key"), "fp")
        sizes = written(rows.groupBy("path", "key").count().where(F.col("count") > 1).withColumn("large", F.lit(not last) & (F.col("count") > limit)), "simhash-groups")
        large = sizes.where("large").select("path", "key", "large")
        more = large.count()
        small = rows
        if more:
            rows = written(attach(rows, large, ["path", "key"]), "simhash-rows")
            small, rows = rows.where("large is null").drop("large"), rows.where("large").drop("large", "key")
        found = small.repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(lambda b: find_links(b, radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not more:
            return out
        masks = finer


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), by large and small stars in turn until nothing changes; the root is the smallest node.

    The centres of stars are broadcast while the edges' counted bytes are few; beyond that adaptive execution splits hot ones.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, now = None, state()
    while now != before:
        side = F.broadcast if 48 * now[0] <= BROADCAST_BYTES else lambda df: df
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(side(low), F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(side(low), F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = written(small, "small-star")
        before, now = now, state()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, th, fp, root, component_id): one row per document; root: the component's smallest fingerprint. The written fingerprints are all that is kept of the texts."""
    rows = written(fingerprints(docs, shingle), "simhash")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = written(components(links(fps, radius)), "simhash-roots")
    rooted = attach(fps, roots.withColumnRenamed("node", "fp"), ["fp"]).withColumn("root", F.coalesce("root", "fp"))
    low = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lows")
    ids = written(attach(rooted, low, ["root"]).select("fp", "root", "component_id"), "simhash-ids")
    return attach(rows, ids, ["fp"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each component: the smallest (doc_id, hash of text), once."""
    return one_each(docs, written(grouped(docs.select("doc_id", "text"), shingle, radius), "simhash-grouped"))


def one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the smallest (doc_id, hash of text) of each root, once. found: a written table (doc_id, th, root), one row per document."""
    # Tied ids could give two components one component_id, so the root names them here.
    best = written(found.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("best")).select("root", "best.*"), "simhash-best")
    marked = attach(found, best.select("root", F.col("doc_id").alias("best_id"), F.col("th").alias("best_th")), ["root"])
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & F.col("th").eqNullSafe(F.col("best_th"))
    once = marked.groupBy("doc_id", "th").agg(F.count("*").alias("n"), F.bool_or(stays).alias("stays"))
    odd = written(once.where(~F.col("stays") | (F.col("n") > 1)).select("doc_id", "th", "stays"), "simhash-others")
    keyed = packed(docs).select("__row", F.col("__row.doc_id").cast("long").alias("doc_id"), F.xxhash64("__row.text").alias("th"))
    keyed = attach(keyed, odd, ["doc_id", "th"])
    alone = keyed.where("stays is null")
    again = keyed.where("stays").dropDuplicates(["doc_id", "th"])
    return unpacked(alone.unionByName(again))
