"""Near-duplicates by SimHash, verified and made whole by exact Jaccard similarity of word shingles.

A text is the set of its shingles of five lower-cased words (64-bit hashes, as good as the shingles but for clashes of 2^-64). Two texts
link if their sets have a Jaccard similarity of at least 0.8; the result is the connected component of each document.

Candidates come from the Gray-ordered index of `simhash.py` first, over a SimHash fingerprint of each set. At a similarity of 0.8 some ten
of 64 bits differ, beyond any radius that an index can search, so the rest comes from a join with prefix filters: in any one order of all shingles, two sets that are similar enough share a shingle among the first fifth or so of
each (the prefix), so sets are dealt to a group per shingle of their prefix, and no link is lost. The order is that of the
hashes, with shingles that a sample shows to be frequent last, so that passages shared by many texts make no large groups; the sample decides
costs only. In each group all sets are first compared with one of them, the one with most company; then, in groups that
are not one component by now, sets of different components are. Large groups of these are compared in blocks, and a task hands on the
pairs that may link only. A candidate is ruled out by counts of shingles per bin, which bound what two sets share; every other
is verified with both whole sets, so that texts move for likely pairs alone. A hot group is split: sums by key are partly aggregated.

Defined results: texts without words (null, empty, blank) have the empty set and are alike; with fewer words than a shingle the
whole sequence is the one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, scratch, small_batches, written
from .simhash import BLOCK, RADIUS, components, one_each
from .simhash import links as near_fingerprints

SHINGLE, SEED = 5, 42
#: The least similarity is LEAST / OF, so that sizes are compared as whole numbers.
LEAST, OF = 4, 5
#: One set in SAMPLE is counted for frequent shingles; these occur in FREQUENT sets of the sample, and so many are held.
SAMPLE, FREQUENT, HELD = 16, 6, 1 << 17
#: Bins of a set's counts: a power of two of at least so many, with at most so many shingles each on average.
LEAST_BINS, PER_BIN = 32, 4
#: Members of a group of which all pairs are joined; larger groups are compared in blocks of so many.
GROUP = 1024
#: Parts of a group that has a frequent shingle for its key.
SALTS = 64
#: Sets whose prefixes a task does not hand out twice.
SEEN = 1 << 18


def factors(n: int) -> np.ndarray:
    """Odd factors for words at n places."""
    return np.array([xxhash.xxh64_intdigest(b"%d" % i, SEED) | 1 for i in range(n)], np.uint64)


FACTORS = factors(SHINGLE)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of UTF-8 bytes, sorted."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))
    wide = min(shingle, len(h))
    n = len(h) - wide + 1
    f = FACTORS if shingle == SHINGLE else factors(shingle)
    x = np.full(n, wide, np.uint64)
    for i in range(wide):
        x += h[i : i + n] * f[i]
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return np.unique((x ^ (x >> np.uint64(33))).view(np.int64))


def name(ids: np.ndarray) -> int:
    """Hash of a set."""
    x = xxhash.xxh64_intdigest(ids.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def bin_counts(ids: np.ndarray) -> bytes:
    """Shingles per bin, a byte each; a full byte stands for any larger number."""
    bins = LEAST_BINS
    while bins * PER_BIN < len(ids):
        bins *= 2
    return np.minimum(np.bincount(ids & (bins - 1), minlength=bins), 255).astype(np.uint8).tobytes()


def fingerprint(ids: np.ndarray) -> int:
    """SimHash of a set, as a signed number: the bits that are set in over half of its shingles."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(ids), BLOCK):
        bits += np.unpackbits(ids[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * bits > len(ids), bitorder="little").view(np.int64)[0])


def may_link(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether sets of n and m shingles with these counts can be similar enough: they share at most the lesser count of each bin."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if (a == 255).any() or (b == 255).any():
        return True
    bins = min(len(a), len(b))
    a, b = (c.reshape(-1, bins).sum(axis=0, dtype=np.int64) for c in (a, b))
    return (LEAST + OF) * int(np.minimum(a, b).sum()) >= LEAST * (n + m)


def shapes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, sid, n, bins, fp): th is a hash of the text, sid one of its set, n the set's size, bins the counts of its shingles, fp its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").cast(pa.binary()):
                ids = shingles(t.as_py() or b"", shingle)
                out.append((name(ids), len(ids), bin_counts(ids), fingerprint(ids)))
            sid, n, bins, fp = zip(*out, strict=True) if out else ((), (), (), ())
            own = [pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(bins, pa.binary()), pa.array(fp, pa.int64())]
            yield pa.record_batch([b.column("doc_id"), b.column("th"), *own], names=["doc_id", "th", "sid", "n", "bins", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, sid long, n int, bins binary, fp long")


def frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that are frequent in a sample of the texts, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").cast(pa.binary()):
                yield pa.record_batch([pa.array(shingles(t.as_py() or b"", shingle))], names=["id"])

    th = F.xxhash64("text")
    some = docs.where(F.pmod(th, F.lit(SAMPLE)) == 0).groupBy(th.alias("th")).agg(F.first("text").alias("text")).select("text")
    found = some.mapInArrow(run, "id long").groupBy("id").count().where(F.col("count") >= FREQUENT)
    held = found.orderBy(F.desc("count"), "id").limit(HELD).select("id").toArrow()
    return held.column("id").to_numpy()[::-1].astype(np.int64)


def prefixes(docs: DataFrame, last: np.ndarray, shingle: int) -> DataFrame:
    """(key, sid, n, pos, hot): the shingles at the start of each set, which similar sets share one of. last: shingles to put last, in their order; these are hot."""
    rank = np.argsort(last)
    known = last[rank]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for t in b.column("text").cast(pa.binary()):
                ids = shingles(t.as_py() or b"", shingle)
                n, sid = len(ids), name(ids)
                if not n or sid in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(sid)
                p = n - (LEAST * n + OF - 1) // OF + 1
                place = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                    place = np.where(known[at] == ids, rank[at] + 1, 0)
                    order = np.argsort(place, kind="stable")
                    ids, place = ids[order], place[order]
                for col, x in zip(cols, (ids[:p], np.full(p, sid, np.int64), np.full(p, n, np.int32), np.arange(p, dtype=np.int32), place[:p] > 0), strict=True):
                    col.append(x)
            if cols[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in cols], names=["key", "sid", "n", "pos", "hot"])

    return docs.select("text").mapInArrow(run, "key long, sid long, n int, pos int, hot boolean")


def can_link(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether sets of n and m shingles can be similar enough if the first they share is at pos and at."""
    return (F.least(n - pos, m - at) * (LEAST + OF) >= LEAST * (n + m)) & (F.least(n, m) * OF >= LEAST * F.greatest(n, m))


def alike(one: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of sets that the index of fingerprints connects; sets of one fingerprint meet the smallest of them. one: a written table, a row per set."""
    low = written(one.groupBy("fp").agg(F.min("sid").alias("low")), "near-fingerprints")
    same = one.join(low, "fp").where("sid > low").select(F.col("low").alias("a"), F.col("sid").alias("b"))
    first, second = (low.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low")) for c in "ab")
    near = near_fingerprints(low.select("fp"), radius).distinct().join(first, "a").join(second, "b")
    return same.unionByName(near.select(F.least("a_low", "b_low").alias("a"), F.greatest("a_low", "b_low").alias("b")))


def possible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets, written, but for those whose counts rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_link(*x) for x in zip(*(b.column(c).to_pylist() for c in ("bins", "others", "n", "m")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = rows.select(F.col("sid").alias("a"), "n", "bins"), rows.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("bins").alias("others"))
    return pairs.join(first, "a").join(second, "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) of sets, written, that are similar enough. rows: a written table, one row per set, with a text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column("text").cast(pa.binary()), b.column("other").cast(pa.binary()), strict=True):
                x, y = shingles(s.as_py() or b"", shingle), shingles(t.as_py() or b"", shingle)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append((LEAST + OF) * both >= LEAST * (len(x) + len(y)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    need = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    need = written(need.join(rows, "sid").select("sid", "th"), "near-needed")
    texts = attach(docs.select("text", F.xxhash64("text").alias("th")), need, ["th"], "inner")
    held = texts.groupBy("sid").agg(F.first("text").alias("text"))
    first, second = held.withColumnRenamed("sid", "a"), held.select(F.col("sid").alias("b"), F.col("text").alias("other"))
    return written(pairs.join(first, "a").join(second, "b").select("a", "b", "text", "other").mapInArrow(run, "a long, b long"), "near-links")


def groups_of(dealt: DataFrame) -> DataFrame:
    """(key, sid, n, pos) of the groups of more than one set. Groups of a hot key are in parts, whose sums are added up, so none is one task."""
    part = W.partitionBy("key", "salt")
    salt = F.when(F.col("hot"), F.pmod("sid", F.lit(SALTS))).otherwise(0)
    dealt = dealt.withColumn("salt", salt).repartition("key", "salt")
    dealt = dealt.select("*", F.min("sid").over(part).alias("low"), F.max("sid").over(part).alias("high"))
    names = ("key", "sid", "n", "pos")
    cold = dealt.where("not hot and low < high").dropDuplicates(["key", "salt", "sid"]).select(*names)
    hot = dealt.where("hot").dropDuplicates(["key", "salt", "sid"]).select(*names)
    several = hot.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("key")
    return cold.unionByName(hot.join(several, "key"))


def in_blocks(rest: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): pairs of sets of different components in large groups that may link. rest: key, sid, n, pos, root, size."""

    def run(t: pa.Table) -> pa.Table:
        sid, n, pos, root, own = (t.column(c).to_numpy() for c in ("sid", "n", "pos", "root", "own"))
        bins, i, j = t.column("bins").to_pylist(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = (m.ravel() for m in np.meshgrid(x, y, indexing="ij"))
        fits = (root[a] != root[b]) & ((a < b) if i == j else True)
        least = np.minimum(n[a] - pos[a], n[b] - pos[b]).astype(np.int64)
        fits &= (least * (LEAST + OF) >= LEAST * (n[a] + n[b])) & (np.minimum(n[a], n[b]) * OF >= LEAST * np.maximum(n[a], n[b]))
        pairs = [sorted((int(sid[k]), int(sid[m]))) for k, m in zip(a[fits], b[fits], strict=True) if may_link(bins[k], bins[m], int(n[k]), int(n[m]))]
        low, high = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    blocks = F.ceil(F.col("size") / GROUP)
    rest = rest.join(rows.select("sid", "bins"), "sid").withColumn("own", F.pmod(F.xxhash64("sid"), blocks))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rest = rest.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return rest.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def links(docs: DataFrame, rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): links that connect all of the sets of docs that can be connected. rows: their shapes, written."""
    one = written(rows.groupBy("sid").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.first("fp").alias("fp")), "near-shapes")
    members = written(groups_of(prefixes(docs, frequent(docs, shingle), shingle)), "near-groups")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    company = members.join(sizes, "key").groupBy("sid").agg(F.sum("size").alias("company"))
    star = written(members.join(company, "sid"), "near-company")
    star = star.join(star.groupBy("key").agg(F.max(F.struct("company", "sid", "n", "pos")).alias("p")), "key")
    star = star.where((F.col("sid") != F.col("p.sid")) & can_link(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
    star = star.select(F.least("sid", "p.sid").alias("a"), F.greatest("sid", "p.sid").alias("b"))
    stars = written(star.unionByName(alike(one)).distinct(), "near-stars")
    found = verified(written(possible(stars, one), "near-possible"), one, docs, shingle)
    roots = written(components(found), "near-roots")
    rest = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
    rest = written(rest.join(mixed, "key").select("key", "sid", "n", "pos", "root", "size"), "near-rest")
    few = rest.where(F.col("size") <= GROUP)
    x, y = few.alias("x"), few.alias("y")
    fits = (F.col("x.key") == F.col("y.key")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.root") != F.col("y.root"))
    near = x.join(y, fits & can_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
    across = possible(near.distinct(), one).unionByName(in_blocks(rest.where(F.col("size") > GROUP), one)).distinct()
    across = written(across.join(stars, ["a", "b"], "left_anti"), "near-across")
    return found.unionByName(verified(across, one, docs, shingle))


def grouped(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, root): one row per document; root: the component's smallest set."""
    with small_batches(docs.sparkSession):
        rows = written(shapes(docs, shingle), "near-rows")
        roots = written(components(links(docs, rows, shingle)), "near-components")
    out = attach(rows.select("doc_id", "th", "sid"), roots.withColumnRenamed("node", "sid"), ["sid"])
    return out.select("doc_id", "th", F.coalesce("root", "sid").alias("root"))


def representatives(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each component: the smallest (doc_id, hash of text), once."""
    with scratch(docs.sparkSession):
        found = written(grouped(docs.select("doc_id", "text"), shingle), "near-grouped", keep=True)
    return one_each(docs, found)
