"""Merkle manifest of a dataset: a tree of digests per source, one over the sources, and proofs of single documents.

Leaves are digests of rows; every 16 neighbours become their digest, level by level, until one is left, the source's subroot; the
subroots, in order of their sources, are the leaves of the top tree in the same way.

The forest is an associative monoid. Its elements are sets of nodes, keyed by tree, level and index, that wait for siblings;
putting two together resolves each run that is complete, of which the sizes of the trees tell the arity. Tasks reduce what they read to
such fragments, and rounds of a tree reduction bring 16 neighbouring ranges of leaves together, until one range is left. A fragment
of a range holds some 30 nodes per level at most, whatever its number of rows. Resolved nodes are written in each round and not
carried along (as RDD.treeReduce would do, up to the driver); the driver gets the root alone.

Proofs go down from the root, one join per level with exactly 16 children a key: a node's path is that of its parent
and the siblings in between.

Defined results: a null source is a source of its own, the first; null ids come first in their source and are never tampered with; rows with
equal ids are in order of their digests; repeated rows are leaves of their own; an empty table has no root (None) and an
empty result; other columns of the input are not part of the leaf and are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, read, written
from .order import numbered

ARITY = 16
#: The tree over the sources.
TOP = -1
#: Leaves of a range in the first round; each further round brings ARITY ranges together.
RANGE = 1 << 16
#: Nodes in a batch that a task hands on.
BATCH = 8192
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree long, level int, idx long, digest string, children string, size long, start long, depth int, ptree long, plevel int, pidx long, ppos int"


class Manifest(NamedTuple):
    """leaves: doc_id, leaf, tampered (if it may differ) and the place of the leaf's parent. nodes: one row per inner node. root: hex digest."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def leaf(text: Column) -> Column:
    """Digest of a row of documents with the given text: each field as its length in bytes, a colon and its value, or a dash."""
    parts = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Forest:
    """A fragment: runs that wait for siblings, by (tree, level of the children, index of the parent)."""

    def __init__(self, sources: int) -> None:
        self.sources, self.top = sources, height(sources)
        self.runs: dict[tuple[int, int, int], dict[int, tuple[str, int]]] = {}
        self.sizes: dict[int, int] = {TOP: sources}
        self.made: list[tuple] = []

    def row(self, tree: int, level: int, idx: int, digest: str, children: str | None, start: int) -> tuple:
        size = self.sizes[tree]
        below = self.top + height(size) if tree != TOP else self.top
        if tree != TOP and -(-size // ARITY**level) == 1:
            parent = (TOP, 1, tree // ARITY, tree % ARITY)
        else:
            parent = (tree, level + 1, idx // ARITY, idx % ARITY)
        return (tree, level, idx, digest, children, size, start, below - level, *parent)

    def add(self, tree: int, level: int, idx: int, digest: str, start: int) -> None:
        """Puts a node in, and all that this resolves."""
        while True:
            width = -(-self.sizes[tree] // ARITY**level)
            if width == 1:
                if tree == TOP:
                    return
                tree, level, idx = TOP, 0, tree
                continue
            key = (tree, level, idx // ARITY)
            run = self.runs.setdefault(key, {})
            run[idx % ARITY] = (digest, start)
            if len(run) < min(ARITY, width - ARITY * key[2]):
                return
            del self.runs[key]
            children, start = "".join(run[i][0] for i in range(len(run))), min(s for _, s in run.values())
            level, idx, digest = level + 1, key[2], sha256(children.encode()).hexdigest()
            self.made.append(self.row(tree, level, idx, digest, children, start))

    def rest(self) -> Iterator[tuple]:
        for (tree, level, parent), run in self.runs.items():
            for at, (digest, start) in run.items():
                yield self.row(tree, level, ARITY * parent + at, digest, None, start)


def merged(batches: Iterator[pa.RecordBatch], sources: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Nodes (tree, size, level, idx, digest, start) to one fragment: what it resolves, with children, and what waits, without."""
    forest = Forest(sources)
    out = lambda rows: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for b in batches:
        for tree, size, level, idx, digest, start in zip(*(b.column(c).to_pylist() for c in ("tree", "size", "level", "idx", "digest", "start")), strict=True):
            forest.sizes[tree] = size
            forest.add(tree, level, idx, digest, start)
        if len(forest.made) >= BATCH:
            yield out(forest.made)
            forest.made = []
    rows = [*forest.made, *forest.rest()]
    for i in range(0, len(rows), BATCH):
        yield out(rows[i : i + BATCH])


def manifest(docs: DataFrame) -> Manifest:
    spark = docs.sparkSession
    text = F.col("text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select("doc_id", "source", leaf(text).alias("leaf"), F.when(hit, leaf(F.translate(text, UPPER, LOWER))).alias("tampered"))
    rows, keys = numbered(rows, "source", ["doc_id", "leaf"], "merkle")
    total = keys.agg(F.count("*").alias("sources"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows")).first()
    sources = total["sources"]
    leaves = rows.select("doc_id", "leaf", "tampered", F.col("key_nr").alias("tree"), "size", F.col("nr").alias("idx"), "pos")
    alone = F.col("size") == 1
    leaves = leaves.withColumn("ptree", F.when(alone, F.lit(TOP)).otherwise(F.col("tree")).cast("long"))
    leaves = leaves.withColumn("at", F.when(alone, F.col("tree")).otherwise(F.col("idx"))).withColumn("pidx", F.expr(f"at div {ARITY}")).withColumn("ppos", F.expr(f"cast(at % {ARITY} as int)"))
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]]) for f in NODE.split(", ")])
    run = lambda batches: merged(batches, sources, schema)
    first = leaves.select("tree", "size", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"), F.col("pos").alias("start"))
    made = [written(first.mapInArrow(run, NODE), "merkle-nodes")]
    wide, more = RANGE, True
    while more:
        rest = made[-1].where("children is null").withColumn("range", F.expr(f"start div {wide}"))
        made.append(written(rest.repartition("range").mapInArrow(run, NODE), "merkle-nodes"))
        more, wide = wide < total["rows"], wide * ARITY
    nodes = made[0]
    for more in made[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.where("children is not null")
    top = nodes.where("depth = 0").select("digest").first() or leaves.select("leaf").first()
    return Manifest(leaves, nodes, top[0] if top else None)


def sides(children: Column, at: Column) -> Column:
    """The digests to the left and to the right of a place in a run."""
    return F.struct(F.substring(children, F.lit(1), 64 * at).alias("l"), F.substring(children, 64 * at + 65, F.lit(64 * ARITY)).alias("r"))


def paths(nodes: DataFrame) -> DataFrame:
    """(ptree, pidx, children, subroot, path) of the nodes above leaves. path: the siblings' sides from there to the root."""
    none = F.array().cast("array<struct<l:string,r:string>>")
    deepest = nodes.agg(F.max("depth")).first()[0]
    low = lambda df: df.where("level = 1").select(F.col("tree").alias("ptree"), F.col("idx").alias("pidx"), "children", "subroot", "path")
    at = nodes.where("depth = 0").select("tree", "level", "idx", "children", F.when(F.col("tree") != TOP, F.col("digest")).alias("subroot"), none.alias("path"))
    out = low(at)
    for depth in range(1, (deepest or 0) + 1):
        above = at.select(F.col("tree").alias("ptree"), F.col("level").alias("plevel"), F.col("idx").alias("pidx"), F.col("children").alias("run"), F.col("subroot").alias("of"), F.col("path").alias("on"))
        found = nodes.where(F.col("depth") == depth).join(above, ["ptree", "plevel", "pidx"])
        subroot = F.when(F.col("tree") == TOP, None).otherwise(F.coalesce("of", "digest"))
        found = found.select("tree", "level", "idx", "children", subroot.alias("subroot"), F.concat(F.array(sides(F.col("run"), F.col("ppos"))), "on").alias("path"))
        at = written(found, "merkle-paths")
        out = out.unionByName(low(at))
    return out


def proofs(made: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf, if there is one), verified."""
    above = written(paths(made.nodes), "merkle-proofs")
    rows = attach(made.leaves, above, ["ptree", "pidx"])
    own = F.when(F.col("children").isNotNull(), F.array(sides(F.col("children"), F.col("ppos")))).otherwise(F.array().cast("array<struct<l:string,r:string>>"))
    rows = rows.withColumn("path", F.concat(own, F.coalesce("path", F.array().cast("array<struct<l:string,r:string>>"))))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda digest, x: F.sha2(F.concat(x["l"], digest, x["r"]), 256))
    root = F.lit(made.root).cast("string")
    out = rows.select("doc_id", "leaf", F.coalesce("subroot", "leaf").alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(manifest(read(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS u, doc_id, source, lang, n_chars, text,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS crc
  FROM documents),
t AS (SELECT *, CASE WHEN (4294967295 - crc) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low FROM d),
f AS (
  SELECT u, doc_id, source, low, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') ||
    coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head, text FROM t),
l AS (
  SELECT u, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) AS tampered FROM f),
o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, u) - 1 AS i,
    dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS s FROM l),
tree AS (
  SELECT s, 0 AS level, i AS idx, leaf AS digest, count(*) OVER (PARTITION BY s) AS width FROM o
  UNION ALL
  SELECT s, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), any_value((width + 15) // 16) FROM tree WHERE width > 1 GROUP BY s, level, idx // 16),
sub AS (SELECT s, digest FROM tree WHERE width = 1),
top AS (
  SELECT 0 AS level, s AS idx, digest, (SELECT count(*) FROM sub) AS width FROM sub
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), any_value((width + 15) // 16) FROM top WHERE width > 1 GROUP BY level, idx // 16),
runs AS (
  SELECT s, level, idx // 16 AS p, list(digest ORDER BY idx) AS run FROM tree WHERE width > 1 GROUP BY s, level, idx // 16
  UNION ALL
  SELECT -1, level, idx // 16, list(digest ORDER BY idx) FROM top WHERE width > 1 GROUP BY level, idx // 16),
steps AS (
  SELECT u, r.level AS k, r.run, (i // (16 ** r.level)::BIGINT) % 16 AS place FROM o JOIN runs r ON r.s = o.s AND r.p = i // (16 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT u, 1000 + r.level, r.run, (o.s // (16 ** r.level)::BIGINT) % 16 FROM o JOIN runs r ON r.s = -1 AND r.p = o.s // (16 ** (r.level + 1))::BIGINT),
sides AS (
  SELECT u, row_number() OVER (PARTITION BY u ORDER BY k) AS k, array_to_string(list_slice(run, 1, place), '') AS lft, array_to_string(list_slice(run, place + 2, 16), '') AS rgt FROM steps),
folded AS (
  SELECT u, 0 AS k, tampered AS digest FROM o
  UNION ALL
  SELECT f.u, x.k, sha256(x.lft || f.digest || x.rgt) FROM folded f JOIN sides x ON x.u = f.u AND x.k = f.k + 1),
last AS (SELECT u, arg_max(digest, k) AS digest FROM folded GROUP BY u),
proof AS (SELECT u, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS digest FROM sides GROUP BY u)
SELECT doc_id, leaf, sub.digest AS subroot, root.digest AS root, coalesce(proof.digest, sha256('')) AS proof_sha256, last.digest AS folded_root, last.digest = root.digest AS verified
FROM o JOIN sub USING (s) JOIN last USING (u) LEFT JOIN proof USING (u) CROSS JOIN (SELECT digest FROM top WHERE width = 1) root
"""
