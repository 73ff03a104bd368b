"""Prefix trie of conversations: a node per distinct sequence of first turns, with what it shares and what lies below it.

Digests: a turn is the SHA-256 of its role and text; a prefix is the SHA-256 of the prefix before it and its last turn, a chain. So that a
conversation of any length is many tasks, chains restart every BLOCK turns, and the chain of the blocks' ends is laid under
them; equal prefixes have equal digests all the same, as their depths are equal. Prefixes are exploded as rows and grouped by (depth, digest).

Sums over subtrees: each node counts once for each of its ancestors. A node is held by its smallest member, and the nodes that
a conversation holds are the deep end of its path, so it hands each node on its path the sum of those held at or below that
depth: nodes exploded to their ancestors, added up per path before the exchange.

Rebuilding (`rebuilt`): the first h turns of a conversation are replaced by those of the first of its five neighbours.

Defined results: turns are in order of `turn`, null first, ties in order of their digests; null role or text are empty; rows without
conv_id belong to no conversation; repeated turns count as often as they occur; no conversations give an empty
result, and any give a root; remainders have the sign of the id, as in SQL; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, read, written
from .order import numbered

#: Turns of a conversation in one task.
BLOCK = 256
#: Neighbours that share a head, and the most turns of it.
NEAR, HEAD = 5, 8
#: Ids in one piece of a node's list of ends: two to the power of this.
PIECE = 8


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, keys): conv_id, digest of the turn, its bytes, nr from 0; and conv_id, size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", digest.alias("td"), F.octet_length(text).cast("long").alias("bytes"))
    rows, keys = numbered(rows, "conv_id", ["turn", "td"], "trie")
    return rows.select("conv_id", "nr", "td", "bytes"), keys.select("conv_id", "size")


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)


def rebuilt(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): conv_id, length, place (from 0), td, bytes of the rebuilt conversations; and conv_id, length, turnless ones too."""
    base = F.col("conv_id") - F.col("conv_id") % NEAR
    keys = keys.select("conv_id", "size", base.alias("base"), head_length(F.col("conv_id")).alias("h"))
    lent = keys.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("size").alias("there"))
    keys = keys.join(lent, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    keys = written(keys.withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "trie-conversations")
    own = attach(rows, keys.select("conv_id", "h", "taken", "length"), ["conv_id"], "inner").where("nr >= h")
    own = own.select("conv_id", "length", (F.col("taken") + F.col("nr") - F.col("h")).alias("place"), "td", "bytes")
    heads = rows.where((F.col("nr") < HEAD) & (F.col("conv_id") % NEAR == 0)).withColumnRenamed("conv_id", "base")
    other = keys.where("taken > 0").join(heads, "base").where("nr < taken").select("conv_id", "length", F.col("nr").alias("place"), "td", "bytes")
    return own.unionByName(other), keys.select("conv_id", "length")


def chained(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds chain, the digests of td chained within equal keys, and before, the one before; rows are sorted."""
    key, last = None, None
    for b in batches:
        chain, before = [], []
        for *now, td in zip(*(b.column(k).to_pylist() for k in keys), b.column("td").to_pylist(), strict=True):
            if now != key:
                key, last = now, None
            before.append(last)
            last = td if last is None else sha256(last + td).digest()
            chain.append(last)
        yield b.append_column("chain", pa.array(chain, pa.binary())).append_column("before", pa.array(before, pa.binary()))


def chain(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", chain binary, before binary"
    return rows.repartition(*keys).sortWithinPartitions(*keys, by).mapInArrow(lambda batches: chained(batches, keys), schema)


def prefixes(rows: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, length, block, depth, digest, parent, bytes): a row per prefix of each conversation, from depth 0."""
    made = written(chain(rows.withColumn("block", F.expr(f"place div {block}")), ["conv_id", "block"], "place"), "trie-chains")
    ends = made.where(F.col("place") % block == block - 1).select("conv_id", "block", F.col("chain").alias("td"))
    bounds = written(chain(ends, ["conv_id"], "block").select("conv_id", (F.col("block") + 1).alias("block"), F.col("chain").alias("bound")), "trie-bounds")
    join = lambda x: F.unhex(F.sha2(F.concat("bound", x), 256))
    cols = ["conv_id", "length", "block", (F.col("place") + 1).alias("depth")]
    none = F.lit(b"")
    short = made.where("block = 0").select(*cols, F.col("chain").alias("digest"), F.coalesce("before", none).alias("parent"), "bytes")
    long = attach(made.where("block > 0"), bounds, ["conv_id", "block"], "inner")
    # Chained ends of blocks are the digests of the prefixes up to there, so the first prefix of a block has the bound for its parent.
    parent = F.when(F.col("before").isNull(), F.col("bound")).otherwise(join(F.col("before")))
    long = long.select(*cols, join(F.col("chain")).alias("digest"), parent.alias("parent"), "bytes")
    root = conversations.select("conv_id", "length", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("depth"), none.alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"))
    return written(root.unionByName(short).unionByName(long), "trie-prefixes")


def held_below(rows: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(depth, digest, n_leaves, saved_tokens): sums over the subtree of each node."""
    held = nodes.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    rows = rows.join(held, ["conv_id", "depth"], "left").na.fill(0, ["leaf", "saved"])
    rows = written(rows.select("conv_id", "length", "block", "depth", "digest", "leaf", "saved"), "trie-held")
    down = W.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.where(F.col("length") > block).groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("leaf", "saved")])
    rows = attach(rows, written(blocks, "trie-blocks"), ["conv_id", "block"])
    sums = rows.select("depth", "digest", *[(F.sum(c).over(down) + F.coalesce(f"{c}_later", F.lit(0))).alias(c) for c in ("leaf", "saved")])
    return sums.groupBy("depth", "digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of nodes at which conversations end.

    Ids are joined to pieces in parallel; the digest of a node's pieces is a stream, as SHA-256 is, of bytes alone.
    """
    ends = rows.where("depth = length").groupBy("depth", "digest", F.shiftright("conv_id", PIECE).alias("piece"))
    pieces = ends.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, names = None, None, ["depth", "digest", "ends_sha256"]
        row = lambda: pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.binary()), pa.array([state.hexdigest()])], names=names)
        for b in batches:
            out = []
            for depth, digest, ids in zip(b.column("depth").to_pylist(), b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if (depth, digest) == key:
                    state.update(b",")
                else:
                    if key:
                        out.append(row())
                    key, state = (depth, digest), sha256()
                state.update(ids.encode())
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if key:
            yield row()

    sort = pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "piece")
    return sort.select("depth", "digest", "ids").mapInArrow(run, "depth long, digest binary, ends_sha256 string")


def trie(rows: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes over conversations given as rows (conv_id, length, place, td, bytes) and (conv_id, length)."""
    rows = prefixes(rows, conversations, block)
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
    nodes = written(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, ["depth", "digest"], "left").na.fill(0, ["n_children"]).join(above, ["depth", "parent"], "left")
    nodes = written(nodes, "trie-family")
    out = nodes.join(held_below(rows, nodes, block), ["depth", "digest"]).join(end_digests(rows), ["depth", "digest"], "left")
    none = sha256(b"").hexdigest()
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return out.select(*[F.col(c).cast("long") for c in names], F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(*turns(read(spark, sf_dir, "conversations")))).drop("digest")


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, count(*) AS n, c - c % 5 AS b, (4294967295 - list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)) % 9 AS h
  FROM t GROUP BY c),
m AS (SELECT k.c, k.b, k.h, least(k.h, coalesce(o.n, 0)) AS taken FROM k LEFT JOIN k o ON o.c = k.b),
r AS (
  SELECT m.c, t.i, x FROM m JOIN t ON t.c = m.b AND t.i < m.taken
  UNION ALL
  SELECT m.c, m.taken + t.i - m.h, x FROM m JOIN t ON t.c = m.c AND t.i >= m.h),
s AS (SELECT m.c, coalesce(list(x ORDER BY i) FILTER (WHERE x IS NOT NULL), []) AS path FROM m LEFT JOIN r ON r.c = m.c GROUP BY m.c),
p AS (SELECT c, d, list_slice(path, 1, d) AS path, len(path) = d AS ends FROM s, unnest(range(0, len(path) + 1)) AS q(d)),
n AS (
  SELECT d, path, min(c) AS c, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends) AS ids,
    CASE WHEN d > 0 THEN (count(*) - 1) * octet_length(encode(path[d].t)) ELSE 0 END AS saved
  FROM p GROUP BY d, path),
f AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND list_slice(x.path, 1, n.d) = n.path) AS n_children FROM n),
u AS (SELECT a AS d, list_slice(path, 1, a) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved FROM f, unnest(range(0, d + 1)) AS q(a) GROUP BY 1, 2)
SELECT f.c AS conv_id, f.d AS depth, o.c AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM f JOIN u ON u.d = f.d AND u.path = f.path LEFT JOIN n o ON o.d = f.d - 1 AND o.path = list_slice(f.path, 1, f.d - 1)
"""
