"""Byte-level BPE encoding and decoding over distinct words.

A text is split into words by the pattern of the vocabulary. Each task numbers its distinct words and hands each new one
on once, byte by byte; Spark higher-order functions fold the ranked merges over its bytes, looking pairs up in a
literal rank map (an array of hash buckets, as a map literal is searched from end to end). The word numbers of the documents then
take the words' ids. Nothing is shuffled or broadcast; a task's dictionary is bounded and starts anew when full.
Decoding concatenates the ids' binary pieces.

The pattern is Java's, made to mean what it means to the library: letters and numbers that the one knows and the other does not (they are of
different versions of Unicode) are asked of both and put right in the classes of the pattern.

Where the pair of the lowest rank is in a word several times, all its places merge in one step, so a word takes as many steps as it has
different merges, however long it is. Only for tokens where this could differ from one merge after the other do they go one by one.

Defined results: null and empty texts have no ids; repeated rows and tied ids are encoded row by row, in place; a word that is a token has
its id without a fold; an empty table gives an empty result; only the id column of the input is handed on.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, small_batches, written
from .dictionary import Lists, Numbers

BUCKETS = 1 << 16
#: Distinct words of a task before its dictionary starts anew.
MAX_WORDS = 2_000_000
#: Words whose ids are laid out at once; a document is not cut.
BLOCK_WORDS = 1 << 18
#: A task takes at least so many bytes of the input files: the more words it has, the more often it meets each again.
TASK_BYTES = 128 << 20
OFFSET, NO_PAIR = 0x10000, chr(0x10FFFF)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def spans(points: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of sorted numbers."""
    first = np.flatnonzero(np.diff(points, prepend=-2) != 1)
    return list(zip(points[first].tolist(), points[np.r_[first[1:], len(points)] - 1].tolist(), strict=True))


def regex_class(points: np.ndarray) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans(points))


def characters(step: int = 1 << 12) -> Iterator[str]:
    """All code points but surrogates, some at a time."""
    for a in range(0, 0x110000, step):
        if not 0xD800 <= a < 0xE000:
            yield "".join(map(chr, range(a, a + step)))


@cache
def library_class(name: str) -> np.ndarray:
    """Code points that the library's regex engine has in a class: an encoding whose pattern is the class drops all others."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    found = [np.frombuffer(bytes(probe.encode_ordinary(some)).decode().encode("utf-32-le"), np.uint32) for some in characters()]
    return np.concatenate(found).astype(np.int64)


def java_classes(spark: SparkSession, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Code points in classes of Java's regex engine, as the executors have it; their runs are what comes to the driver."""
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    rows = spark.range(0x110000).where("id < 55296 or id >= 57344").select("id", char.alias("c"))
    rows = rows.select("id", F.explode(F.array(*[F.when(F.col("c").rlike(n), F.lit(n)) for n in names])).alias("name")).where("name is not null")
    run = F.col("id") - F.row_number().over(W.partitionBy("name").orderBy("id"))
    found = rows.withColumn("run", run).groupBy("name", "run").agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()
    return {n: np.concatenate([np.arange(a, b + 1) for a, b in sorted((r.a, r.b) for r in found if r["name"] == n)]) for n in names}


_patterns: dict[tuple[str, str], str] = {}


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """The library's pattern for Java: white space, letters and numbers are what the library takes for them. Found out once for an application."""
    key = (spark.sparkContext.applicationId, pattern)
    if key not in _patterns:
        java = java_classes(spark, (r"\p{L}", r"\p{N}"))
        space = regex_class(library_class(r"\s"))
        more = {n: np.setdiff1d(library_class(n), own) for n, own in java.items()}
        less = {n: np.setdiff1d(own, library_class(n)) for n, own in java.items()}
        # The characters in question are rare and high: a test of the lowest comes first.
        among = lambda x: rf"[\x{{{x[0]:X}}}-\x{{10FFFF}}&&[{regex_class(x)}]]" if len(x) else ""
        beyond = lambda x: rf"&&[\x{{0}}-\x{{{x[0] - 1:X}}}[^{regex_class(x)}]]" if len(x) else ""
        own = {n: f"[[{n}{among(more[n])}]{beyond(less[n])}]" for n in java}
        every, neither = np.union1d(*more.values()), np.setdiff1d(np.union1d(*less.values()), np.union1d(*map(library_class, java)))
        other = rf"[[[^{space}\p{{L}}\p{{N}}]{among(neither)}]{beyond(every)}]"
        out = pattern.replace(r"[^\s\p{L}\p{N}]", "\0other").replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]")
        for n, x in own.items():
            out = out.replace(n, x)
        _patterns[key] = out.replace("\0other", other)
    return _patterns[key]


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def library(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def literal(value: object, kind: str) -> Column:
    """A nested literal: the optimizer folds the call into one."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False)), kind)


def rank_map(path: str) -> Column:
    """The rank map as one literal, in hash buckets: of two characters a + b whose ids' bytes joined are a token, that token's character.

    Ids are written as characters here, one code point each (id + OFFSET), so that a word's parts are a string: Spark cuts and
    joins strings much faster than arrays, and comparing characters compares ranks. A bucket is a string too, of NO_PAIR and the three
    characters for each entry: an array of short strings is small in the driver's plans.
    """
    known = ranks(path)
    buckets = [""] * BUCKETS
    for token, rank in known.items():
        for i in range(1, len(token)):
            a, b = known.get(token[:i]), known.get(token[i:])
            if a is not None and b is not None:
                left, right = chr(a + OFFSET), chr(b + OFFSET)
                buckets[xxhash.xxh64_intdigest(right, xxhash.xxh64_intdigest(left, 42)) % BUCKETS] += NO_PAIR + left + right + chr(rank + OFFSET)
    return literal([x or NO_PAIR for x in buckets], "array<string>")


@cache
def one_by_one(path: str) -> str:
    """Characters of the tokens whose places must not merge all at once: those in a token of lower rank (which would come next, before
    the other places), and those that are made of pairs that can overlap."""
    known, out = ranks(path), set()
    for token, own in known.items():
        lefts, rights = set(), set()
        for i in range(1, len(token)):
            a, b = known.get(token[:i]), known.get(token[i:])
            if a is not None and b is not None:
                out.update(x for x in (a, b) if x > own)
                if a != b:
                    lefts.add(a)
                    rights.add(b)
        if lefts & rights:
            out.add(own)
    return "".join(chr(x + OFFSET) for x in sorted(out))


def rank(merges: Column, left: Column, right: Column) -> Column:
    """The part that two parts make, which is their rank too; NO_PAIR, with which all buckets begin, if they make none."""
    bucket = F.get(merges, F.xxhash64(left, right).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    return F.left(F.call_function("substring_index", bucket, F.concat(F.lit(NO_PAIR), left, right), F.lit(-1)), F.lit(1))


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def pair_ranks(parts: Column, merges: Column) -> Column:
    """A character for the rank of each two neighbours."""
    return let(F.split(parts, ""), lambda c: F.array_join(F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x, i: rank(merges, x, F.get(c, i + 1))), ""))


def fold(word: Column, merges: Column, single: str) -> Column:
    """word (p: a character per byte, r: one for the rank of each two neighbours) -> a character per id: merges the pair of the lowest rank, the
    first of several, until there is none. A merge of one place changes two of the ranks. single: see one_by_one.
    """

    def merge(s: Column, best: Column, at: Column) -> Column:
        """at: the place of the pair, from 1; best: its rank, which is the new part."""
        p, r = s["p"], s["r"]
        left = F.when(at > 1, rank(merges, F.substr(p, at - 1, F.lit(1)), best)).otherwise(F.lit(""))
        right = F.when(at < F.char_length(r), rank(merges, best, F.substr(p, at + 2, F.lit(1)))).otherwise(F.lit(""))
        # Of the ranks go the pair's own and those on either side.
        one = F.struct(F.overlay(p, best, at, F.lit(2)).alias("p"), F.overlay(r, F.concat(left, right), F.greatest(at - 1, F.lit(1)), F.when(at > 1, 3).otherwise(2)).alias("r"))
        every = let(F.replace(p, F.substr(p, at, F.lit(2)), best), lambda q: F.struct(q.alias("p"), F.when(F.char_length(q) > 1, pair_ranks(q, merges)).otherwise(F.lit("")).alias("r")))
        return F.when((F.call_function("locate", best, r, at + 1) > 0) & ~F.contains(F.lit(single), best), every).otherwise(one)

    def step(s: Column, _: Column) -> Column:
        low = F.array_min(F.split(s["r"], ""))
        return F.when(s["r"] == "", s).otherwise(let(low, lambda best: F.when(best == NO_PAIR, F.struct(s["p"].alias("p"), F.lit("").alias("r"))).otherwise(let(F.call_function("instr", s["r"], best), lambda at: merge(s, best, at)))))

    steps = F.sequence(F.lit(1), F.char_length(word["r"]))
    return F.when(word["r"] == "", word["p"]).otherwise(F.aggregate(steps, word, step, lambda s: s["p"]))


#: The first ranks of a word are of pairs of bytes: they are read off a table of all such pairs, for all new words at once.
CHUNK = "n array<int>, word array<int>, fresh boolean, parts array<struct<p: string, r: string>>, done_at array<int>, done_ids array<array<int>>"


PARTS = pa.struct([("p", pa.string()), ("r", pa.string())])


def four_bytes(chars: list[str]) -> np.ndarray:
    """Characters beyond the first plane, of four bytes each in UTF-8."""
    return np.frombuffer("".join(chars).encode(), np.uint8).reshape(-1, 4)


def strings(chars: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of so many characters of four bytes, laid out in a row."""
    ends = np.r_[0, 4 * np.cumsum(size)].astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(chars.tobytes()))


def number_words(batches: Iterator[pa.RecordBatch], path: str, max_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, words) -> a row per batch: its documents, the number of each of their words, and the words that are new in this task."""
    known = Numbers()
    schema = lambda key: pa.schema([("doc_id", pa.list_(key)), ("n", pa.list_(pa.int32())), ("word", pa.list_(pa.int32())), ("fresh", pa.bool_()), ("parts", pa.list_(PARTS)), ("done_at", pa.list_(pa.int32())), ("done_ids", pa.list_(pa.list_(pa.int32())))])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    fresh, table = True, ranks(path)
    single = four_bytes([chr(table[bytes([i])] + OFFSET) for i in range(256)])
    paired = four_bytes([chr(table[x] + OFFSET) if x in table else NO_PAIR for x in (bytes([i, j]) for i in range(256) for j in range(256))])
    for batch in batches:
        words = batch.column("words")
        n = pc.fill_null(pc.list_value_length(words), 0).cast(pa.int32())
        coded = words.flatten().dictionary_encode()
        own = coded.dictionary
        if len(known) + len(own) > max_words:
            known, fresh = Numbers(), True
        numbers, at = known.of(own)
        new = own.take(pa.array(at)).cast(pa.binary()).to_pylist()
        done_at = [i for i, w in enumerate(new) if w in table]
        done_ids = [[table[new[i]]] for i in done_at]
        for i in done_at:
            new[i] = b""
        data, size = np.frombuffer(b"".join(new), np.uint8), np.fromiter(map(len, new), np.int64, len(new))
        inside = np.ones(len(data), bool)
        inside[np.cumsum(size)[size > 0] - 1] = False  # the last byte of a word starts no pair
        at = np.flatnonzero(inside)
        pairs = data[at].astype(np.int64) * 256 + data[np.minimum(at + 1, len(data) - 1)] if len(at) else at
        parts = pa.StructArray.from_arrays([strings(single[data], size), strings(paired[pairs], np.maximum(size - 1, 0))], fields=list(PARTS))
        word = numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int32)
        docs = batch.column("doc_id")
        del own, new, coded, words, batch
        yield pa.record_batch([one(docs), one(n), one(pa.array(word)), pa.array([fresh]), one(parts), one(pa.array(done_at, pa.int32())), one(pa.array(done_ids, pa.list_(pa.int32())))], schema=schema(docs.type))
        fresh = False


def take_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of number_words with the parts of the new words merged -> doc_id, ids."""
    lists = Lists()
    for batch in batches:
        for row in range(batch.num_rows):
            own = lambda name: batch.column(name).slice(row, 1).flatten()  # noqa: B023, E731
            parts, at = own("parts"), own("done_at").to_numpy(zero_copy_only=False)
            if batch.column("fresh")[row].as_py():
                lists = Lists()
            size = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64) // 4  # every character takes four bytes
            flat = np.frombuffer("".join(parts.to_pylist()).encode("utf-32-le"), np.uint32) - np.uint32(OFFSET)
            done = own("done_ids")
            lists.add(flat, size, at, done.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(done).to_numpy(zero_copy_only=False).astype(np.int64))
            word = own("word").to_numpy(zero_copy_only=False)
            n = own("n").to_numpy(zero_copy_only=False).astype(np.int64)
            docs, ends, lo = own("doc_id"), np.r_[0, np.cumsum(n)], 0
            while lo < len(n):  # some documents at a time
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK_WORDS, "right")) - 1)
                ids, size = lists.take(word[ends[lo] : ends[hi]])
                bounds = np.r_[0, np.cumsum(size)][ends[lo : hi + 1] - ends[lo]]
                yield pa.record_batch([docs.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))], names=["doc_id", "ids"])
                lo = hi


def together(df: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """df with its scan's splits read several to a task where splits are small, but no fewer tasks than cores. With Spark's own split size it changes nothing; ids are the same either way."""
    spark = df.sparkSession
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    parts = df.rdd.getNumPartitions()
    return df.coalesce(min(parts, max(spark.sparkContext.defaultParallelism, -(-parts * split // task_bytes)))) if parts else df


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, max_words: int = MAX_WORDS, key: Column | None = None) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text). key: what stands for doc_id in the result, of any type."""
    import public_tokenizers

    path, pattern = path or vocabulary(), pattern or public_tokenizers.PATTERN
    words = F.coalesce(F.regexp_extract_all("text", F.lit(java_pattern(docs.sparkSession, pattern)), F.lit(0)), F.array().cast("array<string>"))
    rows = together(docs.select((F.col("doc_id").cast("long") if key is None else key).alias("doc_id"), "text")).select("doc_id", words.alias("words"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    chunks = rows.mapInArrow(lambda b: number_words(b, path, max_words), f"doc_id array<{kind}>, {CHUNK}")
    parts = let(rank_map(path), lambda merges: F.transform("parts", lambda w: fold(w, merges, one_by_one(path))))
    chunks = chunks.withColumn("parts", parts)
    return chunks.mapInArrow(take_ids, f"doc_id {kind}, ids array<int>")


def decoded(ids: Column, path: str | None = None) -> Column:
    """Array of ids -> binary: their pieces in a row."""
    known = ranks(path or vocabulary())
    pieces = [""] * (max(known.values()) + 1)
    for token, rank in known.items():
        pieces[rank] = token.hex()
    table = literal(pieces, "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are written here, under a limit on batches: between Python and Spark go many batches at a time."""
    rows = encoded(read(spark, sf_dir, "documents"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"))
    with small_batches(spark):
        return written(rows, "bpe-digests")
