"""Token ids as grammar-compressed binary shards.

Documents go to ranges of ascending doc_id; a task encodes those of its range with the tokenizers library and cuts their ids into
shards. A shard is compressed by Re-Pair: pairs of neighbouring symbols that occur LEAST times or more are replaced by nonterminals,
the most frequent first, until no pair occurs so often. A shard's row in the files holds the rules (left, right), the number of
ids each symbol expands to, the compressed sequence with the place of every few symbols, and the documents with their places,
so that any range of ids is decoded from the symbols that cover it alone.

Files: Parquet with one row per shard; integers are little-endian (u4: unsigned 32 bits, u8: 64 bits).

Encoding goes by distinct pieces: the tokenizer drops white space and splits at it, so words can be encoded apart, and most words
also at runs of other than letters and digits and at each digit. Which characters allow such cuts is found out from the library itself.
A worker's dictionary is bounded and starts anew when full. Added tokens, which the library finds in a text before anything else, are as it finds them.

Defined results: null and empty texts have the end id only; rows with one doc_id are written in order of their text; null ids come first;
other columns are not written; an empty table gives no shards and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, new_path, read, small_batches, written
from .dictionary import Lists, Numbers

END_ID = 1
#: Ids per shard (a document is not cut); the count from which a pair of a shard is frequent.
SHARD_IDS, LEAST = 1 << 20, 32
#: The place of every so many symbols is stored.
STEP = 256
MAX_PIECES = 2_000_000
#: Where words are cut into pieces: around runs of other than letters and digits, and around each digit.
CUTS = r"([^\s\pL\pN]+|\pN)"
#: Characters are tried below this one; words with others are encoded whole.
TRIED = 0x30000
#: Bytes of text, and pieces given to the library, at once.
BLOCK_BYTES, AT_ONCE = 6 << 20, 1024


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- encoding ---


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def added(path: str) -> list[str]:
    """Strings that the library finds in a text before it cuts words."""
    return sorted({t.content for t in tokenizer(path).get_added_tokens_decoder().values()})


@cache
def word_ends(path: str) -> np.ndarray:
    """By id: whether the token ends a word."""
    vocab = tokenizer(path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
    return out


def cut(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(words, CUTS, r" \1 ")


@cache
def whole_words(path: str) -> str:
    """A regex class: words with one of its characters are encoded whole, as cutting could change their ids.

    These are apostrophes (contractions), marks (they may join a letter) and characters that are not assigned yet, and all at which
    the library, tried with the character between letters, digits and symbols, cuts a word otherwise than `cut` does.
    """
    from unicodedata import category

    t = tokenizer(path)
    pieces = lambda s: [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(s))]
    odd = {ord("'")}
    for start in range(0x80, TRIED, 1024):
        kind = {chr(c): category(chr(c)) for c in range(start, start + 1024)}
        odd.update(ord(c) for c, k in kind.items() if k[0] == "M" or k in ("Cn", "Cs"))
        some = [c for c, k in kind.items() if k[0] != "M" and k not in ("Cn", "Cs")]
        words = [f"a{c}b{c}{c}1{c}.{c}" for c in some]
        parted = cut(pa.array(words, pa.string())).to_pylist()
        if pieces(" ".join(words)) != pieces(" ".join(parted)):
            odd.update(ord(c) for c, w, p in zip(some, words, parted, strict=True) if pieces(w) != pieces(p))
    points = np.array(sorted(odd))
    first = np.flatnonzero(np.diff(points, prepend=-2) != 1)
    last = np.r_[first[1:], len(points)] - 1
    return "[" + "".join(rf"\x{{{points[a]:X}}}-\x{{{points[b]:X}}}" for a, b in zip(first, last, strict=True)) + rf"\x{{{TRIED:X}}}-\x{{10FFFF}}]"


class Encoder:
    """Texts -> ids, through the ids of distinct pieces. whole: the class of whole_words."""

    def __init__(self, path: str, whole: str, max_pieces: int = MAX_PIECES):
        self.path, self.whole, self.max_pieces = path, whole, max_pieces
        self.known, self.lists = Numbers(), Lists()

    def pieces(self, found: pa.Array) -> np.ndarray:
        """Numbers of the pieces in self.lists."""
        if len(self.known) + len(found) > self.max_pieces:
            self.known, self.lists = Numbers(), Lists()
        numbers, at = self.known.of(found)
        new = found.take(pa.array(at)).to_pylist()
        if new:
            ids, sizes = zip(*(self.library_ids(new[i : i + AT_ONCE]) for i in range(0, len(new), AT_ONCE)), strict=True)
            self.lists.add(np.concatenate(ids), np.concatenate(sizes))
        return numbers

    def library_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and their numbers. Almost every piece is one word to the library, and a word's last id, and no
        other, is a word end. No piece here is without a word, so if there are as many ends as pieces, each is one word."""
        ids = np.array(tokenizer(self.path).encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(word_ends(self.path)[ids])
        if len(ends) == len(pieces) and all(map(str.strip, pieces)):
            return ids, np.diff(np.r_[-1, ends])
        each = [e.ids for e in tokenizer(self.path).encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter((x for own in each for x in own), np.uint32), np.array([len(own) for own in each], np.int64)

    def parted(self, words: pa.Array) -> pa.Array:
        """Distinct words -> lists of their pieces."""
        plain = pc.invert(pc.match_substring_regex(words, r"[^\pL]"))
        same = pc.or_(plain, pc.match_substring_regex(words, self.whole))
        at = np.flatnonzero(~same.to_numpy(zero_copy_only=False))
        if len(at):
            words = pc.replace_with_mask(words, pc.invert(same), cut(words.take(pa.array(at))))
        return pc.ascii_split_whitespace(words)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and their number by text. Texts with an added token go to the library whole."""
        texts = texts.cast(pa.string())
        hit = np.zeros(len(texts), bool)
        for token in added(self.path):
            # Signs at its beginning have no case and are found fast; what has them is looked at again.
            signs = token[: next((i for i, c in enumerate(token) if c.isalpha()), len(token))]
            may = pc.fill_null(pc.match_substring(texts, signs), False).to_numpy(zero_copy_only=False) & ~hit
            some = texts.filter(pa.array(may))
            hit[may] = pc.match_substring(some, token, ignore_case=True).to_numpy(zero_copy_only=False)
        if not hit.any():
            return self.encode_words(texts)
        own = [e.ids for e in tokenizer(self.path).encode_batch_fast(texts.filter(pa.array(hit)).to_pylist(), add_special_tokens=False)]
        ids, size = self.encode_words(pc.if_else(pa.array(hit), "", texts))
        start, n = (np.cumsum(size) - size)[hit], np.array([len(x) for x in own], np.int64)
        size[hit] = n
        return np.insert(ids, np.repeat(start, n), np.fromiter((x for each in own for x in each), np.uint32)), size

    def encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        per_text = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        parts = self.parted(words)
        n_parts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = parts.flatten().dictionary_encode()
        number = self.pieces(pieces.dictionary)
        per_piece = number[pieces.indices.to_numpy(zero_copy_only=False)] if len(pieces) else np.empty(0, np.int64)
        flat, size = self.lists.take(per_piece)
        ends = np.r_[0, np.cumsum(size)][np.cumsum(n_parts)] if len(n_parts) else np.empty(0, np.int64)
        of_word = Lists()
        of_word.add(flat, np.diff(np.r_[0, ends]))
        out, size = of_word.take(coded.indices.to_numpy(zero_copy_only=False) if len(coded) else np.empty(0, np.int64))
        ends = np.r_[0, np.cumsum(size)][np.cumsum(per_text)]
        return out, np.diff(np.r_[0, ends])


@cache
def encoder(path: str, whole: str) -> Encoder:
    """One for each Python worker: its dictionary outlives the tasks."""
    return Encoder(path, whole)


# --- Re-Pair ---


BINS = 20


def bins_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs of symbols (unsigned, 32 bits), of BINS bits."""
    return (left * np.uint32(2654435761) + right * np.uint32(40503)) >> np.uint32(32 - BINS)


class Sequence:
    """Symbols, the bins of their pairs, and the number of pairs in each bin, which follow each replacement."""

    def __init__(self, seq: np.ndarray):
        self.seq, self.bins = seq, bins_of(seq[:-1], seq[1:])
        self.count = np.bincount(self.bins, minlength=1 << BINS)

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (left << 32 | right) of the pairs with a count of `least` or more, in order; where they are, and which of them is there.

        Only pairs whose bins are full enough are sorted and counted themselves.
        """
        at = np.flatnonzero((self.count >= least)[self.bins])
        pair = (self.seq[at].astype(np.uint64) << np.uint64(32)) | self.seq[at + 1]
        key, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        often = n >= least
        rank = np.cumsum(often) - 1
        hit = often[which]
        return key[often], at[hit], rank[which[hit]]

    def replace(self, at: np.ndarray, symbol: np.ndarray) -> None:
        """The pairs at the places `at`, none of which overlap, become symbols."""
        seq, bins = self.seq, self.bins
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        before = at[at > 0] - 1
        before = before - ~keep[before]  # a removed symbol's pair begins one place earlier
        new = np.zeros(len(seq), bool)  # the left symbols of changed pairs
        new[at] = new[before] = True
        gone = new.copy()
        gone[at + 1] = True
        np.subtract.at(self.count, bins[gone[:-1]], 1)
        seq = seq.copy()
        seq[at] = symbol
        self.seq = seq = seq[keep]
        self.bins = bins = np.r_[bins, np.uint32(0)][keep][:-1]
        changed = np.flatnonzero(new[keep][:-1])
        bins[changed] = bins_of(seq[changed], seq[changed + 1])
        np.add.at(self.count, bins[changed], 1)


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, rules, base): symbols from base on are nonterminals; rules has a row (left, right) for each, of smaller symbols.

    Pairs within half of the largest count left are replaced together, from the left where they overlap, then those within half
    of what is left, and so on, until no pair occurs `least` times.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    state, rules, first = Sequence(ids.astype(np.uint32)), [np.empty((0, 2), np.uint32)], base
    limit = 0
    while len(state.seq) > 1:
        limit = max(least, (limit or int(state.count.max())) // 2)
        keys, at, which = state.frequent(limit)
        if not len(keys):
            if limit == least:
                break
            continue
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        even = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0
        at, which = at[even], which[even]
        used, which = np.unique(which, return_inverse=True)
        state.replace(at, (first + which).astype(np.uint32))
        keys = keys[used]
        rules.append(np.c_[keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)].astype(np.uint32))
        first, limit = first + len(keys), 0
    return state.seq, np.concatenate(rules), base


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of ids of each nonterminal; a rule's symbols come before it."""
    size = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        size[i] = (size[a - base] if a >= base else 1) + (size[b - base] if b >= base else 1)
    return size


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of symbols."""
    while len(at := np.flatnonzero(seq >= base)):
        n = np.ones(len(seq), np.int64)
        n[at] = 2
        rule = rules[seq[at] - base]
        seq = np.repeat(seq, n)
        place = (np.cumsum(n) - n)[at]
        seq[place], seq[place + 1] = rule[:, 0], rule[:, 1]
    return seq


#: One row per shard. task, part: its place among the shards of its range; doc_id, at: documents and the place of their first id; n_ids: ids in the shard.
SHARD = "first_id bigint, task int, part int, n_ids bigint, base int, rules binary, sizes binary, sequence binary, places binary, doc_id array<bigint>, at binary"


def pack(ids: np.ndarray, docs: list[int | None], n: np.ndarray, task: int, part: int) -> pa.RecordBatch:
    seq, rules, base = compress(ids)
    size = expansions(rules, base)
    long = np.r_[np.ones(base, np.int64), size]
    places = np.r_[0, np.cumsum(long[seq])][:-1][::STEP]
    at = np.cumsum(n) - n
    row = [[next((d for d in docs if d is not None), None)], [task], [part], [len(ids)], [base], [rules.astype("<u4").tobytes()], [size.astype("<u4").tobytes()], [seq.astype("<u4").tobytes()], [places.astype("<u8").tobytes()], [docs], [at.astype("<u8").tobytes()]]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SHARD.split(", ")])


def id_range(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a shard, decoded from the symbols that cover them."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    long = np.r_[np.ones(row["base"], np.int64), np.frombuffer(row["sizes"], "<u4").astype(np.int64)]
    places, seq = np.frombuffer(row["places"], "<u8").astype(np.int64), np.frombuffer(row["sequence"], "<u4")
    if stop <= start:
        return np.empty(0, np.uint32)
    lo, hi = (int(np.searchsorted(places, x, "right")) - 1 for x in (start, stop - 1))
    part = seq[lo * STEP : (hi + 1) * STEP]
    at = places[lo] + np.cumsum(long[part]) - long[part]
    a, b = int(np.searchsorted(at, start, "right")) - 1, int(np.searchsorted(at, stop, "left"))
    return expand(part[a:b], rules, row["base"])[start - int(at[a]) : stop - int(at[a])]


def write(docs: DataFrame, out: str, path: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Writes docs (doc_id, text) as shards to the folder out."""
    path = path or vocabulary()
    whole = whole_words(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, part, known = TaskContext.get().partitionId(), 0, encoder(path, whole)
        ids, docs, sizes, total = [], [], [], 0
        for batch in batches:
            text, doc_id = batch.column("text"), batch.column("doc_id")
            step = max(1, int(batch.num_rows * BLOCK_BYTES / max(1, text.nbytes)))
            for i in range(0, batch.num_rows, step):
                flat, n = known.encode(text.slice(i, step))
                ends = np.cumsum(n)
                ended = np.insert(flat, ends, END_ID)
                n = n + 1
                done = np.r_[0, np.cumsum(n)]
                own, a = doc_id.slice(i, step).to_pylist(), 0
                while a < len(n):
                    b = max(a + 1, int(np.searchsorted(done, done[a] + shard_ids - total, "right")) - 1)
                    ids.append(ended[done[a] : done[b]])
                    docs.extend(own[a:b])
                    sizes.append(n[a:b])
                    total += int(done[b] - done[a])
                    a = b
                    if total >= shard_ids or a < len(n):
                        yield pack(np.concatenate(ids), docs, np.concatenate(sizes), task, part)
                        ids, docs, sizes, total, part = [], [], [], 0, part + 1
        if docs:
            yield pack(np.concatenate(ids), docs, np.concatenate(sizes), task, part)

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SHARD).write.parquet(out)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(task, part, start): ids before each shard: sums by task, a running sum over these few, and one inside each task."""
    own = shards.select("task", "part", "n_ids")
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    tasks = own.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("task").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return own.withColumn("in_task", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(tasks, "task").select("task", "part", (F.col("base") + F.col("in_task")).alias("start"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, shard_ids, shard_symbols) of the shards in a folder, decoded shard by shard; start: ids of all documents
    before; ids: binary, u4; the last two: ids of the document's shard, and the symbols and rules that hold them."""
    shards = spark.read.schema(SHARD).parquet(path)
    starts = written(shard_starts(shards), "token-starts")
    joined = attach(shards.select("task", "part", "rules", "sequence", "base", "doc_id", "at"), starts, ["task", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("rules", "sequence", "base", "at", "start")}
                ids = expand(np.frombuffer(row["sequence"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), row["base"])
                at = np.r_[np.frombuffer(row["at"], "<u8").astype(np.int64), len(ids)]
                docs = batch.column("doc_id").slice(i, 1).flatten()
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(4 * at), pa.py_buffer(ids.astype("<u4"))])
                held = (len(row["sequence"]) + len(row["rules"])) // 4
                sizes = [pa.array(np.full(len(docs), n, np.int64)) for n in (len(ids), held)]
                yield pa.record_batch([docs, pa.array(row["start"] + at[:-1]), pa.array(np.diff(at)), values.cast(pa.binary()), *sizes], names=["doc_id", "start", "n_tokens", "ids", "shard_ids", "shard_symbols"])

    return joined.select("rules", "sequence", "base", "doc_id", "at", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, shard_ids long, shard_symbols long")


def openings(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(doc_id, ids) with the first n ids of each document, by random access: only the symbols that cover them are expanded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.r_[np.frombuffer(row["at"], "<u8").astype(np.int64), row["n_ids"]]
                ids = [id_range(row, a, min(b, a + n)).astype("<u4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(row["doc_id"], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return spark.read.schema(SHARD).parquet(path).drop("first_id", "task", "part").mapInArrow(run, "doc_id long, ids binary")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    with small_batches(spark):
        write(read(spark, sf_dir, "documents"), path)
    return documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard_ids", "shard_symbols")
