"""Canonical exact digests of documents (DataFrame functions only).

Canonical form: compatibility decomposition (NFKD) of the case-folded text, marks in canonical order, each run of white space one
space, none at the ends. Spark has no Unicode normalisation, so characters beyond ASCII are replaced through a literal table, which is
made by rule from the Unicode data of Python. Two seeds of XXH64 over the canonical form make a hash of 128 bits. Where texts share
it, their canonical forms are compared byte by byte (grouped by hash and form); unequal forms get numbers behind the hash.

Likeness of exact digests is 1 for equal and 0 for unequal ones.

The tables are kept small, and each plan has few copies of them, as the driver holds and prints its plans: pages are short, Hangul
syllables are taken apart by arithmetic, and canonical forms are made once to hash them and once to compare them.

Order of documents: ids are cut into blocks at bounds taken from a range partitioning; the first documents of a block go to the block
before as well, so each block knows the document after its last, and texts move once.

Defined results: null and blank texts have the digest of the empty form; equal texts have equal digests; rows with one id follow in order of
text, null ids first; a single document is its own next one; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import let, literal
from .common import attach, packed, read, unpacked, written

#: Java may not know the latest marks; to it they are unassigned.
TWO_MARKS = r"[\p{M}\p{Cn}]{2}"
ASCII_SPACE = r"[\x09-\x0D\x1C-\x20]+"
PAGE = 5  # bits of a table's page


#: The one mark that case folding makes a letter; it is folded when the marks are in order.
IOTA, IOTA_FOLDED = chr(0x345), chr(0x3B9)


#: Hangul syllables follow each other by their leading consonant, vowel and trailing consonant or none.
SYLLABLES, LEAD, VOWEL, TAIL = 0xAC00, 0x1100, 0x1161, 0x11A7
LEADS, VOWELS, TAILS = 19, 21, 28


def folded(c: str) -> str:
    if c.isspace():
        return " "
    return "".join(x if x == IOTA else unicodedata.normalize("NFKD", x.casefold()) for x in unicodedata.normalize("NFKD", c))


def paged(value_of: dict[int, object]) -> list[list | None]:
    """A table of code points in pages, empty ones null."""
    pages: list[list | None] = [None] * ((sys.maxunicode >> PAGE) + 1)
    for cp, v in value_of.items():
        if pages[cp >> PAGE] is None:
            pages[cp >> PAGE] = [None] * (1 << PAGE)
        pages[cp >> PAGE][cp & (1 << PAGE) - 1] = v
    return pages[: max((i for i, p in enumerate(pages) if p), default=-1) + 1]


@cache
def tables() -> tuple[list, list, str]:
    """What characters beyond ASCII become; the combining classes of marks; a regex class of these marks."""
    fold, order = {}, {}
    for cp in (*range(128, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(cp)
        if (to := folded(c)) != c and not 0 <= cp - SYLLABLES < LEADS * VOWELS * TAILS:
            fold[cp] = to
        if rank := unicodedata.combining(c):
            order[cp] = rank
    spans, points = [], sorted(order)
    for cp in points:
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return paged(fold), paged(order), "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)


def looked_up(table: Column, char: Column) -> Column:
    return let(F.ascii(char), lambda cp: F.get(F.get(table, F.call_function("shiftright", cp, F.lit(PAGE))), cp.bitwiseAND(F.lit((1 << PAGE) - 1))))


def jamo(char: Column) -> Column:
    """The parts of a Hangul syllable; null for other characters."""
    own = lambda first, n, at: F.substr(F.lit("".join(chr(first + i) for i in range(n))), at + 1, F.lit(1))

    def parts(k: Column) -> Column:
        tail = F.when(k % TAILS > 0, own(TAIL, TAILS, (k % TAILS).cast("int"))).otherwise(F.lit(""))
        return F.concat(own(LEAD, LEADS, F.floor(k / (VOWELS * TAILS)).cast("int")), own(VOWEL, VOWELS, F.floor(k / TAILS).cast("int") % VOWELS), tail)

    return F.when((char >= chr(SYLLABLES)) & (char < chr(SYLLABLES + LEADS * VOWELS * TAILS)), parts(F.ascii(char) - SYLLABLES))


def canonical(text: Column) -> Column:
    fold, order, marks = tables()
    # Runs of ASCII, and single characters beyond it.
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    replaced = let(
        literal(fold, "array<array<string>>"),
        lambda t: F.array_join(F.transform(pieces, lambda p: F.when(F.ascii(p) < 128, F.lower(p)).otherwise(F.coalesce(looked_up(t, p), jamo(p), p))), ""),
    )

    def in_order(s: Column) -> Column:
        runs = F.regexp_extract_all(s, F.lit(f"[{marks}]+|[^{marks}]+"), F.lit(0))
        sort = lambda t: lambda run: F.when(
            (F.char_length(run) > 1) & looked_up(t, run).isNotNull(),
            F.array_join(F.transform(F.array_sort(F.transform(F.split(run, ""), lambda c, i: F.struct(looked_up(t, c).alias("r"), i.alias("i"), c.alias("c")))), lambda x: x["c"]), ""),
        ).otherwise(run)
        return let(literal(order, "array<array<int>>"), lambda t: F.array_join(F.transform(runs, sort(t)), ""))

    wide = F.translate(let(replaced, lambda s: F.when(s.rlike(TWO_MARKS), in_order(s)).otherwise(s)), IOTA, IOTA_FOLDED)
    form = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(wide)
    return F.btrim(F.regexp_replace(form, ASCII_SPACE, " "))


def wide_hash(form: Column) -> Column:
    """128 bits: XXH64 with Spark's seed, and with a seed made of the number one."""
    return F.struct(F.xxhash64(form).alias("a"), F.xxhash64(F.lit(1), form).alias("b"))


def named(h: Column, nr: Column) -> Column:
    part = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return F.concat(part(h["a"]), part(h["b"]), F.when(nr > 0, F.concat(F.lit("-"), nr.cast("string"))).otherwise(F.lit("")))


def numbers(forms: DataFrame) -> DataFrame | None:
    """forms (h, form, keys) -> written (keys, nr): the number, from 0, of a form among the unequal ones of its hash; rows of hashes with a
    single form are left out, and without a hash of several forms there is no table."""
    keys = [c for c in forms.columns if c not in ("h", "form")]
    unequal = forms.select("h", "form").distinct()  # byte comparison; copies meet in each task first
    shared = written(unequal.groupBy("h").count().where("count > 1").select(F.col("h").alias("h2")), "digest-clashes")
    if shared.isEmpty():
        return None
    few = written(forms.join(shared, F.col("h") == F.col("h2"), "left_semi").distinct(), "digest-forms")
    ranked = few.select("h", "form").distinct().withColumn("nr", F.row_number().over(W.partitionBy("h").orderBy("form")) - 1)
    ranked = ranked.select(F.col("h").alias("h2"), F.col("form").alias("form2"), "nr")
    return written(few.join(ranked, (F.col("h") == F.col("h2")) & (F.col("form") == F.col("form2"))).select(*keys, "nr"), "digest-nr")


def with_number(rows: DataFrame, nr: DataFrame | None, keys: list[str], name: str = "nr") -> DataFrame:
    return rows.withColumn(name, F.lit(0)) if nr is None else attach(rows, nr.withColumnRenamed("nr", name), keys)


def fingerprinted(docs: DataFrame, hash_of=wide_hash) -> DataFrame:
    """docs with column fingerprint. Texts are read again where their hash is shared, to compare them."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    form = canonical(F.coalesce("text", F.lit("")))
    rows = written(keyed.select("doc_id", "th", form.alias("form")).select("doc_id", "th", hash_of(F.col("form")).alias("h")).distinct(), "digests")
    shared = rows.groupBy("h").count().where("count > 1").select(F.col("h").alias("h2"))
    wanted = written(rows.join(shared, F.col("h") == F.col("h2"), "left_semi"), "digests-shared")
    texts = attach(keyed.select("doc_id", "th", "text"), wanted, ["doc_id", "th"], "inner")
    nr = numbers(texts.select("doc_id", "th", "h", form.alias("form")))
    whole = packed(docs).select("__row", F.col("__row.doc_id").alias("doc_id"), F.xxhash64("__row.text").alias("th"))
    out = with_number(attach(whole, rows, ["doc_id", "th"]), nr, ["doc_id", "th"])
    return unpacked(out.withColumn("fingerprint", named(F.col("h"), F.col("nr"))), "fingerprint")


# --- each document with the next one ---


def bounds(ids: DataFrame, blocks: int) -> list[int]:
    """First ids of the blocks but the first; at most one for each block."""
    first = ids.repartitionByRange(blocks, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"))
    return sorted(r.low for r in first.collect() if r.low is not None)[1:]


def block_of(doc_id: Column, starts: list[int]) -> Column:
    """How many of the starts are at most doc_id: found among the starts of groups of starts, then within the group."""
    if not starts:
        return F.lit(0)
    step = max(1, int(len(starts) ** 0.5))
    groups = [starts[i : i + step] for i in range(0, len(starts), step)]
    table, heads = literal(groups, "array<array<bigint>>"), literal([g[0] for g in groups], "array<bigint>")
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= doc_id))
    group = let(upto(heads), lambda g: F.when(g > 0, (g - 1) * step + upto(F.get(table, g - 1))).otherwise(0))
    return F.coalesce(F.when(doc_id.isNotNull(), group), F.lit(0))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text, columns) with next_doc_id, next_text and next_ of the columns: of the next document by (doc_id, text), of the first after the last."""
    spark = docs.sparkSession
    starts = bounds(docs.select("doc_id"), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    lowest = None if low[1] else low[0]
    own = block_of(F.col("doc_id"), starts)
    first = F.when(F.col("block") > 0, F.col("doc_id") == F.get(literal(starts, "array<bigint>"), F.col("block") - 1)).otherwise(F.col("doc_id").eqNullSafe(F.lit(lowest)))
    before = F.when(F.col("block") > 0, F.col("block") - 1).otherwise(F.lit(len(starts)))
    places = F.when(first, F.array(F.struct("block", F.lit(False).alias("ahead")), F.struct(before.alias("block"), F.lit(True).alias("ahead")))).otherwise(F.array(F.struct("block", F.lit(False).alias("ahead"))))
    rows = docs.withColumn("block", own.cast("int")).select("doc_id", "text", *columns, F.explode(places).alias("at"))
    rows = rows.select("doc_id", "text", *columns, F.col("at.block").alias("block"), F.col("at.ahead").alias("ahead"))
    order = W.partitionBy("block").orderBy("ahead", F.col("doc_id").asc_nulls_first(), "text")
    after = [F.lead(c).over(order).alias(f"next_{c}") for c in ("doc_id", "text", *columns)]
    return rows.select("doc_id", "text", *columns, "ahead", *after).where(~F.col("ahead")).drop("ahead")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by the first as many of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def op2_fingerprints(spark: SparkSession, sf_dir: str, hash_of=wide_hash) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("th", F.xxhash64("text"))
    hashed = keyed.withColumn("form", canonical(F.col("text"))).withColumn("h", hash_of(F.col("form"))).drop("form")
    rows = with_next(hashed, ["th", "h"]).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("e", hash_of(canonical(F.col("edited"))))
    rows = written(
        rows.select("doc_id", "th", "h", "e", "next_doc_id", "next_th", "next_h", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")), "digest-rows"
    )
    # Texts and edited texts whose hash another one has are read again and compared.
    both = rows.select("doc_id", "th", F.lit(None).cast("long").alias("next_doc_id"), F.lit(None).cast("long").alias("next_th"), "h", F.lit(False).alias("edit"))
    both = both.unionByName(rows.select("doc_id", "th", "next_doc_id", "next_th", F.col("e").alias("h"), F.lit(True).alias("edit")))
    shared = both.groupBy("h").count().where("count > 1").select(F.col("h").alias("h2"))
    wanted = written(both.join(shared, F.col("h") == F.col("h2"), "left_semi").distinct(), "digest-wanted")
    ids = wanted.select("doc_id", "th").unionByName(wanted.where("edit").select(F.col("next_doc_id").alias("doc_id"), F.col("next_th").alias("th")))
    texts = written(attach(keyed, written(ids.distinct(), "digest-ids"), ["doc_id", "th"], "inner").distinct(), "digest-texts")
    found = attach(wanted, texts, ["doc_id", "th"], "inner")
    following = texts.select(F.col("doc_id").alias("next_doc_id"), F.col("th").alias("next_th"), F.col("text").alias("following"))
    edits = attach(found.where("edit"), following, ["next_doc_id", "next_th"], "inner").withColumn("text", edited(F.col("text"), F.col("following"))).drop("following")
    nr = numbers(found.where(~F.col("edit")).unionByName(edits).withColumn("form", canonical(F.col("text"))).drop("text"))
    own_nr = edit_nr = next_nr = None
    if nr is not None:
        own_nr = written(nr.where(~F.col("edit")).select("doc_id", "th", "nr").distinct(), "digest-own-nr")
        edit_nr = written(nr.where("edit").select("doc_id", "th", "next_doc_id", "next_th", "nr").distinct(), "digest-edit-nr")
        next_nr = own_nr.select(F.col("doc_id").alias("next_doc_id"), F.col("th").alias("next_th"), "nr")
    rows = with_number(with_number(rows, own_nr, ["doc_id", "th"]), edit_nr, ["doc_id", "th", "next_doc_id", "next_th"], "edit_nr")
    rows = with_number(rows, next_nr, ["next_doc_id", "next_th"], "next_nr")
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    rows = rows.withColumn("fingerprint", named(F.col("h"), F.col("nr"))).withColumn("edited_fingerprint", named(F.col("e"), F.col("edit_nr"))).withColumn("next_fingerprint", named(F.col("next_h"), F.col("next_nr")))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"))
