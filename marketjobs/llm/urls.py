"""URL filters: path rules, and a blocked Bloom filter before an exact join with listed URLs (DataFrame functions only).

Rules come first; the longest that fits decides. The other URLs are looked up in a list of canonical URLs: the list is hashed
into 256-bit blocks, six bits a URL, all in one block, so a URL is tested with one row of the filter. Only possible hits
go on to the exact join on the canonical URL, which removes the false positives. No listed URL can be missed.

Defined results: null URLs and URLs without `://` have an empty host and path, fit no rule and are allowed unless the list
has their canonical form (the empty string is never listed); repeated rows get the same verdict; an empty list blocks nothing.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, packed, read, unpacked, written

#: (verdict, host, path). Fixed values.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A paragraph of a page.
PARAGRAPH = r"(?s)<p(?:[\x20\x09-\x0D][^>]*)?>(.*?)</p>"
BITS_PER_URL, BLOCK_BITS, HASHES = 12, 256, 6


def lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return df.withColumn("host", lower(part(1))).withColumn("path", part(2))


def canonical() -> Column:
    """Of columns url, host, path: host without www. or m., path without .html and closing slashes, query without tracking parameters, in order."""
    host = F.regexp_replace("host", r"^(?:www|m)\.", "")
    path = F.regexp_replace("path", r"(?:\.html)?/*$", "")
    query = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(?:utm_\w*|ref)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """df (host, path) with rule and rule_verdict of the longest rule that fits; null if none does."""
    name = verdict = F
    for action, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = name.when(fits, F.lit(host + path)), verdict.when(fits, F.lit(action))
    none = F.lit(None).cast("string")
    return df.withColumn("rule", name if rules else none).withColumn("rule_verdict", verdict if rules else none)


def masks(url: Column, blocks: int) -> list[Column]:
    """Block number, and the bits of a URL as the block's words of 64 bits."""
    h = F.xxhash64(F.lit(1), url)
    bits = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(HASHES)]
    words = []
    for w in range(BLOCK_BITS // 64):
        own = [F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")) for b in bits]
        word = own[0]
        for x in own[1:]:
            word = word.bitwiseOR(x)
        words.append(word.alias(f"m{w}"))
    return [F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), *words]


def bloom(listed: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The filter over listed.canonical as a written table (block, w0..), and its number of blocks."""
    blocks = max(1, math.ceil(size * BITS_PER_URL / BLOCK_BITS))
    words = [F.bit_or(f"m{w}").alias(f"w{w}") for w in range(BLOCK_BITS // 64)]
    return written(listed.select(*masks(F.col("canonical"), blocks)).groupBy("block").agg(*words), "bloom"), blocks


def on_list(df: DataFrame, listed: DataFrame) -> DataFrame:
    """df (column canonical, and others) with `possible` (the filter's answer) and `listed` (exact). listed: column canonical, any number of times each."""
    exact = written(listed.where("canonical <> ''").select("canonical").distinct(), "listed-urls")
    table, blocks = bloom(exact, exact.count())
    columns = df.columns
    tested = attach(df.select("*", *masks(F.coalesce(F.col("canonical"), F.lit("")), blocks)), table, ["block"])
    hit = F.lit(True)
    for w in range(BLOCK_BITS // 64):
        hit = hit & (F.col(f"w{w}").bitwiseAND(F.col(f"m{w}")) == F.col(f"m{w}"))
    tested = tested.select(*columns, F.coalesce(hit, F.lit(False)).alias("possible"))
    sure = exact.withColumn("listed", F.lit(True))
    hits = attach(tested.where("possible"), sure, ["canonical"]).withColumn("listed", F.coalesce("listed", F.lit(False)))
    return hits.unionByName(tested.where(~F.col("possible")).withColumn("listed", F.lit(False)))


def judged(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """pages (with a column url) with host, path, canonical, rule, possible, listed and verdict: the rule's, else block for listed URLs and allow for others."""
    rows = packed(pages).withColumn("url", F.col("__row.url"))
    rows = ruled(split_url(rows), rules).withColumn("canonical", canonical())
    free = on_list(rows.where(F.col("rule").isNull()), listed)
    fixed = rows.where(F.col("rule").isNotNull()).withColumn("possible", F.lit(False)).withColumn("listed", F.lit(False))
    out = free.unionByName(fixed)
    out = out.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow")))
    return unpacked(out, "host", "path", "canonical", "rule", "possible", "listed", "verdict")


def mirrors(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages (page_id, url, html) that repeat another page: their paragraphs, byte by byte hashed, are those of a page
    with a smaller id. Pages without paragraphs repeat none. A null id comes after all others, and two null ids do not make a copy."""
    found = F.regexp_extract_all("html", F.lit(PARAGRAPH), F.lit(1))
    rows = split_url(pages).select("page_id", canonical().alias("canonical"), F.when(F.size(found) > 0, F.md5(F.array_join(found, "\n"))).alias("content"))
    rows = written(rows.where("content is not null"), "page-contents")
    first = written(rows.groupBy("content").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("content", "first"), "page-firsts")
    return attach(rows, first, ["content"], "inner").where("page_id > first or page_id is null and first is not null").select("canonical")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judged(pages.select("page_id", "url"), mirrors(pages)).select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
q AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_\w*|ref)='))) AS kept FROM p),
c AS (
  SELECT *, regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:\.html)?/*$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM q),
m AS (SELECT page_id, canonical, regexp_extract_all(html, '(?s)<p(?:[\x20\x09-\x0D][^>]*)?>(.*?)</p>', 1) AS paragraphs FROM c),
k AS (SELECT page_id, canonical, min(page_id) OVER (PARTITION BY md5(array_to_string(paragraphs, chr(10)))) AS first FROM m WHERE len(paragraphs) > 0),
mirrors AS (SELECT DISTINCT canonical FROM k WHERE page_id > first OR page_id IS NULL AND first IS NOT NULL),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b AS (
  SELECT c.page_id, c.url, c.host, c.path, c.canonical, (SELECT max({'n': length(r.h || r.p), 'rule': r.h || r.p, 'v': r.verdict}) FROM r WHERE (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)) AS best FROM c)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, CASE WHEN b.canonical IN (SELECT canonical FROM mirrors WHERE canonical <> '') THEN 'block' ELSE 'allow' END) AS verdict,
  canonical, best IS NULL AND b.canonical IN (SELECT canonical FROM mirrors WHERE canonical <> '') AS listed
FROM b
"""
