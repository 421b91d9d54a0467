"""URL filters: a blocked Bloom filter of listed URLs in front of an exact hash join. DataFrame functions only.

The filter is a table of 64-bit blocks. A listed URL sets a few bits of one block, a page looks at one block,
so the probe is one equi-join with the blocks. Their number follows from the list's, so that the filter stays
as selective at any length; it is broadcast up to a stated number of blocks, and beyond that pages meet their
block in a shuffled hash join. What passes meets the list itself, which decides alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage

#: Bits of the filter for each listed URL, which let through one page in some 50 that are not listed, and the least number of blocks.
BITS_PER_URL, LEAST_BLOCKS = 12, 1 << 10
#: Blocks that are broadcast at most: a million rows of two longs, some 50 MB as a hash table, for 5.6 million URLs.
BROADCAST_BLOCKS = 1 << 20
#: Bits that one URL sets in its block.
BITS = 4

#: Host suffix, path prefix and verdict of the rules that outrank the list.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without port, ``www.`` or ``m.``, and path without ``.html`` or closing slashes; null for no host."""
    bare = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html?)?/*$", "")))


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, null if none does."""
    fits = []
    for h, p, verdict in rules:
        rule = f"{h}{p}"
        own = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        fits.append(F.when(own, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits)


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _mask(url: Column) -> Column:
    """The bits of a URL in its block, from a hash that is independent of the block's number."""
    h = F.xxhash64(url, F.lit("bits"))
    bits = [F.expr("1L") for _ in range(BITS)]
    shifted = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k, one in enumerate(bits)]
    out = shifted[0]
    for s in shifted[1:]:
        out = out.bitwiseOR(s)
    return out


def bloom_blocks(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """``(block, word)`` of the listed canonical URLs: at most ``blocks`` rows."""
    url = F.col(url_col)
    return listed.where(url.isNotNull()).groupBy(_block(url, blocks).alias("block")).agg(F.bit_or(_mask(url)).alias("word"))


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, blocks: int | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, listed)`` for every row of ``pages``.

    ``listed`` has a column ``url`` of canonical URLs; nulls in it are ignored and repeats count once. The
    verdict is that of the longest fitting rule, else ``block`` for a listed URL, else ``allow``. A null URL,
    or one without ``://``, has an empty host and path, fits no rule, is not listed and is allowed. A very long URL
    is judged whole; rules of one length cannot both fit. Repeated rows and null ids keep their rows; an empty
    table gives an empty result, an empty list blocks nothing; other columns are not read.

    The list is stored once, which gives its count for the filter's size. Pages are read twice, their URLs
    only: those that the filter passes, to meet the list, and those that it clears, which are not shuffled.
    """
    exact = cut_lineage(listed.where("url is not null").select(F.col("url").alias("key")).distinct())
    blocks = blocks or max(LEAST_BLOCKS, -(-exact.count() * BITS_PER_URL // 64))
    bloom = bloom_blocks(exact, "key", blocks)
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom.hint("shuffle_hash")
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumns({"key": canonical(F.col("host"), F.col("path")), "best": best_rule(F.col("host"), F.col("path"), rules)})
    # A page without a key looks for a block of its own that does not exist, each another one.
    own = own.withColumns({"block": F.coalesce(_block(F.col("key"), blocks), -1 - F.abs(F.xxhash64("page_id") % 1_000_003)), "mask": _mask(F.col("key"))})
    probed = own.join(bloom, "block", "left")
    possible = F.col("key").isNotNull() & F.coalesce(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    out = ["page_id", "host", "path", "best", F.coalesce("listed", F.lit(False)).alias("listed")]
    passed = probed.where(possible).select("page_id", "host", "path", "best", "key").join(exact.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "key", "left").select(*out)
    clear = probed.where(~possible).withColumn("listed", F.lit(False)).select(*out)
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return passed.union(clear).select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed")


def repeated_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The list that the query uses: canonical URLs that more than one page has, counted before the shuffle."""
    url = F.col(url_col).cast("string")
    key = canonical(host_of(url), path_of(url))
    return pages.select(key.alias("url")).where("url is not null").groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url")
