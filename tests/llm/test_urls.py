from pyspark.sql import functions as F

from larkspur.llm import urls


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=(0, None, None))[1:]


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/1", "https://example.org/en/12?x=1", "https://example.org/en/2", "http://notexample.org/es/", "x://b.com/de/#a", "http://b.com/fr/", "http://b.com/", "http://org", "http://org/", "a://b://c/d", "http://é.net/ü?q", "http://h.net/a\n/b", "//x.com/de/", "http://com/de/x", "http://x.net/" + "p" * 100_000, "http://M.h.net/p.html", "https://www.h.net:80/p/"]


def test_judgement(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(5, URLS[5], "x"), (None, "http://l.net/p", "x")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("h.net/p",), ("h.net/p",), (None,), ("l.net/p",), ("example.org/en/12",)], "url string")
    for blocks in (1, None):  # one block lets nearly everything through to the exact join
        got = urls.judge_urls(pages, listed, blocks=blocks).collect()
        assert len(got) == len(URLS) + 2
        for r in got:
            u = "http://l.net/p" if r["page_id"] is None else URLS[r["page_id"]]
            host, path, (rule, verdict) = slow(u)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
            hit = u in (URLS[19], URLS[20], "http://l.net/p")
            assert r["verdict"] == (verdict or ("block" if hit else "allow")) and r["listed"] == (hit or u == URLS[5]), u
    assert urls.judge_urls(pages.limit(0), listed).count() == 0 and urls.judge_urls(pages, listed.limit(0)).where("listed").count() == 0


def test_bloom_has_no_false_negative(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h.net/"), "id").alias("url"))
    assert urls.bloom_blocks(listed, "url", 64).count() <= 64
    pages = listed.select(F.lit(1).alias("page_id"), F.concat(F.lit("http://"), "url").alias("url"))
    assert urls.judge_urls(pages, listed, blocks=64).where("listed").count() == 5000
    assert urls.judge_urls(pages.withColumn("url", F.concat("url", F.lit("z"))), listed).where("listed").count() == 0


def test_long_lists(spark, monkeypatch):
    """A filter too large to broadcast gives the same verdicts by a shuffle; its size follows from the list."""
    listed = spark.range(20_000).select(F.concat(F.lit("h.net/"), "id").alias("url"))
    pages = spark.range(0, 40_000, 3).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), "id").alias("url"))
    pages = pages.union(spark.createDataFrame([(None, None), (-1, "http://h.net/" + "7" * 50_000)], "page_id long, url string"))
    near = sorted(map(str, urls.judge_urls(pages, listed).collect()))
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", 100)
    far = urls.judge_urls(pages, listed)
    assert sorted(map(str, far.collect())) == near and far.where("listed").count() == len(range(0, 20_000, 3))
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    # What the filter lets through beside the listed URLs is a small share at any length of the list.
    n = 20_000
    blocks = -(-n * urls.BITS_PER_URL // 64)
    bloom = urls.bloom_blocks(listed, "url", blocks)
    other = spark.range(10**6, 10**6 + 20_000).select(F.concat(F.lit("h.net/"), "id").alias("key")).select(urls._block(F.col("key"), blocks).alias("block"), urls._mask(F.col("key")).alias("mask"))
    assert other.join(bloom, "block").where("word & mask = mask").count() < 0.05 * n
