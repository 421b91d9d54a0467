"""Connected components of a link table as a chain of Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage


#: Nodes that a task remembers at most before it returns their stars and starts anew.
REMEMBERED = 1_000_000


def spanning_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace one partition's links by stars that join the same nodes: fewer links, same components."""
    parent: dict[int, int] = {}

    def stars() -> Iterator[pd.DataFrame]:
        own = [(x, top) for x in list(parent) if x != (top := root(x))]
        for at in range(0, len(own), 50_000):
            yield pd.DataFrame(own[at : at + 50_000], columns=["u", "v"])

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for part in batches:
        for a, b in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > REMEMBERED:
            yield from stars()
            parent.clear()
    yield from stars()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``; component is the smallest node reachable.

    Alternates large-star and small-star steps: each attaches nodes to the smallest neighbour seen, and
    the graph turns into stars in a logarithmic number of rounds. A round is two aggregations (combined
    before their shuffle, so a hub costs one row per task) and two joins whose larger side Spark may split
    where a hub is hot. Null ends and self-links are ignored; an empty table gives an empty result.
    """
    links = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    links = links.where(F.col("u") != F.col("v")).distinct()
    links = cut_lineage(links.mapInPandas(spanning_links, "u long, v long"))
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or now[0] == 0:
            break
        before = tuple(now)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
