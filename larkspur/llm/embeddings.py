"""Embedding near-duplicates over an inverted multi-index.

Unit vectors are cut in halves, each half has its own codebook, and the product of the two is a grid of cells.
A vector is stored in its own cell and visits others in the order of the multi-sequence algorithm: by the sum
of squared distances to the planes that part its halves' cells from the visited ones. It stops at a bound that
is calibrated so that partners at exactly the threshold, in random directions, are met at the target recall.
Whoever meets in a cell is compared exactly, in double precision. Of two vectors the one of the smaller cell
number visits the other, so a pair meets once.

Labels and lengths are apart. How fine a label's grid is follows from its number of vectors, without a largest
size, so that cells stay alike at every size; a label of few vectors is one cell. Work is dealt by cell. A crowded
cell is cut into chunks that are compared pairwise in different tasks, and equal vectors are one class, compared
once. A task returns, for each class, a count and one label, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage
from larkspur.llm.components import connected_components

#: Vectors that a grid's codebooks and bound are fitted on, by lowest hash: so many, and so many for each code.
SAMPLE, SAMPLE_PER_CODE = 8_000, 16
#: Share of partners at the threshold that the traversal must meet.
TARGET_RECALL = 0.9995
#: Vectors of either side that one task compares, on average, and those of a label that one cell holds, on average.
CHUNK, PER_CELL = 1024, 256
#: Labels with a grid that are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Vectors that are placed together.
TOGETHER = 4096


@dataclass
class Grid:
    """Codebooks of both halves and the squared distance at which a traversal ends."""

    codes: tuple[np.ndarray, np.ndarray]
    bound: float

    def margins(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest code of every vector, and squared distances to the planes around the others."""
        out, cut = [], self.codes[0].shape[1]
        for half, codes in zip((unit[:, :cut], unit[:, cut:]), self.codes, strict=True):
            size = (codes**2).sum(1)
            d = size - 2 * half @ codes.T
            own = d.argmin(1)
            apart = np.sqrt(np.maximum(size[:, None] - 2 * codes @ codes.T + size, 0))
            apart[apart < 1e-12] = np.inf
            out.append((own, ((d - d[np.arange(len(d)), own][:, None]) / (2 * apart[own])) ** 2))
        return out

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cell of each vector, and (vector, cell) of all visits in the order of the traversals."""
        (a, first), (b, second) = self.margins(unit)
        row, cell = traverse(first, second, self.bound)
        return a * second.shape[1] + b, row, cell


def traverse(first: np.ndarray, second: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Multi-sequence traversal of many vectors: (vector, cell) by vector, then by the sum of its two margins.

    Cells of a sum above ``bound`` are not met. Both margins are at least zero, so only codes within the bound
    by themselves take part: few for each vector, and their product holds all cells that it visits.
    """
    (r1, c1), (r2, c2) = np.nonzero(first <= bound), np.nonzero(second <= bound)
    start = np.searchsorted(r2, np.arange(len(first) + 1))
    n = (start[1:] - start[:-1])[r1]
    row, a = np.repeat(r1, n), np.repeat(c1, n)
    b = c2[np.repeat(start[r1] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    total = first[row, a] + second[row, b]
    near = total <= bound
    row, cell, total = row[near], (a * second.shape[1] + b)[near], total[near]
    order = np.lexsort((cell, total, row))
    return row[order], cell[order]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe for very large and very small numbers."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _codebook(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    codes = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = ((codes**2).sum(1) - 2 * rows @ codes.T).argmin(1)
        size = np.bincount(near, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, near, rows)
        codes[size > 0] = total[size > 0] / size[size > 0, None]
    return codes


def fit_grid(unit: np.ndarray, codes: int, threshold: float, target: float = TARGET_RECALL, seed: int = 7) -> Grid:
    """Codebooks of ``codes`` entries from sampled unit rows, and the bound from simulated partners."""
    rng = np.random.default_rng(seed)
    cut = max(1, unit.shape[1] // 2)
    grid = Grid((_codebook(unit[:, :cut], codes, rng), _codebook(unit[:, cut:], codes, rng)), np.inf)
    if unit.shape[1] == 1:
        return grid
    base = np.tile(unit[:SAMPLE], (max(1, 16_000 // len(unit)), 1))
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.maximum(np.sqrt((side**2).sum(1))[:, None], 1e-300)
    partner = threshold * base + (1 - threshold**2) ** 0.5 * side
    homes = [own for own, _ in grid.margins(partner)]
    need = sum(m[np.arange(len(base)), home] for (_, m), home in zip(grid.margins(base), homes, strict=True))
    grid.bound = float(np.quantile(need, target))
    return grid


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, one of them not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one length as rows."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _place(grids: dict[tuple[int, int], Grid]):
    """Adds each vector's home cell and the cells of larger number that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                keys = np.stack([batch.column(n).to_numpy() for n in ("size", "level")])
                home, rows, cells = np.zeros(batch.num_rows, np.int64), [], []
                for size, level in np.unique(keys[:, keys[1] > 0], axis=1).T.tolist():
                    own = np.flatnonzero((keys[0] == size) & (keys[1] == level))
                    homes, row, cell = grids[size, level].place(unit_rows(matrix(batch.column("vector").take(pa.array(own)))))
                    home[own] = homes
                    later = cell > homes[row]
                    rows.append(own[row[later]])
                    cells.append(cell[later])
                row, cell = np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *cells])
                order = np.argsort(row, kind="stable")
                offsets = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
                visits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cell[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), visits], [*batch.schema.names, "home", "visits"])

    return run


def _lowest(near: np.ndarray, low: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label of each row and column through the links of a chunk pair, to and fro."""
    most = np.iinfo(np.int64).max
    while True:
        new = np.minimum(low, np.where(near, other[None, :], most).min(1, initial=most))
        new_other = np.minimum(other, np.where(near, new[:, None], most).min(0, initial=most))
        if (new == low).all() and (new_other == other).all():
            return low, other
        low, other = new, new_other


def _compare(threshold: float):
    """Counts and labels of one chunk pair: stored vectors against stored ones of another chunk, or against visitors."""

    def run(part: pa.Table) -> pa.Table:
        unit = unit_rows(matrix(part.column("vector")))
        ids, copies, left = part.column("id").to_numpy(), part.column("copies").to_numpy(), part.column("stored").to_numpy() == 1
        # Within one chunk both sides are the same rows.
        both = part.column("row")[0].as_py() == part.column("column")[0].as_py() if len(part) else False
        right = left if both else ~left
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        l_id, l_n, l_unit = ids[left], copies[left], unit[left]
        r_id, r_n, r_unit = ids[right], copies[right], unit[right]
        for at in range(0, len(l_id), CHUNK):
            for to in range(at if both else 0, len(r_id), CHUNK):
                a, b = slice(at, at + CHUNK), slice(to, to + CHUNK)
                near = l_unit[a] @ r_unit[b].T >= threshold
                if both and at == to:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                low, other = _lowest(near, l_id[a], r_id[b])
                some, touched = near.any(1), near.any(0)
                out.append((l_id[a][some], (near @ r_n[b])[some], low[some]))
                if not (both and at == to):
                    out.append((r_id[b][touched], (l_n[a] @ near)[touched], other[touched]))
        columns = [np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["id", "links", "low"])

    return run


def _levels(classes: DataFrame) -> DataFrame:
    """``(label, size, n, level)`` of labels that have a grid: 2**level codes of each half for their n classes."""
    n = classes.groupBy("label", "size").agg(F.count("*").alias("n"))
    level = F.round(F.log2(F.col("n") / PER_CELL) / 2).cast("int")
    return n.where(F.col("n") > 2 * PER_CELL).select("label", "size", "n", F.greatest(level, F.lit(1)).alias("level"))


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, target: float = TARGET_RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine reaches
    ``threshold``; all ties at it link. Null, empty and zero vectors, and those with a null or non-finite component, link
    with nothing: no links, their own component. Rows of one id count as one vector each: equal ones are each
    other's copies, others have links of their own. A null id has no component, no links and is not kept; an
    empty table gives an empty result; other columns are not read; vectors may have any lengths. Links below
    ``threshold`` are never found; of those above it the traversal meets ``target`` of partners in random
    directions, and more of closer ones.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label"))
    fit_for_links = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    whole = own.where(fit_for_links)
    classes = whole.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # A class has a number of its own, whatever ids its rows have; the stored table keeps it.
    classes = cut_lineage(classes.select("*", F.size("vector").alias("size"), F.monotonically_increasing_id().alias("id")))
    levels = cut_lineage(_levels(classes))
    kinds = levels.groupBy("size", "level").agg(F.sum("n").alias("n"), F.count("*").alias("labels")).collect()
    few = sum(k["labels"] for k in kinds) <= BROADCAST_LABELS
    levels = levels.select("label", "size", "level")
    graded = classes.join(F.broadcast(levels) if few else levels, ["label", "size"], "left").select("id", "label", "size", F.coalesce("level", F.lit(0)).alias("level"), "copies", "vector")
    grids: dict[tuple[int, int], Grid] = {}
    for k in kinds:
        wanted = max(SAMPLE, SAMPLE_PER_CODE << k["level"])
        own_kind = graded.where((F.col("size") == k["size"]) & (F.col("level") == k["level"]))
        share = min(1.0, (2.0 * wanted + 100) / k["n"])
        sample = own_kind.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 40)) / float(1 << 40) <= share).orderBy(F.xxhash64("vector"), "id").limit(wanted).select("vector")
        grids[k["size"], k["level"]] = fit_grid(unit_rows(matrix(sample.toArrow().column(0))), 1 << k["level"], threshold, target)
    placed = cut_lineage(graded.mapInArrow(_place(grids), ", ".join(f"{c} {t}" for c, t in graded.dtypes) + ", home long, visits array<long>"))
    # Members of a cell meet each other and its guests. The counts are a stored table, so that Spark can split the
    # rows of a hot cell where they meet them.
    keys = ["label", "size", "cell"]
    members = placed.withColumn("cell", F.col("home"))
    guests = placed.withColumn("cell", F.explode("visits"))
    crowd = members.select(*keys, F.lit(1).alias("member")).union(guests.select(*keys, F.lit(0).alias("member"))).groupBy(keys).agg(F.sum("member").alias("members"), F.sum(1 - F.col("member")).alias("guests"))
    crowd = crowd.where((F.col("members") > 1) | (F.col("members") > 0) & (F.col("guests") > 0))
    crowd = cut_lineage(crowd.select(*keys, *[F.ceil(F.col(n) / CHUNK).cast("int").alias(n) for n in ("members", "guests")]))
    base = [*keys, "id", "copies", "vector"]
    part_of = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int").alias("part")
    pair = lambda row, column, stored: F.struct(row.cast("int").alias("row"), column.cast("int").alias("column"), F.lit(stored).alias("stored"))
    last = F.col("members") + F.col("guests") - 1
    # Chunk p of the members is a row of pairs (p, p), (p, p + 1), ... and the column of pairs (q, p) of earlier chunks q.
    rows = F.transform(F.sequence(F.col("part"), last), lambda c: pair(F.col("part"), c, 1))
    columns = F.transform(F.filter(F.sequence(F.lit(0), F.col("part")), lambda r: r < F.col("part")), lambda r: pair(r, F.col("part"), 0))
    stored = members.join(crowd, keys).select(*base, part_of("members"), "members", "guests").select(*base, F.inline(F.concat(rows, columns)))
    met_by = F.transform(F.sequence(F.lit(0), F.col("members") - 1), lambda r: pair(r, F.col("members") + F.col("part"), 0))
    visitors = guests.join(crowd, keys).select(*base, part_of("guests"), "members", "guests").select(*base, F.inline(met_by))
    # The joins leave a cell's rows together, which would satisfy the grouping; chunk pairs must part again.
    place = [*keys, "row", "column"]
    met = cut_lineage(stored.unionByName(visitors).repartition(*place).groupBy(*place).applyInArrow(_compare(threshold), "id long, links long, low long"))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(met.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "id")
    named = classes.join(links, "id", "left").join(roots, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # Rows meet their class again by its content, which equal vectors share; hashed, as arrays are slow to sort.
    linked = whole.join(named.hint("shuffle_hash"), ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = own.where(~fit_for_links).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
