"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at Hamming distance ``radius`` or less have a word between them that is within half
the radius of both. So every distinct fingerprint emits all words of that smaller ball, the words are
shuffled, and fingerprints that meet at a word are linked after their distance is verified. Members of one
word's group are within the radius of each other, so linking each to the group's smallest loses no link of
the components while the links stay linear in the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, free_name
from larkspur.llm.components import connected_components

SEED = 42
SHINGLE = 3
#: Shingles hashed at a time, so that a very long text needs no more memory than this many words of bits.
SLICE = 32_768


def fingerprint(raw: bytes | None) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text: ASCII lower case, ASCII blanks, 3-word shingles with repeats."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - SHINGLE + 1]
    end = end[SHINGLE - 1 :]
    hashed, seed, ones = xxhash.xxh64_intdigest, SEED, np.zeros(64, np.int64)
    for at in range(0, len(start), SLICE):
        pairs = zip(start[at : at + SLICE].tolist(), end[at : at + SLICE].tolist(), strict=True)
        h = np.array([hashed(joined[i:j], seed) for i, j in pairs], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        rest = batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *map(batch.column, rest)], ["doc_id", "fp", *rest])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row; no shuffle. A null text counts as empty: fingerprint zero."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_fingerprints, "doc_id long, fp long")


def row_key(row_id: Column, text: Column) -> Column:
    """A digest that only rows of one id (or none) and one text (or none) share."""
    text = text.cast("string")
    parts = [F.coalesce(row_id.cast("long").cast("string"), F.lit("null")), F.when(text.isNull(), ":null").otherwise(":"), F.coalesce(text, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def ball(radius: int) -> list[int]:
    """XOR masks of all words within ``radius`` bits of zero, as signed 64-bit numbers."""
    masks = [sum(1 << i for i in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(distinct_fp: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links ``(a, b)`` that connect every two fingerprints within ``radius`` (even) bits."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    met = distinct_fp.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"))
    low = F.min("fp").over(Window.partitionBy("word"))
    pairs = met.select("fp", low.alias("low")).where(F.col("fp") != F.col("low"))
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= radius).select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()


def _with_roots(distinct_fp: DataFrame, radius: int) -> DataFrame:
    """``distinct_fp`` with ``root``, the fingerprint that names each one's component."""
    near = connected_components(fingerprint_links(distinct_fp, radius))
    return distinct_fp.join(near.withColumnRenamed("node", "fp"), "fp", "left").select(*distinct_fp.columns, F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for every row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints that differ in ``radius`` bits or fewer.
    Copies share a fingerprint, which takes part once, so a hot group of copies costs nothing after the
    first aggregation. Null or blank texts have fingerprint zero and are linked like any other; very long texts
    are hashed whole, a slice at a time; a bit set in just half of the hashes is 0; repeated rows keep their rows and
    share a component; rows with a null doc_id keep their row and are ignored when the smallest id is chosen; an
    empty table gives an empty result; other columns of ``docs`` are not read.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col))
    distinct_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = _with_roots(distinct_fp, radius)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row of every near-duplicate group of ``docs``, with its own columns.

    It is the row of the smallest id, a null id last, and of these that of the smallest ``row_key``; so rows whose
    id is null stay only if no group member has an id, and groups without ids or with one id keep a row each.
    Rows that share id and text are one document, which leaves one row. Null and blank texts are near each other;
    very long texts are hashed whole; an empty table gives an empty one; columns may have any names.
    """
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    own = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(key).alias("row_key"))
    marked = cut_lineage(own.mapInArrow(_fingerprints, "doc_id long, fp long, row_key string"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key"))
    named = _with_roots(marked.groupBy("fp").agg(F.min(order).alias("first")), radius)
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_key").alias(key))
    return keyed.dropDuplicates([key]).join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
