"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspur.session import exists, scratch, shared_folder

__all__ = ["cut_lineage", "exists", "free_name", "scratch", "shared_folder", "table", "texts_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark touches the path, so any store it can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not use, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts_of(column: pa.Array) -> list[str | None]:
    """Python strings of a column; bytes that are no UTF-8, which Spark lets pass, become U+FFFD."""
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]
