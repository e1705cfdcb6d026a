"""Distinct counts: exact ones, and sketches whose states are stored and merged.

Values travel as hashes only (128 bits for exact counts), so no report holds a value.  A state is a
HyperLogLog sketch for each group; states of other loads are merged by union, so a later load never reads an earlier one's rows, and coarser
groups come from finer ones.  NULL values count nowhere; a NULL group is a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of a sketch's registers; the relative standard error is near 0.83 / sqrt(2 ** LG_K).
LG_K = 12


def distinct_cube(df: DataFrame, by: list[str], value: str, out: str = "n_values") -> DataFrame:
    """Exact distinct values for the cube of ``by``: the groups, ``level`` (grouping_id) and ``out``. Repeated values meet before the cube multiplies rows."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.unhex(F.md5(F.col(value).cast("string").cast("binary"))).alias("_v")).distinct()
    return rows.cube(*by).agg(F.grouping_id().alias("level"), F.countDistinct("_v").alias(out))


def sketch_states(df: DataFrame, by: list[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """A state for each group: the groups, ``sketch``, ``n_rows``."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("string").alias("_v"))
    return rows.groupBy(*by).agg(F.hll_sketch_agg("_v", lg_k).alias("sketch"), F.count("*").alias("n_rows"))


def merge_states(states: DataFrame, by: list[str]) -> DataFrame:
    """States of several loads, or of finer groups, as one for each group."""
    return states.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n_rows").alias("n_rows"))


def cube_estimates(states: DataFrame, by: list[str], out: str = "n_values") -> DataFrame:
    """Estimated distinct values for the cube of ``by``, from states alone."""
    return states.cube(*by).agg(F.grouping_id().alias("level"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))


def add_load(states: DataFrame, path: str, load: str) -> None:
    """Store a load's states in a folder of its own under ``path``; a load that is written again replaces itself."""
    states.write.mode("overwrite").parquet(f"{path}/load={load}")


def stored_states(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The states of all loads, merged."""
    return merge_states(spark.read.parquet(path), by)
