"""Sources and sinks: tables by folder, text files, redacted output and the audit log."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.detector import Detector

LOG = logging.getLogger("veilspark")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The rows over all cores if there are at most ``rows``: a small file has one row group, which one task reads.

    A larger table has row groups enough and is left alone, so this never shuffles much. The count comes from the files' footers.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.limit(rows + 1).count() <= rows else df


def read_texts(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """parquet, orc, json, csv or text; whole text files come as path and text."""
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def write_redacted(df: DataFrame, path: str, text: str = "text", detector: Detector | None = None, audit_path: str | None = None, key: str = "doc_id") -> None:
    """Write the table with redacted text, n_redacted and ``redacted_rules``, the names of the rules that matched.

    Whole texts are searched unless a detector with limits is given. With ``audit_path`` counts by key and rule are written too,
    taken from the table just written, so that texts are searched once.
    """
    done = df.withColumn("_r", (detector or Detector.whole()).filter(text))
    names = F.transform("_r.matches", lambda m: m["rule_name"])
    done.withColumns({text: F.col("_r.text"), "n_redacted": F.col("_r.replacements"), "redacted_rules": names}).drop("_r").write.mode("overwrite").parquet(path)
    if audit_path:
        counts = df.sparkSession.read.parquet(path).select(key, F.explode("redacted_rules").alias("rule_name")).groupBy(key, "rule_name").agg(F.count("*").alias("n_matches"))
        counts.write.mode("overwrite").parquet(audit_path)
    LOG.info("redacted table written to %s", path)


def write_log(lines: DataFrame, path: str) -> None:
    """Append log lines (see ``reports.log_lines``) as text files in a folder for each day."""
    lines.select("day", "line").write.mode("append").partitionBy("day").text(path)
