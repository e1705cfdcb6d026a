"""Aggregations over matches. Only counts leave these reports, never values. Without a detector whole texts are searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.detector import Detector, explode_matches


def match_counts(df: DataFrame, by: list[str], text: str = "text", detector: Detector | None = None) -> DataFrame:
    """Documents that hold a match, for each group and rule; counts are partial before the shuffle."""
    names = F.transform((detector or Detector.whole()).scan(text), lambda m: m["rule_name"])
    per_doc = df.select(*by, F.array_distinct(names).alias("rules"))
    # not explode: for that the optimiser infers a filter on the array and runs the kernel twice
    named = per_doc.select(*by, F.explode_outer("rules").alias("rule_name")).filter("rule_name IS NOT NULL")
    return named.groupBy(*by, "rule_name").agg(F.count("*").alias("n_docs"))


def rollup_counts(df: DataFrame, by: list[str], text: str = "text", detector: Detector | None = None) -> DataFrame:
    matches = explode_matches(df, text, *by, detector=detector)
    return matches.rollup(*by, "rule_name").agg(F.count("*").alias("n_matches"), F.grouping_id().alias("level"))


def top_documents(df: DataFrame, key: str, k: int = 10, text: str = "text", detector: Detector | None = None) -> DataFrame:
    """The k documents with most matches; ties by key."""
    return df.select(key, F.size((detector or Detector.whole()).scan(text)).alias("n_matches")).orderBy(F.desc("n_matches"), key).limit(k)


def audit(df: DataFrame, key: str, text: str = "text", detector: Detector | None = None) -> DataFrame:
    """A row for each document and rule with the number of matches, for a log sink."""
    return explode_matches(df, text, key, detector=detector).groupBy(key, "rule_name").agg(F.count("*").alias("n_matches"))


#: Levels of log lines, least first.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def log_lines(counts: DataFrame, at: Column, level: Column | str = "INFO", least: str = "INFO", name: str = "redact") -> DataFrame:
    """day, level, line: one ``[time] [LEVEL] name {counts as JSON}`` for each row of counts at or over the least level."""
    level = F.lit(level) if isinstance(level, str) else level
    payload = F.to_json(F.struct(*counts.columns))
    lines = counts.select(F.date_format(at, "yyyy-MM-dd").alias("day"), level.alias("level"), F.format_string("[%s] [%s] %s %s", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), level, F.lit(name), payload).alias("line"))
    return lines.filter(F.col("level").isin(*LEVELS[LEVELS.index(least) :]))
