"""Redaction of streams: stateless in append mode, and counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.detector import Detector


def redact_stream(stream: DataFrame, text: str = "text", detector: Detector | None = None) -> DataFrame:
    """The stream with redacted text and n_redacted. No state, so neither watermark nor late data matter."""
    done = stream.withColumn("_r", (detector or Detector.whole()).filter(text))
    return done.withColumns({text: F.col("_r.text"), "n_redacted": F.col("_r.replacements")}).drop("_r")


def windowed_counts(stream: DataFrame, time: str, text: str = "text", window: str = "5 minutes", late: str = "10 minutes", detector: Detector | None = None) -> DataFrame:
    """Matches for each window and rule; rows later than ``late`` are dropped by the watermark."""
    found = stream.withWatermark(time, late).select(time, F.explode_outer((detector or Detector.whole()).scan(text)).alias("m")).filter("m IS NOT NULL")
    return found.groupBy(F.window(time, window).alias("window"), F.col("m.rule_name").alias("rule_name")).agg(F.count("*").alias("n_matches"))
