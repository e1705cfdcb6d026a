"""Matches as table functions for SQL.

``explode_matches(text)`` stands in a LATERAL join and gives the matches of one text.  ``scan_table(TABLE(...))`` takes a table whose first column is a key and
whose second is the text, reads it in Arrow batches where its rows lie (or as PARTITION BY deals them) and gives a row for each match with the key as a string.
Both search whole texts unless a detector with limits is registered; a NULL text has no matches, and what has none has no row (in a LEFT JOIN LATERAL neither: Spark
pads no table function in Python).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspark.functions import spans
from veilspark.operators.detector import MATCH, Detector


def register_table_functions(spark: SparkSession, detector: Detector | None = None) -> None:
    kernel = (detector or Detector.whole())._kernel(None, None, False)
    names = [f.name for f in MATCH]
    schema = pa.schema([("key", pa.string()), *MATCH])

    class ExplodeMatches:
        def eval(self, text: str) -> Iterator[tuple]:
            for match in kernel().scan(text) or ():
                yield tuple(match[c] for c in names)

    class ScanTable:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            run, rows = kernel().scan, []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [{"key": None if key is None else str(key), **match} for match in run(text) or ()]
            yield pa.Table.from_pylist(rows, schema)

    fields = spans.MATCH_FIELDS.replace(" end ", " `end` ").replace(", end ", ", `end` ")
    spark.udtf.register("explode_matches", F.udtf(ExplodeMatches, returnType=fields))
    spark.udtf.register("scan_table", F.arrow_udtf(ScanTable, returnType=f"key string, {fields}"))
