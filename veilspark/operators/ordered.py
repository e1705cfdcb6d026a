"""Running values in the order of a key's rows, as-of joins and dense stretches, with long keys split into buckets.

A window over a key alone puts all its rows into one task.  Here the order is cut into buckets of ``width``; a
window runs within (key, bucket), a second one over the totals of the buckets, of which there are
few, and both are joined on (key, bucket), by which the rows lie already.  So a key of any length is spread.

Rows whose order is NULL come first, in a bucket of their own; NULL keys are one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where rows without an order stand.
_FIRST = -(1 << 63)


def bucket_of(order: Column, width: int) -> Column:
    """The bucket of a number or a time (microseconds)."""
    return F.coalesce(F.floor(order / width).cast("long"), F.lit(_FIRST))


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str, ties: list[str] = (), width: int = 1024) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the key's rows up to this one; ties of the order are told apart by ``ties``."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.withColumns({"_v": value.cast("long"), "_b": bucket_of(F.col(order), width)})
    totals = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_b").alias("_tb")).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*names).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_t", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    within = Window.partitionBy(*keys, "_b").orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_s", F.sum("_v").over(within))
    same = F.col("_b") == F.col("_tb")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(totals, same).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_s") + F.col("_t")).alias(out))


def positions(df: DataFrame, keys: list[str], order: str, out: str = "pos", ties: list[str] = (), width: int = 1024) -> DataFrame:
    """``df`` with the number of the row in its key, from 1."""
    return running_sum(df, keys, order, F.lit(1), out, ties, width)


def _order(df: DataFrame, name: str) -> Column:
    """A time as microseconds, a date as days, a number as it is."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.unix_date(name) if isinstance(kind, T.DateType) else F.col(name)


def _fair_width(rows: DataFrame) -> float:
    """A width by which a key that had all rows, evenly in its order, would have ROWS_PER_BUCKET in a bucket."""
    low, high, n = rows.agg(F.min("_t"), F.max("_t"), F.count("*")).first()
    return max(1, (high - low) * ROWS_PER_BUCKET / n) if n else 1


#: Rows that a bucket of a key has at most, if its rows lie evenly.
ROWS_PER_BUCKET = 200_000


def as_of_join(
    left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str | None = None, name: str = "as_of",
    strict: bool = False, tolerance: float | None = None, ties: list[str] = (), width: float | None = None,
) -> DataFrame:
    """``left`` with ``name``: a struct of the last row of ``right`` with equal keys that isn't later, NULL if there is none.

    ``strict`` leaves out rows of the same time, ``tolerance`` those that are further back (in units of the time; microseconds for timestamps).  Of
    rows of ``right`` with equal times the one with the greatest ``ties`` counts.  Both sides stand in one window for each (key, bucket of
    time); what earlier buckets have left is carried in from a second, small pass.  ``width`` is that of a bucket; without it one pass over the
    times finds one.  Rows of ``left`` whose key or time is NULL find nothing and aren't shuffled; such rows of ``right`` don't count; repeated rows stay.
    """
    right_time = right_time or time
    k = [f"_k{i}" for i in range(len(keys))]
    known = lambda t: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, t)])
    whole = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    named = [F.col(c).alias(n) for c, n in zip(keys, k, strict=True)]
    value = T.StructType([T.StructField("t", T.DoubleType() if isinstance(right.schema[right_time].dataType, T.FractionalType) else T.LongType()), T.StructField("row", right.schema)])
    here = left.filter(known(time)).select(*named, _order(left, time).alias("_t"), whole(left).alias("_l"))
    there = right.filter(known(right_time)).select(*named, _order(right, right_time).alias("_t"), F.struct(*(F.col(c) for c in ties or [right_time])).alias("_tie"), whole(right).alias("row"))
    there = there.select(*k, "_t", "_tie", F.struct(F.col("_t").alias("t"), "row").cast(value).alias("_r"))
    if width is None:
        width = _fair_width(here.select("_t").unionByName(there.select("_t")))
    here, there = (x.withColumn("_b", bucket_of(F.col("_t"), width)) for x in (here, there))

    ends = there.groupBy(*k, "_b").agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_end"))
    wanted = here.select(*k, "_b").distinct().withColumn("_end", F.lit(None).cast(value))
    before = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = ends.unionByName(wanted).groupBy(*k, "_b").agg(F.first("_end", ignorenulls=True).alias("_end"))
    carried = buckets.select(*k, "_b", F.last("_end", ignorenulls=True).over(before).alias("_carried"))

    tie = there.schema["_tie"].dataType
    both = here.select(*k, "_t", "_b", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(tie).alias("_tie"), "_l", F.lit(None).cast(value).alias("_r"))
    both = both.unionByName(there.select(*k, "_t", "_b", F.lit(1 if strict else 0).alias("_side"), "_tie", F.lit(None).cast(left.schema).alias("_l"), "_r"))
    so_far = Window.partitionBy(*k, "_b").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_seen", F.last("_r", ignorenulls=True).over(so_far)).filter("_l IS NOT NULL").join(carried, [*k, "_b"])
    found = found.withColumn("_found", F.coalesce("_seen", "_carried"))
    near = F.col("_found").isNotNull() if tolerance is None else F.col("_t") - F.col("_found.t") <= tolerance
    out = found.select("_l.*", F.when(near, F.col("_found.row")).alias(name))
    return out.unionByName(left.filter(~known(time)).withColumn(name, F.lit(None).cast(right.schema)))


def densest(df: DataFrame, keys: list[str], order: str, span: int, out: str = "n") -> DataFrame:
    """For each key the ``span`` units of the order that hold most rows, by their first row: keys, order, ``out``. Of several the first counts; rows without an order don't."""
    ahead = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.currentRow, span - 1)
    counted = df.filter(F.col(order).isNotNull()).select(*keys, order, F.count("*").over(ahead).alias(out))
    best = counted.groupBy(*keys).agg(F.max(F.struct(F.col(out).alias("n"), (-F.col(order)).alias("o"))).alias("_m"))
    return best.select(*keys, (-F.col("_m.o")).alias(order), F.col("_m.n").alias(out))
