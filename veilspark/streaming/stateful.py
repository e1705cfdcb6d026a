"""Windows, sessions and rate alarms over events, for streams and tables alike.

Each function takes a streaming or a batch DataFrame and means the same by both: on a table the watermark has no effect
and every row counts; on a stream rows later than ``late`` behind the newest one are dropped once the watermark has moved on
(for windows and sessions a batch later), and state goes once the watermark has passed it.  ``drained`` runs a stream over all files there are and then closes it, so its result is the batch result
of all rows that weren't too late.  Rows whose time is NULL count in no window; a NULL key is a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.sources.scratch import shared_folder

#: Later than any event: it closes a stream.
_CLOSING = "2262-01-01 00:00:00"
#: Groups of keys that share a state.
BUCKETS = 4_096


def sliding_counts(events: DataFrame, time: str, by: list[str], length: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Rows for each group and sliding window: start, end, the group, n. A row is in length / step windows."""
    windows = events.filter(F.col(time).isNotNull()).withWatermark(time, late).groupBy(F.window(time, length, step).alias("w"), *by).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: rows less than ``gap`` apart belong together. start, end (last row and gap), key, n."""
    merged = events.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return merged.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def rate_alarms(events: DataFrame, key: str, time: str, row_id: str, n: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """An alarm for each row that is the n-th of its key within ``seconds`` or less: key, time, row_id and ``since``, the time of the first of the n.

    Rows of a key count in the order of time and row_id.  On a stream they wait until the watermark has passed them, so that late ones find
    their place; then only the last n - 1 times stay, until they are too old to matter.
    """
    if n < 2:
        raise ValueError("an alarm takes two rows at least")
    kinds = {c: events.schema[c].dataType for c in (key, row_id)}
    rows = events.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).select(key, F.col(time).cast("timestamp").alias(time), row_id)
    if events.isStreaming:
        times, keys = T.ArrayType(T.LongType()), T.ArrayType(kinds[key])
        # many keys share a state, since a call of Python for each key costs more than its rows
        shared = rows.withWatermark(time, late).withColumn("_us", F.unix_micros(time)).withColumn("_bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)))
        found = shared.groupBy("_bucket").applyInPandasWithState(
            _waiting(key, row_id, n, seconds),
            T.StructType([T.StructField(key, kinds[key]), T.StructField("_us", T.LongType()), T.StructField(row_id, kinds[row_id]), T.StructField("_since", T.LongType())]),
            T.StructType([T.StructField("keys", keys), T.StructField("times", times), T.StructField("ids", T.ArrayType(kinds[row_id])), T.StructField("old_keys", keys), T.StructField("old_times", times)]),
            "append", GroupStateTimeout.EventTimeTimeout,
        )
        return found.select(key, F.timestamp_micros("_us").alias(time), row_id, F.timestamp_micros("_since").alias("since"))
    # a key's rows in pieces of time; a piece also sees the rows shortly before it, so that a busy key is no single task
    piece = 64 * seconds * 1_000_000
    at = F.unix_micros(time)
    own = F.floor(at / piece)
    rows = rows.withColumn("_own", own).withColumn("_piece", F.explode(F.when(at - own * piece >= piece - seconds * 1_000_000, F.array(own, own + 1)).otherwise(F.array(own))))
    order = Window.partitionBy(key, "_piece").orderBy(time, row_id)
    first = rows.withColumn("since", F.lag(time, n - 1).over(order)).filter("_own = _piece")
    return first.filter(F.unix_micros(time) - F.unix_micros("since") <= seconds * 1_000_000).select(key, time, row_id, "since")


def _waiting(key: str, row_id: str, n: int, seconds: int):
    """Rows of a bucket's keys wait in the state; once passed, they count and only the last n - 1 times of a key are kept."""
    span = seconds * 1_000_000

    def run(group: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        passed = state.getCurrentWatermarkMs() * 1000
        keys, times, ids, old_keys, old_times = state.get if state.exists else ([], [], [], [], [])
        # times that have counted already come first at their key; they are marked, and raise no alarm
        parts = [pd.DataFrame({"k": keys, "t": times, "i": ids}, dtype=object)] if len(keys) else []
        # Spark drops late rows by the watermark of the batch before
        parts += [pd.DataFrame({"k": f[key].astype(object), "t": f["_us"], "i": f[row_id].astype(object)}) for f in (frame[frame["_us"] > passed] for frame in frames) if len(f)]
        waiting = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"k": [], "t": [], "i": []}, dtype=object)
        waiting = waiting.infer_objects().astype({"t": "int64"})
        due = waiting["t"] <= passed
        done, waiting = waiting[due].assign(new=True), waiting[~due]
        if len(old_keys):
            old = pd.DataFrame({"k": pd.Series(old_keys, dtype=object), "t": pd.Series(old_times, dtype="int64"), "i": None, "new": False})
            done = pd.concat([old, done], ignore_index=True) if len(done) else old
        # by key, and within a key by time and id; a key's old times are never later than those that have just been passed
        done = pd.concat([done[~done["new"]].sort_values("t", kind="stable"), done[done["new"]].sort_values(["t", "i"], kind="stable", na_position="first")])
        by_key = done.groupby("k", sort=False)
        since = by_key["t"].shift(n - 1)
        hit = done["new"] & since.notna()
        hit &= done["t"] - since.where(hit, done["t"]).astype("int64") <= span
        alarms = pd.DataFrame({key: done.loc[hit, "k"], "_us": done.loc[hit, "t"], row_id: done.loc[hit, "i"], "_since": since[hit].astype("int64")})
        recent = by_key.tail(n - 1)
        recent = recent[recent.groupby("k", sort=False)["t"].transform("max") + span >= passed]
        if len(waiting) or len(recent):
            state.update((waiting["k"].tolist(), waiting["t"].tolist(), waiting["i"].tolist(), recent["k"].tolist(), recent["t"].tolist()))
            # when the first of those that wait is passed, or the first of the others is too old
            first = [int(waiting["t"].min())] if len(waiting) else [int(recent.groupby("k", sort=False)["t"].max().min()) + span]
            state.setTimeoutTimestamp(max(first[0] // 1000, passed // 1000) + 1)
        else:
            state.remove()
        yield alarms

    return run


def drained(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], time: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """What the stream that ``build`` makes of the Parquet files at ``path`` appends, all of it.

    The stream runs until no file is left.  If it has state, ``time`` names its event time: a last row far ahead is read from a folder of its own, so that the
    watermark passes all state there is, and the stream goes on from its checkpoint until that is written.
    """
    schema = spark.read.parquet(path).schema
    at = shared_folder(spark, "stream")
    reader = spark.readStream.schema(schema)
    # as a pattern that means the same path: else the source takes it for a folder, which a table of one file isn't
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")
    nothing = spark.createDataFrame([], schema)
    if time:
        nothing.write.parquet(f"{at}/closing")
        stream = stream.unionByName(spark.readStream.schema(schema).parquet(f"{at}/closing"))

    def run() -> None:
        sink = build(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()

    run()
    if time:
        last = [F.lit(_CLOSING).cast(f.dataType).alias(f.name) if f.name == time else _some(f).alias(f.name) for f in schema.fields]
        spark.range(1).select(*last).write.mode("append").parquet(f"{at}/closing")
        run()
    return spark.read.schema(build(nothing).schema).parquet(f"{at}/out")


def _some(field: T.StructField):
    """A value of the closing row: not NULL, so that it is no row that is left out before the watermark is taken."""
    kind = field.dataType
    value = "" if isinstance(kind, (T.StringType, T.BinaryType)) else 0 if isinstance(kind, T.NumericType) else None
    return F.lit(value).cast(kind)
