"""Streams with state against the same functions on tables, with rows out of order and too late."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilspark.streaming.stateful import drained, rate_alarms, sessions, sliding_counts

START = dt.datetime(2024, 1, 1)
#: file by file: rows out of order within the hour that streams wait, and one that is too late (9)
FILES = [
    [(0, 0, 1), (1, 30, 1), (2, 10, 1), (3, 50, 2), (4, 55, None)],
    [(5, 40, 1), (6, 70, 2), (7, 20, 1), (8, None, 1)],
    [(10, 400, 1), (11, 401, 2)],
    [(14, 403, 2)],
    [(9, 5, 1), (12, 402, 1), (13, 395, 1)],
]
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, props map<string,int>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("events"))
    for i, rows in enumerate(FILES):
        full = [(e, None if m is None else START + dt.timedelta(minutes=m), u, "even" if e % 2 == 0 else "odd", {"k": e}) for e, m, u in rows]
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(at)
        import os
        import time

        # the source takes older files first
        for f in os.listdir(at):
            if f.endswith(".parquet") and not f.startswith("seen"):
                os.rename(f"{at}/{f}", f"{at}/seen{i}.parquet")
                os.utime(f"{at}/seen{i}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return at


BUILDS = {
    "counts": lambda e: sliding_counts(e, "ts", ["event_type"], "30 minutes", "10 minutes", "1 hour"),
    "sessions": lambda e: sessions(e, "ts", "user_id", "25 minutes", "1 hour"),
    "alarms": lambda e: rate_alarms(e, "user_id", "ts", "event_id", 3, 1_200, "1 hour"),
}


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(BUILDS))
def test_stream_equals_table_without_late_rows(spark, folder, name):
    build = BUILDS[name]
    table = spark.read.parquet(folder)
    got = drained(spark, folder, build, time="ts", files_per_batch=1)
    # row 9 comes more than an hour behind the newest row
    assert rows_of(got) == rows_of(build(table.filter("event_id <> 9")))
    assert got.count() > 2 and rows_of(got) != rows_of(build(table))
    # all in one batch nothing is late
    assert rows_of(drained(spark, folder, build, time="ts")) == rows_of(build(table))


def test_alarms_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, START + dt.timedelta(seconds=rng.randrange(200_000)), rng.choice([1, 1, 1, 2, None])) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    for n, seconds in ((2, 60), (4, 600), (3, 3_000)):
        want = set()
        for u in (1, 2):
            mine = sorted((t, e) for e, t, x in rows if x == u)
            want |= {(u, mine[i][1], mine[i - n + 1][0]) for i in range(n - 1, len(mine)) if (mine[i][0] - mine[i - n + 1][0]).total_seconds() <= seconds}
        got = rate_alarms(df, "user_id", "ts", "event_id", n, seconds).select("user_id", "event_id", "since").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 3
    with pytest.raises(ValueError):
        rate_alarms(df, "user_id", "ts", "event_id", 1, 5)


def test_empty_stream_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, n long, start string, _us int").write.parquet(f"{tmp_path}/none")
    for build in BUILDS.values():
        assert drained(spark, f"{tmp_path}/none", build, time="ts").count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    from veilspark.sources.scratch import shared_folder

    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session, "x")


def test_alarms_of_many_keys_share_a_state():
    import pandas as pd

    from veilspark.streaming.stateful import _waiting

    class State:
        exists, get, mark, due = False, None, 0, None

        def getCurrentWatermarkMs(self):
            return self.mark

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutTimestamp(self, ms):
            self.due = ms

    state, run = State(), _waiting("user", "event", 2, 10)
    s = 1_000_000
    rows = pd.DataFrame({"user": ["b", "a", "b", "a"], "_us": [5 * s, 3 * s, 12 * s, 40 * s], "event": [1, 2, 3, 4]})
    assert len(pd.concat(run((0,), iter([rows]), state))) == 0 and state.due == 3_001
    state.mark = 20_000
    assert pd.concat(run((0,), iter([]), state)).values.tolist() == [["b", 12 * s, 3, 5 * s]]
    # both keys' last times: that of b may still matter, that of a may not
    assert state.get[0] == ["a"] and state.get[3:] == (["b"], [12 * s])
    state.mark = 30_000
    late = pd.DataFrame({"user": ["b", "a"], "_us": [22 * s, 45 * s], "event": [5, 6]})
    assert len(pd.concat(run((0,), iter([late]), state))) == 0
    state.mark = 100_000
    assert pd.concat(run((0,), iter([]), state)).values.tolist() == [["a", 45 * s, 6, 40 * s]] and not state.exists
