"""As-of joins, running sums, intervals, passages and dense stretches against brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.operators.intervals import interval_anti_join, interval_join, interval_semi_join, occurrences
from veilspark.operators.ordered import as_of_join, densest, positions, running_sum


def test_as_of_join_of_one_long_key_against_pandas(spark):
    """10^6 rows of a single key, cut into buckets; none of the windows is that long."""
    rng = random.Random(3)
    left = spark.range(1_000_000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 1_000_003).alias("t"), "id")
    right = spark.createDataFrame([(1, rng.randrange(1_100_000), i) for i in range(3_000)], "k int, t long, v long")
    for strict, tolerance in ((False, None), (True, 200)):
        got = as_of_join(left, right, ["k"], "t", strict=strict, tolerance=tolerance, ties=["v"], width=50_000)
        got = got.select("t", F.col("as_of.v").alias("v")).toPandas().sort_values("t")
        one = right.toPandas().sort_values(["t", "v"]).drop_duplicates("t", keep="last")
        want = pd.merge_asof(got[["t"]], one[["t", "v"]], on="t", allow_exact_matches=not strict, tolerance=tolerance)
        assert len(got) == 1_000_000 and got["v"].astype("Int64").tolist() == want["v"].astype("Int64").tolist()


def test_as_of_join_of_odd_rows(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 5, 1), ("a", None, 2), (None, 5, 3), ("b", 1, 4), ("a", 4, 5), ("a", -3, 6), ("c", 9, 7)], "key string, t long, x int")
    right = spark.createDataFrame([("a", 4, 10), ("a", 4, 11), ("a", None, 12), (None, 1, 13), ("b", 2, 14), ("a", -3, 15), ("c", -900, 16)], "key string, t long, x int")
    for width in (1, 3, 1_000, None):
        for strict in (False, True):
            got = as_of_join(left, right, ["key"], "t", ties=["x"], width=width, strict=strict)
            assert got.columns == ["key", "t", "x", "as_of"]
            found = {(r.x, r.as_of and r.as_of.x) for r in got.collect()}
            assert found == {(1, 11), (2, None), (3, None), (4, None), (5, 15 if strict else 11), (6, None if strict else 15), (7, 16)}
            assert got.count() == 8
    near = as_of_join(left, right, ["key"], "t", ties=["x"], tolerance=1, name="last")
    assert {(r.x, r["last"] and r["last"].x) for r in near.collect()} == {(1, 11), (2, None), (3, None), (4, None), (5, 11), (6, 15), (7, None)}
    assert as_of_join(left.limit(0), right, ["key"], "t").count() == 0
    assert {r.as_of for r in as_of_join(left, right.limit(0), ["key"], "t").collect()} == {None}


def test_as_of_join_takes_times_and_complex_columns(spark):
    rows = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) AS ts, map('a', id) AS m, array(struct(id)) AS s FROM range(20)")
    got = as_of_join(rows, rows.filter("m['a'] % 7 = 0"), ["k"], "ts", tolerance=4 * 60_000_000)
    assert {(r.m["a"], r.as_of and r.as_of.m["a"]) for r in got.collect()} == {(i, i // 7 * 7 if i % 7 <= 4 else None) for i in range(20)}


def test_running_sums_and_positions(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([None, *range(-30, 30)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, i int")
    for width in (1, 7, 1_000):
        got = {r.i: (r.s, r.pos) for r in positions(running_sum(df, ["k"], "o", F.col("i"), "s", ["i"], width), ["k"], "o", ties=["i"], width=width).collect()}
        for k in ("a", None, "b"):
            total = 0
            for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
                total += i
                assert got[i] == (total, n)


def overlap(a, b, slack):
    return a[0] == b[0] and a[0] is not None and None not in (*a[1:3], *b[1:3]) and a[1] < a[2] and b[1] < b[2] and a[1] - slack < b[2] and b[1] < a[2] + slack


def test_interval_joins_against_all_pairs(spark):
    rng = random.Random(4)

    def some(n):
        out = [(rng.choice(["x", "y", "hot", "hot", "hot", None]), s := rng.randrange(-50, 400), s + rng.choice([0, 1, 3, 20, 200]), i) for i in range(n)]
        return out + [("x", None, 4, -1), ("y", 3, None, -2), *out[:3]]

    left, right = some(120), some(90)
    schema = "key string, start int, end int, i int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    for slack, width in ((0, 1024), (0, 16), (5, 7)):
        pairs = [(x, y) for x in left for y in right if overlap(x, y, slack)]
        got = interval_join(a, b, ["key"], slack=slack, width=width)
        assert sorted((tuple(r.left), tuple(r.right)) for r in got.collect()) == sorted(pairs)
        hit = {x for x, _ in pairs}
        order = lambda rows: sorted(rows, key=repr)
        assert order(map(tuple, interval_semi_join(a, b, ["key"], slack=slack, width=width).collect())) == order(x for x in left if x in hit)
        anti = interval_anti_join(a, b, ["key"], slack=slack, width=width)
        assert order(map(tuple, anti.collect())) == order(x for x in left if x not in hit)
        plan = anti._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_anti_join(a, b.limit(0), ["key"]).count() == len(left) and interval_join(a.limit(0), b, ["key"]).count() == 0


def test_occurrences_against_find(spark):
    rng = random.Random(6)
    words = ["aa", "b", "cé", "d.d", "\\E", "$1", "aaaa", "b\nb"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(60)] + [(90, None), (91, ""), (92, "x" * 50_000 + " aa b cé " * 3)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 6, 7])))) for i in range(80)] + [(99, None), (98, "")]
    got = occurrences(spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(items, "item long, text string"), "d", "text", "item", "text")
    want = set()
    for d, text in docs:
        for i, p in items:
            at = (text or "").find(p) if p and len(p.split()) > 2 else -1
            while at >= 0:
                want.add((d, i, at, at + len(p)))
                at = text.find(p, at + len(p))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50 and got.count() == len(want)


def test_densest_stretch(spark):
    df = spark.createDataFrame([("a", 0), ("a", 9), ("a", 10), ("a", 18), ("b", 5), ("b", None), (None, 1), (None, 1)], "k string, start int")
    assert {tuple(r) for r in densest(df, ["k"], "start", 10).collect()} == {("a", 9, 3), ("b", 5, 1), (None, 1, 2)}


@pytest.mark.parametrize("name", ["scan_documents", "matches_by_source", "audit_log", "rule_email", "custom_rule_scan", "scan_cases"])
def test_the_kernel_runs_once(spark, name):
    """An inner generator would have the optimiser compute the array twice."""
    from veilspark.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("ArrowEvalPython") == 1


def test_passages_of_any_length_against_find(spark):
    """Parts of words, blanks and signs too; only NULL and the empty passage stand nowhere."""
    rng = random.Random(9)
    words = ["aa", "b", "cé", "d.d", "\\E", "$1", "aaaa", "b\nb", "https://site.example/a/rather/long/path/of/it", "😀x"]
    docs = [(i, rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(60)] + [(90, None), (91, ""), (92, "x" * 50_000 + " aa b cé " * 3)]
    texts = [t for _, t in docs[:60] if len(t) > 100]
    cut = lambda n: (lambda t, at: t[at : at + n])(rng.choice(texts), rng.randrange(60))
    items = list(enumerate([*words, "a", " ", "  ", "\n", " b ", "b c", "aa b", "é", "none", "a" * 40, *(cut(n) for n in (1, 2, 3, 5, 9, 17, 33, 40) * 5), None, ""]))
    got = occurrences(spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(items, "item long, text string"), "d", "text", "item", "text", least=1)
    want = set()
    for d, text in docs:
        for i, p in items:
            at = (text or "").find(p) if p else -1
            while at >= 0:
                want.add((d, i, at, at + len(p)))
                at = text.find(p, at + len(p))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and len({i for _, i, *_ in want}) > 40


def test_matches_near_passages_takes_short_passages(spark, tmp_path):
    import duckdb

    from veilspark.queries import NEAR, QUERIES, SQL

    docs = [(0, "mail a.b@corp.test now", "en", "s"), (1, "far" + " x" * NEAR + " at 203.0.113.9 up", "en", "s"), (2, "no match, far off", "en", "s"), (3, None, "en", "s")]
    items = [(0, "mail a.b@corp.test now"), (1, "ail"), (2, "t no"), (3, "far"), (4, "x at"), (5, ""), (6, None), (7, " up"), (8, "far off")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id, r.passage_start) for r in QUERIES["matches_near_passages"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0, 0), (0, 1, 1), (0, 2, 17), (1, 4, 3 + 2 * NEAR - 1), (1, 7, 3 + 2 * NEAR + 15)}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert {(r[0], r[4], r[5]) for r in con.execute(SQL["matches_near_passages"]).fetchall()} == got
