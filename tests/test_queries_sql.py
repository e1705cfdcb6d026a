"""Every query that has SQL, on a fixture that holds what the generated tables lack."""

import datetime
import random
import re

import duckdb
import pandas as pd
import pytest

from veilspark import Detector, queries
from veilspark.functions.entropy import plausible
from veilspark.functions.normalize import normalize_plain
from veilspark.functions.rules import BUILTIN_RULES

from test_redaction import POSITIVE

TABLES = ("documents", "pages", "part", "conversations", "events", "benchmark")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    at = str(tmp_path_factory.mktemp("sf"))
    texts = [t for t, _ in POSITIVE.values()]
    texts += [f"{a}{rng.choice([' ', ', ', '.', '-', chr(10), 'x', '5'])}{b}" for a in texts for b in rng.sample(texts, 6)]
    texts += ["a%2540b.test x%40y.test", "&lt;8.8.8.8&gt; &#64; &#x40;", "AT&T and a & b &lt; c", "&#xD800; &#99999999; &nbsp;&quot;", "Licensed under the X License.\nLicensed under Y", None, ""]
    texts += ["\n\nmy_password = x1234", "  password=abcd", "userspassword=abcd", "secrets = xyzw", "api\\key=abcd1", "apiskey: abcd1", "tokens: abcd", "Auth_token=abcd9"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    urls = [(i, u) for i, u in enumerate(["http://a/%41%zz%4", "b%2520", "%", "plain", "x%e9y", "%%41"])]
    spark.createDataFrame(urls, "page_id long, url string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    spark.range(50).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(1, 0, "user", "mail a@b.test"), (1, 1, "assistant", None), (1, 2, "tool", 'a "quoted" 8.8.8.8\n/x'), (2, 4, "tool", "at 8.8.4.4"), (2, 3, "user", "plain é"), (2, 5, "user", "  ")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{at}/conversations.parquet")
    t0 = datetime.datetime(2024, 1, 1)
    events = [(i, t0 + datetime.timedelta(minutes=rng.choice([rng.randrange(3_000), 60 * rng.randrange(40)])), rng.randrange(3), rng.choice(["click", "purchase"]), float(i), "{}") for i in range(150)]
    # equal times of a user would leave the last click open
    events = list({(t, u): (i, t, u, *rest) for i, t, u, *rest in events}.values())
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    passages = [(i, t) for i, t in enumerate([*texts[:40:3], "two words", "", None, "no text has these words at all", texts[4] + " x"])]
    spark.createDataFrame(passages, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at


def plain(v):
    """A column of whole numbers with NULLs comes as floats from one side."""
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    return int(v) if isinstance(v, float) and v.is_integer() else v


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(repr(tuple(map(plain, row))) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_rule_is_found_in_the_cases(spark, folder):
    found = {r.rule_name for r in queries.QUERIES["rule_cases"](spark, folder).select("rule_name").distinct().collect()}
    assert found == {r.name for r in BUILTIN_RULES}


def test_entropy_query_against_a_search_window_by_window(spark, folder):
    """Besides its SQL."""
    import math
    from collections import Counter

    bits = lambda x: -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())
    got = {}
    for r in queries.QUERIES["scan_entropy"](spark, folder).collect():
        assert abs(r.entropy - bits(r.value)) < 1e-6
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.value))
    other, n = Detector.whole(), 0
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", other.scan("text").alias("m")).collect()
    for row in texts:
        text, at, want = normalize_plain(row.text or ""), 0, []
        while at + 12 <= len(text):
            if bits(text[at : at + 12]) < 3.0:
                at += 4
                continue
            end = at + 12
            while end < len(text) and bits(text[at : end + 1]) >= 3.0:
                end += 1
            if plausible(text[at:end]):
                want.append((at, end, text[at:end]))
            at = end
        # only what no rule's match overlaps, before overlaps among the rules are resolved
        spans = [m.span() for rule in BUILTIN_RULES for m in re.finditer(rule.pattern, text)]
        want = [w for w in want if not any(w[0] < e and w[1] > s for s, e in spans)]
        kept = got.get(row.doc_id, [])
        assert set(want) <= set(kept)
        n += len(want)
    assert n > 1 and set(queries.QUERIES) == set(queries.SQL)


def test_entry_point_lets_real_errors_through(monkeypatch):
    import importlib
    import importlib.util

    import __spark_entry__ as entry

    assert entry._present("veilspark.queries") is queries
    assert entry._present("veilspark.no_such.queries") is None and entry._present("no_such_module") is None

    def fails(name):
        raise ImportError("a dependency is broken")

    monkeypatch.setattr(importlib, "import_module", fails)
    with pytest.raises(ImportError, match="broken"):
        entry._present("veilspark.queries")
