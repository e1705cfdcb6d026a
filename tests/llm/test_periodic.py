"""Periodic runs against a comparison of every word with the one q behind, for every q."""

import hashlib
import random
import zlib

import duckdb
import pytest

from veilspark.llm import periodic
from veilspark.llm.queries import SQL


def brute_runs(w, power=4, least=6):
    n, out = len(w), {}
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, t - s, q) for (s, t), q in out.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, a = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(a) for _ in range(n)]
    if n and rng.random() < 0.6:
        s, p = rng.randrange(n), rng.randint(1, 9)
        w[s:] = [w[s + i % min(p, n - s)] for i in range(n - s)]
        w += [rng.randrange(a) for _ in range(rng.randint(0, 20))]
    return w * rng.choice([1, 1, 1, 2, 4, 5])


@pytest.mark.parametrize(("power", "least"), [(4, 6), (2, 2), (3, 4)])
def test_runs_against_brute_force(power, least):
    rng, n = random.Random(power), 0
    for _ in range(4_000):
        w = some_words(rng)
        want = brute_runs(w, power, least)
        assert periodic.find_runs(w, power, least) == want, w
        n += len(want)
    assert n > 4_000


def test_factors_are_the_longest_earlier_occurrences():
    rng = random.Random(1)
    for _ in range(500):
        w = some_words(rng)
        at = 0
        for start, end, earlier in periodic.factors(w):
            longest = max((k for k in range(len(w) - start + 1) if any(w[j : j + k] == w[start : start + k] for j in range(start))), default=0)
            assert start == at and end - start == max(1, longest)
            assert earlier < start and (earlier < 0) == (longest == 0) and (earlier < 0 or w[earlier : earlier + end - start] == w[start:end])
            at = end
        assert at == len(w)


def test_long_texts():
    rng = random.Random(2)
    same = ["a"] * 20_000
    assert periodic.find_runs(same) == [(0, 20_000, 1)]
    base = [str(rng.randrange(10**6)) for _ in range(6_000)]
    assert periodic.find_runs(base * 5) == [(0, 30_000, 6_000)]
    assert periodic.find_runs(base * 3) == []


def brute_digest(k, text):
    words = (text or "").encode().split()
    h = None if k is None else zlib.crc32(str(k).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]
    runs = brute_runs(words)
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    longest = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return k, len(runs), *longest, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(words) if i not in gone))


def some_docs():
    rng = random.Random(9)
    docs = [(i, rng.choice([" ", "\n"]).join(f"é{x}" for x in some_words(rng))) for i in range(-20, 150)]
    return docs + [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(120)))) for i in range(200, 300)]


def test_digests_of_odd_rows(frame, odd):
    docs = some_docs() + [(k, t) for k, t in odd if len(t or "") < 100_000] + [(901, "no space here " * 9), (902, "a\x0bb\x0ca\rb " * 6)]
    got = periodic.run_digests(frame(docs))
    assert got.columns == [f.split()[0] for f in periodic.DDL.split(", ")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute_digest(*d) for d in docs), key=repr)
    assert periodic.run_digests(frame([]).filter("false")).count() == 0


def test_sql_against_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    docs = some_docs() + [(400, None), (401, "")]
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = con.execute(SQL["op12_periodic_runs"]).fetchall()
    assert sorted(got) == sorted(brute_digest(*d) for d in docs)


def test_collapsed_texts_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b  c", {"x": 1}), (2, "plain  text", None), (3, None, {})], "doc_id int, text string, m map<string,int>")
    got = {r.doc_id: (r.text, r.m) for r in periodic.without_repetitions(df).collect()}
    assert got == {1: ("a b c", {"x": 1}), 2: ("plain  text", None), 3: (None, {})}
