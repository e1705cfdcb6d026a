"""The trie of conversations against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from veilspark.llm import trie
from veilspark.llm.common import remove_scratch
from veilspark.llm.queries import SQL

SCHEMA = "conv_id long, turn long, role string, text string, pos int, digest string, m map<string,int>"


def brute_nodes(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    for turns in own.values():
        turns.sort()
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = [t[3:] for t in (own.get(base, [])[:h] + own[c][h:] if rebuild else own[c])]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    out = []

    def below(node):
        leaves, saved = (0, 0) if kids[node] else (1, 0)
        for kid in kids[node]:
            a, b = below(kid)
            leaves, saved = leaves + a, saved + b
        saved += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(kids[node]), leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
        return leaves, saved

    if members:
        below(())
    return sorted(out, key=repr)


def some_rows(seed, n=60, deep=4):
    rng = random.Random(seed)
    rows = []
    for c in range(-10, n):
        if rng.random() < 0.15:
            continue
        for turn in range(rng.choice([1, 2, 3, deep, 12])):
            rows.append((c, rng.choice([turn, turn, turn, 3]), rng.choice(["user", "é", None]) if rng.random() < 0.2 else "user", f"t{turn} {rng.choice('ab') if rng.random() < 0.5 else ''}"))
    rows += [(200, t, "user", f"copy {t}") for t in range(30)] + [(c, t, "user", f"copy {t}") for c in (300, 305, 310) for t in range(30)]
    rows += [(400, None, None, None), (400, None, None, None), (400, 5, "x", "y" * 20_000), (None, 1, "lost", "row"), (400, 5, "x", "y" * 20_000)]
    rng.shuffle(rows)
    return [(*r, 1, "d", {"a": 1}) for r in rows]


@pytest.mark.parametrize("rebuild", [True, False])
def test_nodes_against_brute_force(spark, rebuild):
    rows = some_rows(5)
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), rebuild=rebuild)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_nodes(rows, rebuild)
    remove_scratch(spark)


def test_sql_against_brute_force():
    rows = some_rows(6)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    got = con.execute(SQL["op13_conversation_trie"]).fetchall()
    assert sorted(got, key=repr) == brute_nodes(rows)


@pytest.mark.parametrize("rows", [[], [(7, 0, "user", "a")], [(3, 0, "user", "a")], [(c, 0, "user", "a") for c in range(8)], [(None, 1, "user", "a")]], ids=["none", "one", "turnless", "all equal", "no id"])
def test_small_tables(spark, rows):
    got = trie.conversation_trie(spark.createDataFrame([(*r, 1, "d", None) for r in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_nodes(rows)
    remove_scratch(spark)


def test_ids_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_CHUNK", 7)
    rows = [(c, 0, "user", "same") for c in range(120)]
    got = trie.conversation_trie(spark.createDataFrame([(*r, 1, "d", None) for r in rows], SCHEMA).repartition(5), rebuild=False)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_nodes(rows, False)
    remove_scratch(spark)
