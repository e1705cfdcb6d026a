"""Periodic runs of words by the algorithm of Kolpakov and Kucherov.

A run is a stretch of consecutive words with a smallest period q that is at least POWER periods and LEAST words long and
that no neighbouring word extends.  A text is factorised (Lempel-Ziv; each factor is the longest beginning of
the rest that starts earlier too, found with a suffix automaton).  Runs that touch a border between factors come from
Main's algorithm: common extensions of the border and of the places q before and behind it, for all q at once by
Z-values.  A run strictly inside a factor is a copy of one in the factor's earlier occurrence.

Only stretches that can hold a run are factorised: behind its first q words every word of a run
stands q words earlier too, so that its previous occurrence is at most q away.  A stretch of m such words has runs
with (POWER - 1) * q <= m only; words whose previous occurrence is farther than that split it, until nothing changes.  This
is exact and leaves little of ordinary text.

Work is linear in a text's words but for the size of the automaton's copied states.  Each row is worked on by itself, without shuffle.

Defined results: NULL and empty texts have no words and no runs; a NULL key comes out as NULL and its text is never rewritten;
of several runs of the greatest length the first counts, then the least period; repeated rows are searched each; texts
are searched whole, however long; an empty table gives no rows; columns other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.common import small_batches, texts

#: Periods and words that a run has at least.
POWER, LEAST = 4, 6


def automaton(w: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Suffix automaton: transitions, and where the strings of a state end first."""
    go, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        new, p = len(go), last
        go.append({})
        length.append(length[last] + 1)
        first.append(i)
        link.append(0)
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go, first


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1), one behind the other."""
    go, first = automaton(w)
    out, at, n = [], 0, len(w)
    while at < n:
        state, end = 0, at
        while end < n and first[nxt := go[state][w[end]]] < end:
            state, end = nxt, end + 1
        if end == at:
            out.append((at, at + 1, -1))
        else:
            out.append((at, end, first[state] - (end - at) + 1))
        at = out[-1][1]
    return out


def z_values(s: list[int]) -> list[int]:
    """For each place the length of the longest beginning of s that stands there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def runs_of(w: list[int], power: int = POWER, least: int = LEAST) -> dict[tuple[int, int], int]:
    """(start, end): smallest period, of all runs of w."""
    n, parts = len(w), factors(w)
    found: dict[tuple[int, int], int] = {}
    by_start: dict[int, list[tuple[int, int]]] = {}

    def add(s: int, t: int, q: int) -> None:
        old = found.get((s, t))
        if old is None or q < old:
            found[s, t] = q
            by_start.setdefault(s, []).append((t, q))

    def candidate(s: int, t: int, q: int) -> None:
        """Of what an extension within the window has found, what is long enough and can't be extended."""
        if t - s >= max(least, power * q) and (s == 0 or w[s - 1] != w[s - 1 + q]) and (t == n or w[t] != w[t - q]):
            add(s, t, q)

    for i in range(1, len(parts) + 1):
        before, b = parts[i - 1][:2]
        end = parts[i][1] if i < len(parts) else n
        # a run that ends in (b, end] starts less than a period before the last factor, which would be longer otherwise
        most = (end - before) // (power - 1)
        low = max(0, before - most - 1)
        here, back = w[b:end], w[low:b][::-1]
        ahead = z_values([*here, -1, *w[low:end]])
        behind = z_values([*back, -1, *w[low:end][::-1]])
        ahead_at, behind_at = len(here) + 1 + b - low, len(back) + 1 + end - b
        for q in range(1, most + 1):
            if b + q <= end:  # a whole period behind the border
                f, g = (ahead[q] if b + q < end else 0), behind[behind_at - q]
                if f + g + q >= power * q:
                    candidate(b - g, b + q + f, q)
            if b - q >= low:  # a whole period before it
                f, g = ahead[ahead_at - q], (behind[q] if b - q > low else 0)
                if f + g + q >= power * q:
                    candidate(b - q - g, b + f, q)
        if i < len(parts) and parts[i][2] >= 0 and end - b > least:
            shift = b - parts[i][2]
            for s in range(b - shift + 1, end - shift):
                for t, q in tuple(by_start.get(s, ())):
                    if t < end - shift:
                        add(s + shift, t + shift, q)
    return found


def stretches(ids: np.ndarray, power: int = POWER, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, first, end): parts of a text that can hold runs; words from ``first`` on stand shortly before too, and a run ends behind it."""
    n = len(ids)
    if n < least:
        return []
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    away = np.full(n, n + 1)
    away[order[1:][same]] = (order[1:] - order[:-1])[same]
    fits = away * (power - 1) <= n
    while True:
        edges = np.flatnonzero(np.diff(fits, prepend=False, append=False))
        first, last = edges[::2], edges[1::2]
        long = np.repeat(last - first, last - first)
        inside = np.flatnonzero(fits)
        out = (away[inside] * (power - 1) > long) | (long < least - 1)
        if not out.any():
            break
        fits[inside[out]] = False
    return [(max(0, x - (y - x) // (power - 1)), x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True)]


def find_runs(words: list, power: int = POWER, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in order of start and period."""
    seen: dict = {}
    ids = [seen.setdefault(x, len(seen)) for x in words]
    found = []
    for start, first, end in stretches(np.array(ids, dtype=np.int64), power, least):
        # the part before ``first`` may hold the end of another stretch's run
        found += [(start + s, t - s, q) for (s, t), q in runs_of(ids[start:end], power, least).items() if start + t > first]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those of a run behind its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for s, size, q in runs:
        gone[s + q : s + size] = b"\1" * (size - q)
    return [x for x, g in zip(words, gone, strict=True) if not g]


def rewritten(words: list, key: int | None) -> list:
    """One text in ten gets a periodic end, as its key says."""
    h = None if key is None else zlib.crc32(str(key).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())],
)
DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(words: list[bytes], power: int = POWER, least: int = LEAST) -> tuple:
    runs = find_runs(words, power, least)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(runs), *tail, sha(listed.encode()), sha(b" ".join(collapse(words, runs)))


def run_digests(df: DataFrame, key: str = "doc_id", text: str = "text", rewrite: bool = True) -> DataFrame:
    """A row for each row of ``df``: how many runs, the longest one, hashes of all runs and of the text without repetitions."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = t.encode("utf-8", "surrogatepass").split()
                rows.append(digest(rewritten(words, k) if rewrite else words))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:], strict=True))], schema=SCHEMA)

    return texts(df, key, text).mapInArrow(search, DDL).withColumnRenamed("doc_id", key)


def without_repetitions(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows, all columns, with runs in ``text`` collapsed to their first period; texts without runs stay as they are, NULL too."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def collapsed(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            words = (t or "").encode("utf-8", "surrogatepass").split()
            runs = find_runs(words)
            out.append(b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass") if runs else t)
        return pa.array(out, pa.string())

    return df.withColumn(text, collapsed(F.col(text)))
