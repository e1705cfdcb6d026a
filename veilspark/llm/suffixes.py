"""Suffix-array dedup: bytes covered by a LENGTH-byte string that starts earlier too.

The longest previous factor of a suffix is the longest beginning it shares with a suffix that
stands earlier in the text.  In suffix order that is one of two neighbours: the nearest
one before it with a smaller position, or the nearest one behind it.  A window of LENGTH bytes
goes where the longest previous factor is that long; so later copies go and the first stays.

One suffix array of a whole corpus doesn't fit a task, so the suffixes are dealt to tasks by
a key that equal beginnings share: the minimizer of the LENGTH bytes, that is the least hash
of GRAM bytes within them.

1. Consecutive windows with one minimizer form a span of at most some 170 bytes.  Spans that
   equal an earlier span of the corpus have it as previous factor as a whole and need no more.
2. Of a minimizer's spans that differ, each goes with its bytes to the minimizer's task. There
   a suffix array over the spans, by prefix doubling up to LENGTH bytes, with previous and next
   smaller positions and common prefixes gives the longest previous factors.
3. A minimizer with more than HOT different spans isn't gathered: its windows are cut into spans anew,
   by minimizers under another hash, and go through 1 and 2 again; what is still too many then, by the
   hash of the window itself.  The same steps decide at each level.
4. A document's windows are put together; what they cover goes, the first copy stays.

Nothing is dropped at any step: each window is decided in exactly one of them.

Defined results: NULL is the empty text; rows equal in key and text are one document and get
equal results, rows that repeat a key with other texts are ordered by a hash of the text; a
NULL key is the smallest; a text shorter than a window keeps all; long texts are worked on in pieces that
overlap; an empty table gives no rows; columns other than the two named
ones are ignored, whatever their names. Cuts may fall inside a character, so what is kept are bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.blocks import PIECE, ROW_DDL, SORT, SPANS_DDL, WHOLE, WIDE, Rolling, classify, combined, gathered, letters, make_rows, positions, slices, sorted_rows, spans_of
from veilspark.llm.common import keyed_texts, out_key, packed, partitions, small_batches, unpack, written
from veilspark.llm.passages import covered

LENGTH = 100
GRAM = 32
HOT = 1_000
#: Seed and gram length of each level's minimizers; the last one is a window's own hash.
LEVELS = ((1, GRAM), (2, GRAM), (3, LENGTH))
#: Rounds in which places jump to their previous smaller ones before blocks are skipped.
JUMPS = 32
#: Span bytes that a task sorts at a time.
SORTED = 1 << 20


def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[np.ndarray]:
        for batch in small_batches(batches):
            keys, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            data = unpack(batch.column(2))
            for part in slices(data):
                raw = np.frombuffer(b"".join(data[part]), np.uint8)
                sizes = np.fromiter(map(len, data[part]), np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                start = np.cumsum(sizes) - sizes
                # a long text in pieces that overlap by a window less one byte: each window lies in one
                for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
                    piece = slice(at, at + PIECE + LENGTH - 1)
                    if len(raw[piece]) < LENGTH:
                        continue
                    first, n, least, content = spans_of(Rolling(letters(1)[raw[piece]]), doc[piece], LENGTH, GRAM)
                    d = doc[piece][first]
                    yield make_rows(least, content, keys[part][d], hashes[part][d], first + at - start[d], n)

    return combined(parts())


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """k, th, text, starts, counts, minimizers of each row."""
    columns = [batch.column(i) for i in range(6)]
    for i, data in enumerate(unpack(columns[2])):
        yield columns[0][i].as_py(), columns[1][i].as_py(), data, *(np.array(columns[j][i].values) for j in (3, 4, 5))


BODY_DDL = "h long, k long, th long, at long, n int, body binary"


def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of spans (k, th, z, starts, counts, hs)."""
    for batch in small_batches(batches):
        rows: list[tuple] = []
        for k, th, data, starts, counts, hs in _pieces(batch):
            rows += [(h, k, th, at, n, data[at : at + n + LENGTH - 1]) for h, at, n in zip(hs.tolist(), starts.tolist(), counts.tolist(), strict=True)]
            if len(rows) > 20_000:
                yield _bodies(rows)
                rows = []
        if rows:
            yield _bodies(rows)


def _bodies(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["h", "k", "th", "at", "n", "body"])


def prefix_ranks(raw: np.ndarray) -> dict[int, np.ndarray]:
    """For 8, 16, 32, 64 and LENGTH bytes: of each place with so many bytes from it on, the rank of those bytes. Prefix doubling, the last step from two halves that overlap."""
    wide = np.zeros(len(raw) - 7, np.uint64)
    for j in range(8):
        wide = (wide << np.uint64(8)) | raw[j : len(raw) - 7 + j]
    ranks = {8: np.unique(wide, return_inverse=True)[1]}
    for size, step in ((16, 8), (32, 16), (64, 32), (LENGTH, LENGTH - 64)):
        rank = ranks[size - step]
        pair = rank[: len(rank) - step].astype(np.uint64) * np.uint64(len(raw)) + rank[step:].astype(np.uint64)
        ranks[size] = np.unique(pair, return_inverse=True)[1]
    return ranks


def common_prefix(raw: np.ndarray, ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes, LENGTH at most, the places a and b begin with alike."""
    equal = ranks[LENGTH][a] == ranks[LENGTH][b]
    out = np.where(equal, LENGTH, 0)
    some = np.flatnonzero(~equal)
    a, b, n = a[some], b[some], np.zeros(len(some), np.int64)
    for size in (64, 32, 16, 8, 4, 2, 1):
        fits = n + size <= LENGTH
        alike = fits.copy()
        if size >= 8:
            last = len(ranks[size]) - 1
            alike &= ranks[size][np.minimum(a + n, last)] == ranks[size][np.minimum(b + n, last)]
        else:
            for j in range(size):
                alike &= raw[np.minimum(a + n + j, len(raw) - 1)] == raw[np.minimum(b + n + j, len(raw) - 1)]
        n += size * alike
    out[some] = np.minimum(n, LENGTH - 1)
    return out


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1 (values differ).

    All places jump at once along what others have found so far; the few that stand behind long chains after
    JUMPS rounds skip blocks of falling powers of two whose least value is greater.
    """
    at = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero(at >= 0)
    for _ in range(JUMPS):
        open_ = open_[values[at[open_]] > values[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
        if not len(open_):
            return at
    # least[j]: of the 2^j values up to each place
    least = [values.astype(np.int32)]
    while 1 << len(least) <= len(values):
        half = 1 << (len(least) - 1)
        least.append(np.concatenate([least[-1][:half], np.minimum(least[-1][half:], least[-1][:-half])]))
    mine, here = values[open_], at[open_]
    for j in range(len(least) - 1, -1, -1):
        here = np.where((here >= 0) & (least[j][here] > mine), here - (1 << j), here)
    at[open_] = np.maximum(here, -1)
    return at


def longest_previous(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The longest previous factor, LENGTH at most, of each of the places (ascending) among them."""
    ranks = prefix_ranks(raw)
    order = np.argsort(ranks[LENGTH][starts], kind="stable")  # the suffix order; equal beginnings by position
    out = np.zeros(len(starts), np.int64)
    before = previous_smaller(order)
    behind = len(order) - 1 - previous_smaller(order[::-1])[::-1]
    for near, some in ((before, before >= 0), (behind, behind < len(order))):
        mine, theirs = order[some], order[near[some]]
        out[mine] = np.maximum(out[mine], common_prefix(raw, ranks, starts[mine], starts[theirs]))
    return out


def suffix_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, k, th, at, n, body) sorted by minimizer and position: the windows that match an earlier one."""

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        raw = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8)
        n = table.column("n").to_numpy()
        offset = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        row = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        hit = longest_previous(raw, offset[row] + inner) >= LENGTH
        row, inner = row[hit], inner[hit]
        if not len(row):
            return None
        # runs of windows within a span
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1))))
        runs = np.diff(np.append(new, len(row)))
        k, th, at = (table.column(c).to_numpy()[row[new]] for c in ("k", "th", "at"))
        return positions(k, th, at + inner[new], runs)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(5).nbytes
        if size < SORTED:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        h = table.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))  # the last minimizer may go on
        if cut:
            if (out := solve(table.slice(0, cut))) is not None:
                yield out
            held = table.slice(cut).to_batches()
            size = sum(len(b) * 2 * LENGTH for b in held)
    if held and (out := solve(pa.Table.from_batches(held))) is not None:
        yield out


def finer_spans(seed: int, gram: int):
    """Spans (k, th, z, starts, counts, hs) cut anew, by minimizers of another hash or length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            for batch in small_batches(batches):
                for k, th, data, starts, counts, _ in _pieces(batch):
                    raw = np.frombuffer(data, np.uint8)
                    # neighbouring spans are one run of windows; runs go in blocks, one behind the other
                    order = np.argsort(starts)
                    starts, counts = starts[order], counts[order].astype(np.int64)
                    for part in slices(counts.tolist(), PIECE, lambda n: n + LENGTH - 1):
                        first, n = starts[part], counts[part]
                        size = n + LENGTH - 1
                        offset = np.cumsum(size) - size
                        doc = np.repeat(np.arange(len(n)), size)
                        place = first[doc] + np.arange(len(doc)) - offset[doc]
                        at, m, least, content = spans_of(Rolling(letters(seed)[raw[place]], seed % 2), doc, LENGTH, gram)
                        yield make_rows(least, content, k, th, place[at], m)

        return combined(parts())

    return run


RESULT = "k long, th long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for i, data in enumerate(unpack(batch.column(2))):
                starts, counts = batch.column(3)[i], batch.column(4)[i]
                removed, runs, kept = 0, 0, data
                if starts.is_valid and len(starts):
                    gone = covered(len(data), np.array(starts.values), np.array(counts.values, np.int64) + LENGTH - 1)
                    removed, runs = int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((len(data), removed, runs, sha256(kept).hexdigest().encode() if digest else kept))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["k", "th", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def suffix_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, hot: int = HOT) -> DataFrame:
    """k, th, n_bytes, n_removed, n_spans, kept: the bytes that stay, or the SHA-256 of them in hexadecimal."""
    rows, repeated = keyed_texts(df, key, text)
    parts = partitions(df.sparkSession)
    docs = packed(rows)
    rows = rows.dropDuplicates(["k", "th"]) if repeated else rows
    single = packed(rows) if repeated else docs

    def texts_with(found: DataFrame, kind: int) -> DataFrame:
        some = gathered(found.filter(F.col("kind") == kind), "hs")
        return single.join(some, (single.k == some.pk) & (single.th == some.pth)).select("k", "th", "z", "starts", "counts", "hs")

    def decided(dealt: DataFrame, most: int) -> DataFrame:
        # read three times, so computed once
        return written(sorted_rows(dealt, parts).mapInArrow(lambda batches: classify(batches, most, True), SPANS_DDL), "spans")

    found = last = decided(rows.mapInArrow(spans, ROW_DDL), hot)
    for seed, gram in LEVELS[1:]:
        if last.filter(F.col("kind") == WIDE).isEmpty():
            break
        # at the last level windows that share a key are equal, so there are never many
        last = decided(texts_with(last, WIDE).mapInArrow(finer_spans(seed, gram), ROW_DDL), hot if gram < LENGTH else 1 << 40)
        found = found.unionByName(last)

    by_minimizer = texts_with(found, SORT).mapInArrow(bodies, BODY_DDL).repartition(parts, "h").sortWithinPartitions("h", "k", "th", "at")
    marks = found.filter(F.col("kind") == WHOLE).select("k", "th", "starts", "counts")
    marks = marks.unionByName(by_minimizer.mapInArrow(suffix_arrays, "k long, th long, starts array<long>, counts array<int>"))
    all_marks = gathered(marks)
    whole = docs.join(all_marks, (docs.k == all_marks.pk) & (docs.th == all_marks.pth), "left").select("k", "th", "z", "starts", "counts")
    return whole.mapInArrow(_cut(digest), RESULT)


def suffix_digests(df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffix_dedup(df, key, text, True, hot).select(out_key(key), "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
