"""Vectorised hashing of words, windows and byte strings, and the marking of repeats.

All arithmetic is modulo 2**64.  A rolling sum of mixed values times powers of an odd base
gives the hash of any window as a difference of two sums, so the cost doesn't depend on the
length of the window.  Texts are worked on in pieces of about ``PIECE`` bytes, so that
memory follows the piece and not the text.

``mark_repeats`` finds rows with equal keys.  Tasks first combine what they hold: of equal
rows one travels to the key's partition, the others are known to be repeats and travel
anywhere.  So a key that a third of all documents share brings a row for each task, not for
each document, and the partition streams its sorted rows without ever holding a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 18
#: Rows that a task combines at a time.
COMBINE = 250_000

BASES = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3)
_TO_SPACE = bytes(32 if 9 <= c <= 13 else c for c in range(256))
LOWER_TO_SPACE = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, 1 << max(10, (n - 1).bit_length()))
    return up[:n], down[:n]


@lru_cache(maxsize=4)
def letters(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))


class Rolling:
    """Window hashes over a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, which: int = 0) -> None:
        with np.errstate(over="ignore"):
            up, self.down = powers(BASES[which], len(values) + 1)
            self.sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * up[:-1], out=self.sums[1:])

    def window(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def every(self, n: int) -> np.ndarray:
        """Of each window of n values."""
        with np.errstate(over="ignore"):
            return (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]


def word_hashes(texts: list[bytes], table: bytes = _TO_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, number of words of each text). Words are runs of bytes that ``table`` doesn't map to a space."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends_of_texts = np.cumsum(sizes + 1)
    data = b" ".join(texts).translate(table) + b" "
    hashes, counts, at, n = [], [], 0, len(data)
    while at < n:
        cut = n if n - at <= PIECE else data.rfind(b" ", at, at + PIECE) + 1
        if cut <= at:  # a word longer than the piece
            cut = data.find(b" ", at + PIECE) + 1
        raw = np.frombuffer(data, np.uint8, cut - at, at)
        inside = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            h = Rolling(letters(0)[raw]).window(starts, ends)
            with np.errstate(over="ignore"):
                hashes.append(mix(h + (ends - starts).astype(np.uint64)))
            counts.append(starts + at)
        at = cut
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    where = np.concatenate(counts) if counts else np.empty(0, np.int64)
    per_text = np.diff(np.searchsorted(where, ends_of_texts), prepend=0)
    return h, per_text


def slices(texts: list, size: int = PIECE, length=len) -> Iterator[slice]:
    """Runs of texts of about ``size`` together, at least one."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + length(texts[end]) <= size):
            total += length(texts[end])
            end += 1
        yield slice(at, end)
        at = end


# --- marking -------------------------------------------------------------------------

#: h and c: what must be equal; k and th: the document; w: place, number of windows and state in one.
ROW = np.dtype([("c", "<i8"), ("th", "<i8"), ("h", "<i8"), ("k", "<i8"), ("w", "<i8")])
ROW_DDL = "c long, th long, h long, k long, w long"
ORDER = ("h", "c", "k", "th", "w")
#: state: one of its task; the first of several of its task (or of several already); known to repeat an earlier one of its task.
ALONE, FIRST, KNOWN = 0, 1, 2
_N_BITS, _STATE_BITS = 20, 2


def make_rows(h: np.ndarray, c: np.ndarray | int, k, th, at: np.ndarray, n=1, state=ALONE) -> np.ndarray:
    rows = np.empty(len(h), ROW)
    rows["h"], rows["k"], rows["th"] = h.view(np.int64), k, th
    rows["c"] = c if isinstance(c, int) else c.view(np.int64)
    rows["w"] = (np.asarray(at, np.int64) << (_N_BITS + _STATE_BITS)) | (np.asarray(n, np.int64) << _STATE_BITS) | state
    return rows


def place_of(rows: np.ndarray) -> np.ndarray:
    return rows["w"] >> (_N_BITS + _STATE_BITS)


def windows_of(rows: np.ndarray) -> np.ndarray:
    return (rows["w"] >> _STATE_BITS) & ((1 << _N_BITS) - 1)


def state_of(rows: np.ndarray) -> np.ndarray:
    return rows["w"] & ((1 << _STATE_BITS) - 1)


def to_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[name])) for name in ROW.names], list(ROW.names))


def from_batch(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows, ROW)
    for name in ROW.names:
        out[name] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    return out


def combined(parts: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows as batches; of rows with equal (h, c) in a run of COMBINE rows all but the first in (k, th, place) order are KNOWN."""
    held: list[np.ndarray] = []
    total = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        rows = rows[np.lexsort((rows["w"], rows["th"], rows["k"], rows["c"], rows["h"]))]
        same = np.zeros(len(rows) + 1, bool)
        same[1:-1] = (rows["h"][1:] == rows["h"][:-1]) & (rows["c"][1:] == rows["c"][:-1])
        known, first = same[:-1], ~same[:-1] & same[1:]
        # the first of several speaks for all that were several before, too
        several = np.maximum.reduceat(state_of(rows), np.flatnonzero(~known))[np.cumsum(~known) - 1] if len(rows) else state_of(rows)
        state = np.where(known, KNOWN, np.where(first | (several == FIRST), FIRST, ALONE))
        rows["w"] = (rows["w"] >> _STATE_BITS << _STATE_BITS) | state
        # known rows are dealt evenly
        spread = mix(rows["w"][known].view(np.uint64) * np.uint64(31) + rows["k"][known].view(np.uint64))
        rows["h"][known] = spread.view(np.int64)
        for at in range(0, len(rows), 50_000):
            yield to_batch(rows[at : at + 50_000])

    for part in parts:
        held.append(part)
        total += len(part)
        if total >= COMBINE:
            total = 0
            yield from flush()
    yield from flush()


def sorted_rows(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "h").sortWithinPartitions(*ORDER)


def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows with two flags: an equal one stands before, behind. Rows that are KNOWN equal none here."""
    last, open_ = np.empty(0, ROW), False
    for batch in batches:
        got = np.concatenate((last, from_batch(batch)))
        if not len(got):
            continue
        known = state_of(got) == KNOWN
        same = (got["h"][1:] == got["h"][:-1]) & (got["c"][1:] == got["c"][:-1]) & ~known[1:] & ~known[:-1]
        before = np.concatenate(([open_], same))
        yield got[:-1], before[:-1], same
        # the last row waits for what follows it
        last, open_ = got[-1:], bool(before[-1])
    if len(last):
        yield last, np.array([open_]), np.array([False])


POSITIONS_DDL = "k long, th long, starts array<long>, counts array<int>"
POSITIONS_SCHEMA = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("starts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])


def positions(k: np.ndarray, th: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each document among the rows: its starts and how many windows stand from each."""
    order = np.lexsort((at, th, k))
    k, th, at, n = k[order], th[order], at[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (th[1:] != th[:-1])))) if len(k) else np.empty(0, np.int64)
    offsets = pa.array(np.append(new, len(k)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(th[new]), pa.ListArray.from_arrays(offsets, pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))], schema=POSITIONS_SCHEMA)


def by_document(rows: np.ndarray) -> pa.RecordBatch:
    return positions(rows["k"], rows["th"], place_of(rows), windows_of(rows))


def mark_repeats(rows: DataFrame, parts: int) -> DataFrame:
    """k, th, starts, counts of rows whose (h, c) others have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, before, after in flagged(batches):
            state = state_of(got)
            done = got[before | after | (state != ALONE)]
            if len(done):
                yield by_document(done)

    return sorted_rows(rows, parts).mapInArrow(run, POSITIONS_DDL)


#: What becomes of a span: decided as a whole; gathered with the others of its key; or sent on to be split further.
WHOLE, SORT, WIDE = 0, 1, 2
SPANS_DDL = "kind int, k long, th long, starts array<long>, counts array<int>, hs array<long>"


def classify(batches: Iterator[pa.RecordBatch], most: int, later_only: bool) -> Iterator[pa.RecordBatch]:
    """Spans sorted by key h, content c and place.

    Spans with equal content repeat each other as a whole - with ``later_only``, the first of
    them doesn't.  One span of each content goes on if its key has other contents: to be
    sorted together if there are at most ``most``, otherwise to be split.  ``hs`` is then h, or
    without ``later_only`` whether the content stands elsewhere too.
    """
    last_h: int | None = None
    held: list[np.ndarray] = []  # contents of the key that is still open, at most ``most``
    n_held, hot = 0, False

    def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[np.lexsort((rows["w"], rows["th"], rows["k"]))]
        batch = by_document(rows)
        more = np.zeros(len(rows), np.int64) if kind == WHOLE else np.ascontiguousarray(rows["h"]) if later_only else (state_of(rows) == FIRST).astype(np.int64)
        hs = pa.ListArray.from_arrays(batch.column(2).offsets, pa.array(more))
        return pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, kind, np.int32)), *batch.columns, hs], ["kind", "k", "th", "starts", "counts", "hs"])

    for got, before, after in flagged(batches):
        state = state_of(got)
        whole = got[before | (state == KNOWN) if later_only else before | after | (state != ALONE)]
        if len(whole):
            yield out(WHOLE, whole)
        mine = state != KNOWN
        rows, before, after = got[mine], before[mine], after[mine]
        if not len(rows):
            continue
        rows["w"] |= np.where(after, FIRST, 0)
        new_h = np.concatenate(([rows["h"][0] != last_h], rows["h"][1:] != rows["h"][:-1]))
        last_h = rows["h"][-1]
        group, groups = np.cumsum(new_h)[~before], int(new_h.sum())
        firsts = rows[~before]
        more = firsts[group == 0]
        sort, wide = [], []
        if hot:
            wide.append(more)
        else:
            held.append(more)
            n_held += len(more)
            if n_held > most:
                wide += held
                held, hot = [], True
        if groups:
            if not hot and n_held > 1:
                sort += held
            inner = (group > 0) & (group < groups)
            sizes = np.bincount(group, minlength=groups + 1)[group]
            sort.append(firsts[inner & (sizes > 1) & (sizes <= most)])
            wide.append(firsts[inner & (sizes > most) & (sizes > 1)])
            held, n_held, hot = [firsts[group == groups]], int((group == groups).sum()), False
            if n_held > most:
                wide += held
                held, hot = [], True
        for kind, parts in ((SORT, sort), (WIDE, wide)):
            if sum(map(len, parts)):
                yield out(kind, np.concatenate(parts))
    if not hot and n_held > 1:
        yield out(SORT, np.concatenate(held))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values: suffix minima of blocks against prefix minima of the next ones."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


#: Low bits of a value that hold its place within a piece.
PLACE_BITS = 22


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` consecutive values, the first of equal ones. Worked on in pieces that overlap, so that any place fits."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    step = (1 << PLACE_BITS) - width + 1  # windows of a piece
    places = []
    for at in range(0, len(values) - width + 1, step):
        piece = values[at : at + step + width - 1]
        places.append((sliding_least((piece & ~low) | np.arange(len(piece), dtype=np.uint64), width) & low).astype(np.int64) + at)
    return np.concatenate(places)


def spans_of(rolling: Rolling, doc: np.ndarray, window: int, gram: int, take: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: first window, number of windows, minimizer hash, content hash.

    A minimizer is the least hash of ``gram`` values within a window; equal windows have it at
    the same place. ``doc`` gives the text of each value, windows lie in one text; ``take`` selects windows.
    """
    grams = mix(rolling.every(gram))
    place = least_places(grams, window - gram + 1)
    valid = doc[: len(place)] == doc[window - 1 :]
    if take is not None:
        valid &= take[: len(place)]
    same = valid[1:] & valid[:-1] & (place[1:] == place[:-1]) & (doc[1 : len(place)] == doc[: len(place) - 1])
    first = np.flatnonzero(valid & ~np.concatenate(([False], same)))
    n = np.flatnonzero(valid & ~np.concatenate((same, [False]))) - first + 1
    at = place[first]
    shape = ((at - first) * 4096 + n).astype(np.uint64)
    return first, n, grams[at], mix(rolling.window(first, first + n - 1 + window) ^ mix(shape))


def gathered(marks: DataFrame, *more: str) -> DataFrame:
    """One row for each document: all its starts and counts, and lists that go with them. A document has no more of them than positions."""
    lists = (F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "counts", *more))
    return marks.groupBy(F.col("k").alias("pk"), F.col("th").alias("pth")).agg(*lists)
