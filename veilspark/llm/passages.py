"""Substring dedup: words inside a window of WINDOW words that starts elsewhere too.

Difference-cover anchors: a hash of ANCHOR words is taken only where a word's number modulo
PERIOD is in COVER.  Any two residues have a difference that COVER holds, so two equal
windows of PERIOD - 1 + ANCHOR words share an anchor at the same place within both.  Where
an anchor occurs once, no window around it can repeat.  Around anchors that occur again
matches are extended: runs of windows that share their least GRAM-word hash are held against
each other as a whole, and where one such hash has runs that differ, window by window (each
hashed twice, 64 and 64 bits).  Every repeated window is found, and only runs and windows
are decided, never pairs.

Defined results: NULL and blank texts have no words; a text shorter than a window keeps all;
rows that repeat a key are documents of their own, so equal rows repeat each other: they are searched
once, and one that has a window goes whole, so many equal rows cost no more than as many others.  No
copy of a passage is preferred, so ties don't arise; a NULL key is a key like others; texts are read
whole, however long; an empty table gives no rows; columns other than the two named ones are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.blocks import ALONE, FIRST, ROW_DDL, SPANS_DDL, WHOLE, Rolling, classify, combined, gathered, make_rows, mark_repeats, mix, slices, sorted_rows, spans_of, word_hashes
from veilspark.llm.common import keyed_texts, out_key, packed, partitions, small_batches, unpack, written

WINDOW = 35
PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # differences modulo 21: every residue
ANCHOR = WINDOW - PERIOD + 1
GRAM = 5
assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def _numbers(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of a block: its text, its number in the text, and how many words the text has from it on."""
    doc = np.repeat(np.arange(len(per_text)), per_text)
    first = np.cumsum(per_text) - per_text
    number = np.arange(len(doc)) - first[doc]
    return doc, number, per_text[doc] - number


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[np.ndarray]:
        for batch in small_batches(batches):
            keys, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            data = unpack(batch.column(2))
            for part in slices(data):
                h, per_text = word_hashes(data[part])
                if len(h) < ANCHOR:
                    continue
                doc, number, left = _numbers(per_text)
                # a text shorter than a window has none
                at = np.flatnonzero((left >= ANCHOR) & np.isin(number % PERIOD, COVER) & (per_text[doc] >= WINDOW))
                yield make_rows(mix(Rolling(h).window(at, at + ANCHOR)), 0, keys[part][doc[at]], hashes[part][doc[at]], number[at])

    return combined(parts())


def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows around repeated anchors (k, th, z, starts)."""

    def parts() -> Iterator[np.ndarray]:
        for batch in small_batches(batches):
            keys, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            data, starts = unpack(batch.column(2)), batch.column(3)
            for part in slices(data):
                h, per_text = word_hashes(data[part])
                if len(h) < WINDOW:
                    continue
                doc, number, _ = _numbers(per_text)
                first = np.cumsum(per_text) - per_text
                some = starts.slice(part.start, part.stop - part.start)
                at = some.flatten().to_numpy(zero_copy_only=False) + np.repeat(first, some.value_lengths().to_numpy(zero_copy_only=False))
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, np.maximum(at - PERIOD + 1, first[doc[at]]), 1)
                np.add.at(edge, at + 1, -1)
                start, n, least, content = spans_of(Rolling(h), doc, WINDOW, GRAM, np.cumsum(edge[:-1]) > 0)
                yield make_rows(least, content, keys[part][doc[start]], hashes[part][doc[start]], number[start], n)

    return combined(parts())


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of spans (k, th, z, starts, counts, hs), as two hashes; those of a content that stands elsewhere are several already."""

    def parts() -> Iterator[np.ndarray]:
        for batch in small_batches(batches):
            keys, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            data = unpack(batch.column(2))
            for part in slices(data):
                h, per_text = word_hashes(data[part])
                first = np.cumsum(per_text) - per_text
                start, n, several = (batch.column(c).slice(part.start, part.stop - part.start) for c in (3, 4, 5))
                doc = np.repeat(np.arange(len(per_text)), start.value_lengths().to_numpy(zero_copy_only=False))
                start, n, several = (c.flatten().to_numpy(zero_copy_only=False) for c in (start, n, several))
                number = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc, several = np.repeat(doc, n), np.repeat(several, n)
                at = number + first[doc]
                yield make_rows(*(mix(Rolling(h, w).window(at, at + WINDOW)) for w in (0, 1)), keys[part][doc], hashes[part][doc], number, 1, np.where(several, FIRST, ALONE))

    return combined(parts())


#: In place of a number of windows: all of the text.
ALL = -1


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in [start, start + length) of some run."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + lengths, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for data, starts, counts in zip(unpack(batch.column(2)), batch.column(3), batch.column(4), strict=True):
                words = data.split()
                gone = None
                if starts.is_valid and len(starts):
                    n = np.array(counts.values, np.int64)
                    gone = np.full(len(words), len(words) >= WINDOW) if (n == ALL).any() else covered(len(words), np.array(starts.values), n + WINDOW - 1)
                if digest or gone is not None:
                    data = b" ".join(words if gone is None else compress(words, ~gone))
                rows.append((len(words), 0 if gone is None else int(gone.sum()), sha256(data).hexdigest() if digest else data.decode("utf-8", "surrogatepass")))
            n, removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *batch.columns[5:]]
            yield pa.RecordBatch.from_arrays(columns, ["k", "th", "n_words", "n_removed", "kept", *batch.schema.names[5:]])

    return run


def passage_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, carry: list[str] = ()) -> DataFrame:
    """k, th, n_words, n_removed, kept and the carried columns as c0, c1 ...

    ``kept`` is the text itself where nothing is removed, and otherwise the words that stay, joined by spaces;
    with ``digest`` the SHA-256 of the words that stay, so joined.
    """
    rows, repeated = keyed_texts(df, key, text, carry)
    docs = packed(rows)
    parts = partitions(df.sparkSession)
    single = rows.select("k", "th", "t")
    single = single.dropDuplicates(["k", "th"]) if repeated else single
    texts = packed(single) if repeated else docs.select("k", "th", "z")
    near = gathered(mark_repeats(single.mapInArrow(anchors, ROW_DDL), parts))
    on = lambda marks: (F.col("k") == marks.pk) & (F.col("th") == marks.pth)
    candidates = texts.join(near, on(near)).select("k", "th", "z", "starts")
    # read twice, so computed once
    found = written(sorted_rows(candidates.mapInArrow(spans, ROW_DDL), parts).mapInArrow(lambda batches: classify(batches, 1, False), SPANS_DDL), "passages")
    differ = gathered(found.filter(F.col("kind") != WHOLE), "hs")
    by_window = texts.join(differ, on(differ)).select("k", "th", "z", "starts", "counts", "hs").mapInArrow(windows, ROW_DDL)
    marks = found.filter(F.col("kind") == WHOLE).select("k", "th", "starts", "counts").unionByName(mark_repeats(by_window, parts))
    if repeated:
        several = rows.groupBy("k", "th").agg(F.count("*").alias("c")).filter("c > 1")
        marks = marks.unionByName(several.select("k", "th", F.array(F.lit(0).cast("long")).alias("starts"), F.array(F.lit(ALL)).alias("counts")))
    repeats = gathered(marks)
    extra = [f for f in docs.schema.fields[3:]]
    whole = docs.join(repeats, on(repeats), "left").select("k", "th", "z", "starts", "counts", *(f.name for f in extra))
    fixed = [T.StructField("k", T.LongType()), T.StructField("th", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return whole.mapInArrow(_cut(digest), T.StructType([*fixed, *extra]))


def passage_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256."""
    return passage_dedup(df, key, text, digest=True).select(out_key(key), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def without_passages(df: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The rows with all their columns, repeated passages cut out of the text; ``chars`` names a column with its length."""
    new = {text: F.col("kept")} | ({chars: F.length("kept").cast(df.schema[chars].dataType)} if chars in df.columns else {})
    rest = [c for c in df.columns if c not in new]  # the text goes along once, compressed
    cut = passage_dedup(df, key, text, carry=rest)
    return cut.select(*((new[c] if c in new else F.col(f"c{rest.index(c)}")).alias(c) for c in df.columns))
