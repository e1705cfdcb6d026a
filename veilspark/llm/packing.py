"""Packing: shortest-pack-first over the histogram of lengths.

A document's ids, with an end id, are cut into whole sequences and a rest.  The histogram of
the rests has a row for each length below the sequence length, however many documents there
are; it is packed on the driver, longest lengths first, each into the shortest pack that is
open.  That gives patterns with counts.  A rest finds its place by its rank among the rests
of its length.

Ranks are counted per (length, salt) cell and shifted by the cells before it, so that a
length that a third of all documents have is spread over all tasks, and so is a key that they
have: rows are salted by their place in the task that encodes them, and kept in a table.

Defined results: NULL and empty texts have the end id only; a NULL key comes out as NULL;
repeated rows and keys are packed each; equal lengths take any order; a very long text fills whole
sequences and is encoded in one piece, as the library does; an empty table gives no rows; columns other than
the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import partitions, texts, written
from veilspark.llm.vocab import OTHER, byte_encoder, library_tokenizer

SEQUENCE = 1024
END_ID = 0


def encode(text: str, name: str) -> list[int]:
    if OTHER.search(text):
        return library_tokenizer(name).encode(text, add_special_tokens=False).ids
    return byte_encoder(name)(text)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns as (how many sequences, lengths in order)."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}  # room -> packs
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # shortest packs have the most room; what is changed here goes to its new room and may be met again there
        for room in range(size - 1, length - 1, -1):
            while left and open_.get(room):
                count, pack = open_[room].pop()
                used = min(count, left)
                if used < count:
                    open_[room].append((count - used, pack))
                open_.setdefault(room - length, []).append((used, [*pack, length]))
                left -= used
        if left:
            open_.setdefault(size - length, []).append((left, [length]))
    return [pack for room in sorted(open_) for pack in open_[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) for each member of each pattern."""
    next_rank: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = next_rank.get(length, 0)
            next_rank[length] = first + count
            out.append((length, first, first + count, sequence, offset))
            offset += length
        sequence += count
    return out


def document_pieces(df: DataFrame, name: str, key: str, text: str, size: int) -> DataFrame:
    """k, place, doc_tokens, crcs: CRC-32 of each run of ``size`` ids and of the rest; ``place`` is the row's in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        place = context.partitionId() if context else 0  # tasks begin at different salts
        for batch in batches:
            tokens, crcs = [], []
            for t in batch.column(1).to_pylist():
                ids = array("I", encode(t, name))
                ids.append(END_ID)
                data = memoryview(ids.tobytes())
                tokens.append(len(ids))
                crcs.append([zlib.crc32(data[at : at + 4 * size]) for at in range(0, len(data), 4 * size)])
            places = pa.array(range(place, place + batch.num_rows), pa.int64())
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), places, pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["k", "place", "doc_tokens", "crcs"])

    return texts(df, key, text).mapInArrow(run, "k long, place long, doc_tokens long, crcs array<long>")


def pack_documents(df: DataFrame, name: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text", size: int = SEQUENCE) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = written(document_pieces(df, name, key, text, size), "pieces")
    spark = docs.sparkSession
    n = partitions(spark)
    rest, full = F.pmod("doc_tokens", F.lit(size)).cast("int"), F.floor(F.col("doc_tokens") / size)
    docs = docs.withColumns({"rest": rest, "n_full": full.cast("long"), "salt": F.pmod("place", F.lit(n)).cast("int")})
    # at most ``size`` rows
    histogram = {r.rest: r.n for r in docs.filter("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    patterns = shortest_pack_first(histogram, size)
    n_packed = sum(count for count, _ in patterns)
    table = spark.createDataFrame(slots(patterns), "slot_rest int, lo long, hi long, first_sequence long, slot_offset int")

    # what lies before each cell: rests of the same length in lower salts, whole sequences of lower salts
    cells = docs.groupBy("rest", "salt").agg(F.count("*").alias("n"))
    before = cells.select(F.col("rest").alias("c_rest"), F.col("salt").alias("c_salt"), (F.sum("n").over(Window.partitionBy("rest").orderBy("salt")) - F.col("n")).alias("before"))
    wholes = docs.groupBy("salt").agg(F.sum("n_full").alias("w"))  # one row for each salt
    wholes = wholes.select(F.col("salt").alias("w_salt"), (F.sum("w").over(Window.orderBy("salt")) - F.col("w")).alias("whole_before"))

    order = ["k", "doc_tokens", "crcs", "place"]
    dealt = docs.withColumns(
        {
            "rank": F.row_number().over(Window.partitionBy("salt", "rest").orderBy(*order)) - 1,
            "wholes": F.sum("n_full").over(Window.partitionBy("salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    dealt = dealt.join(before, (F.col("rest") == F.col("c_rest")) & (F.col("salt") == F.col("c_salt"))).join(F.broadcast(wholes), F.col("salt") == F.col("w_salt"))
    dealt = dealt.withColumn("rank", F.col("rank") + F.col("before"))
    # the slots follow from the histogram, so their number doesn't grow with the documents
    placed = dealt.join(F.broadcast(table), (F.col("rest") == F.col("slot_rest")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    first_whole = F.lit(n_packed) + F.col("whole_before") + F.coalesce("wholes", F.lit(0))

    def piece(start, length, crc, sequence, offset):
        return F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), crc.alias("ids_crc32"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    whole = F.transform(F.slice("crcs", F.lit(1), F.col("n_full").cast("int")), lambda crc, i: piece(i * size, F.lit(size), crc, first_whole + i, F.lit(0)))
    last = piece(F.col("n_full") * size, F.col("rest"), F.element_at("crcs", -1), F.col("first_sequence") + F.col("rank") - F.col("lo"), F.col("slot_offset"))
    pieces = F.when(F.col("rest") > 0, F.concat(whole, F.array(last))).otherwise(whole)
    return placed.select(F.col("k").alias(key), "doc_tokens", F.inline(pieces)).select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
