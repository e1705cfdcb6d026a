"""A trie of conversation prefixes, by partition refinement.

All conversations start in one class.  Each round reads one more turn and splits the classes by it: what is left together
has the same turns so far, so a class is a node of the trie.  A class with a single member is retired: the rest
of that member's turns is a chain without branches, which is emitted at the end without further rounds.  Going back from the deepest round
to the first, each class adds up what its parts have.

Members are distinct sequences of turns: conversations with all turns equal are one member with a weight, so that
long copies retire as early as a single conversation does.  A turn travels as the MD5 of its role and text, a class is named by the MD5 of its
parent's name and its turn, so no round has to join members with classes; it joins members with their next turn only.

There are as many rounds as turns that two different conversations begin with, and one more.  A round shuffles the members still
active and their next turns; nothing is gathered by class but sums.  Which conversations end in a node is hashed from
runs of ids in order, joined to strings in parallel and then streamed.  A conversation of any length is numbered in buckets of turns.

Defined results: a NULL role or text is the empty one; NULL turns come first, and equal turns of a conversation stand in the
order of their MD5; repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out;
texts are hashed whole, however long; an empty table gives no rows; columns other than the four named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import discard, written
from veilspark.operators.ordered import positions, running_sum

ROOT = hashlib.md5(b"").digest()
NOBODY = hashlib.sha256(b"").hexdigest()
#: So many ids are joined to one string before they are hashed.
IDS_PER_CHUNK = 4096


def _md5(value: Column) -> Column:
    return F.unhex(F.md5(value))


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), digest of role and text, bytes of the text."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = _md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"))
    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("bytes"))
    return positions(rows.filter("conv IS NOT NULL"), ["conv"], "turn", ties=["digest"]).drop("turn")


def exchanged(turns: DataFrame, group: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that they share beginnings, and all their ids: the first h turns of conversation c - c % group, then c's own ones after its first h; h = crc32(c) % spread."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("size"))
    base = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % spread
    convs = sizes.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")).join(base, "base", "left")
    convs = written(convs.select("conv", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("given")), "conversations")
    head = turns.filter(F.col("pos") < spread).select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    given = head.join(convs, "base").filter("pos <= h").select("conv", "pos", "digest", "bytes")
    own = turns.join(convs, "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "digest", "bytes")
    return given.unionByName(own), convs.select("conv")


def _members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence of turns: rep (smallest conversation), n, len, ends (hash of its conversations' ids)."""
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "pos", "digest"))
    full = turns.groupBy("conv").agg(F.count("*").alias("len"), mark("a").alias("x"), mark("b").alias("y"))
    none = F.lit(0).cast("long")
    full = written(convs.join(full, "conv", "left").select("conv", *(F.coalesce(c, none).alias(c) for c in ("len", "x", "y"))), "sequences")
    key = ["len", "x", "y"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of key and id: ids of one key as strings of up to IDS_PER_CHUNK ids."""
        at, ids = None, []

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(key, at, strict=True), first=ids[0], ids=",".join(map(str, ids)))], _CHUNK)

        for batch in batches:
            for *k, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (k != at or len(ids) == IDS_PER_CHUNK):
                    yield chunk()
                    ids = []
                at = k
                ids.append(conv)
        if ids:
            yield chunk()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks in order of key and first id: a hash for each key; only its state is held."""
        at, state = None, None
        for batch in batches:
            out = []
            for *k, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != at:
                    if state:
                        out.append(dict(zip(key, at, strict=True), ends=state.hexdigest()))
                    at, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(out, _ENDS)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(key, at, strict=True), ends=state.hexdigest())], _ENDS)

    chunks = full.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(joined, "len long, x long, y long, first long, ids string")
    ends = chunks.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "len long, x long, y long, ends string")
    counts = full.groupBy(*key).agg(F.min("conv").alias("rep"), F.count("*").alias("n"))
    return written(counts.join(ends, key).select("rep", "n", "len", "ends"), "members")


_CHUNK = pa.schema([("len", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("len", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends", pa.string())])


def _classes(rows: DataFrame, depth: int) -> DataFrame:
    """A row for each class of a round."""
    sums = rows.groupBy("class").agg(
        F.min("parent").alias("parent"), F.min("rep").alias("conv"), F.sum("n").alias("n_convs"), F.count("*").alias("n_members"),
        F.min("bytes").alias("bytes"), F.min(F.when(F.col("len") == depth, F.col("rep"))).alias("end"),
    )
    return written(sums, f"classes{depth}")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node. ``turns``: conv, pos (1, 2, ...), digest, bytes; ``convs``: conv, all ids once, those without turns too."""
    members = _members(turns, convs)
    wide = turns.join(members.select("rep", "n", "len"), F.col("conv") == F.col("rep")).select("rep", "n", "len", "pos", "digest", "bytes")
    # by depth, so that a round reads its turn only
    wide = written(wide.repartitionByRange("pos", "rep").sortWithinPartitions("pos", "rep"), "turns")

    root = members.select(F.lit(ROOT).alias("class"), F.lit(None).cast("binary").alias("parent"), "rep", "n", "len", F.lit(0).cast("long").alias("bytes"))
    levels, rows, depth = [_classes(root, 0)], None, 0
    while True:
        depth += 1
        turn = wide.filter(F.col("pos") == depth)
        if depth == 1:
            turn = turn.withColumn("parent", F.lit(ROOT))
        else:
            alone = levels[-1].filter("n_members = 1").select(F.col("conv").alias("rep"))
            active = rows.filter(F.col("len") >= depth).join(alone, "rep", "left_anti").select("rep", F.col("class").alias("parent"))
            turn = turn.join(active, "rep")
        last, rows = rows, written(turn.select("rep", "n", "len", "bytes", "parent", _md5(F.concat("parent", "digest")).alias("class")), f"round{depth}")
        if last is not None:
            discard(last)
        if rows.isEmpty():
            break
        levels.append(_classes(rows, depth))
    discard(rows)

    retired = [x.filter("n_members = 1").select("conv", "parent", F.lit(d).cast("long").alias("from")) for d, x in enumerate(levels) if d]
    chains = None
    if retired:
        retired = reduce(DataFrame.unionByName, retired)
        chains = wide.join(retired, F.col("rep") == F.col("conv")).filter(F.col("pos") >= F.col("from")).withColumn("up", -F.col("pos"))
        single = chains.filter("n = 1").withColumn("saved", F.lit(0).cast("long"))
        copies = running_sum(chains.filter("n > 1"), ["rep"], "up", (F.col("n") - 1) * F.col("bytes"), "saved")
        chains = written(single.unionByName(copies).select("rep", "n", "len", "pos", "from", F.when(F.col("pos") == F.col("from"), F.col("parent")).alias("parent"), "saved"), "chains")

    parts, below = [], None
    for d in range(len(levels) - 1, -1, -1):
        own = levels[d].filter("n_members > 1") if d else levels[d]
        if below is not None:
            sums = below.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).withColumnRenamed("parent", "class")
            own = own.join(sums, "class", "left")
        else:
            own = own.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "leaves", "saved")})
        zero = F.lit(0).cast("long")
        folded = own.select("conv", F.lit(d).cast("long").alias("depth"), "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("leaves", zero + 1).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", zero)).alias("saved"), "end")
        parts.append(written(folded, f"folded{d}"))
        below = parts[-1].select("parent", "leaves", "saved")
        if chains is not None:
            below = below.unionByName(chains.filter((F.col("pos") == d) & (F.col("from") == d)).select("parent", F.lit(1).cast("long").alias("leaves"), "saved"))

    nodes = reduce(DataFrame.unionByName, parts).withColumn("up_conv", F.lit(None).cast("long"))
    if chains is not None:
        tail = chains.select(
            F.col("rep").alias("conv"), F.col("pos").alias("depth"), "parent", F.col("n").alias("n_convs"), (F.col("pos") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("leaves"), "saved",
            F.when(F.col("pos") == F.col("len"), F.col("rep")).alias("end"), F.when(F.col("pos") > F.col("from"), F.col("rep")).alias("up_conv"),
        )
        nodes = nodes.unionByName(tail)
    named = reduce(DataFrame.unionByName, [x.filter("n_members > 1 OR parent IS NULL").select(F.col("class").alias("parent"), F.col("conv").alias("parent_conv")) for x in levels])
    ends = members.select(F.col("rep").alias("end"), "ends")
    return nodes.join(named, "parent", "left").join(ends, "end", "left").select(
        "conv", "depth", F.coalesce("up_conv", "parent_conv").alias("parent_conv"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    ).filter("n_convs IS NOT NULL")


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True) -> DataFrame:
    """Nodes of the trie of all conversations, rebuilt (see ``exchanged``) or as they are."""
    turns = written(ordered_turns(df, conv, turn, role, text), "ordered")
    if rebuild:
        rows, convs = exchanged(turns)
        turns = written(rows, "rebuilt")
    else:
        convs = turns.select("conv").distinct()
    found = prefix_trie(turns, convs)
    return found.withColumnsRenamed({"conv": conv, "parent_conv": f"parent_{conv}"})
