"""MinHash near-dedup with HyperMinHash registers, banding and exact confirmation.

A document's shingles are hashed once; the first bits of a hash choose one of BUCKETS
buckets, and of the least hash in a bucket a register keeps the number of leading zeros and
MANTISSA further bits.  Empty buckets borrow the register of a bucket chosen by a fixed
random sequence.  Bands of ROWS registers make keys; documents that share a key are
candidates.  A pair at the threshold shares none of the 51 keys with a probability below
2e-9.  Candidates whose Jaccard estimate, corrected for registers that agree by chance, is
more than six deviations below the threshold go; all others are confirmed on full sets.

Groups are never expanded into pairs:

1. Documents with equal sets are one node.
2. In each group of a key every node is held against one other, the group's head: the one that
   shares most keys with others (a source that all copies resemble).  That is a pair for each row.
3. Components of confirmed links.  Only where a key's group still falls into several components
   links may be left that no head shows, and they are sought by what nodes differ in from the head.
   With D(x) = x minus H and H minus x together, the difference of x and y has
   |D(x)| + |D(y)| - 2 |D(x) and D(y)| shingles, and x and y are linked if these are at most t of
   |x| + |y|, t = (100 - percent) / (100 + percent).  So linked nodes share at least
   o = (w(x) + w(y)) / 2 elements of D, w(x) = |D(x)| - t |x|; and o > 0 unless both are linked
   with H.  Hence, with elements in one order, rarest first, the first |D(x)| - o + 1 of x and the
   first |D(y)| - o + 1 of y have one in common.  Nodes of a head are put into classes by w; a node
   emits for each class of partners as many elements as the class' least w demands.  Elements that
   only one node has, or only nodes linked with the head, or only nodes of one component, can't show
   a link: they come first in the order and take their places in the prefix, but are not emitted.  So a
   copy with many edits of its own emits nothing, however many others share its keys.
4. Rows that share (head, classes, element) are groups again, to which 2 and 3 are applied: each
   node against a head of the group; and in those that still fall into several components, nodes
   outside the largest component against nodes of other components.

So no cap drops a candidate. Components are found by alternating stars over tables in the
shared folder; nothing of the size of the corpus reaches the driver.

Defined results: texts without words have an empty set and are linked with nothing; with
fewer words than a shingle has, all of them are one shingle; rows equal in key and text are one
document; rows that repeat a key with other texts are nodes of their own, and component_id is
the smallest key of the component; ties between heads go to the smallest key, which changes no
result; a NULL key counts as the smallest and comes out as NULL; very long texts are hashed in pieces
and confirmed whole; an empty table gives no rows; columns other than the two named ones are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.blocks import LOWER_TO_SPACE, Rolling, mix, slices, word_hashes
from veilspark.llm.common import discard, keyed_texts, packed, small_batches, text_hash, unpack, written

BUCKET_BITS, MANTISSA, ROWS = 8, 10, 5
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
#: Two different minima agree in a register with this probability: equal zeros (1/3) and equal mantissas.
BY_CHANCE = 2.0**-MANTISSA / 3
#: Nodes of a head are put into classes of w as wide as what the head's own size allows, divided by STEPS; far ones into classes that grow by FAR.
STEPS, FAR = 8, 1.25
#: Classes of equal sets with so many documents are dealt over SALTS tasks.
LARGE_CLASS, SALTS = 1_000, 64
HEAD_SALTS = 16
NULL_KEY = -(1 << 63)


@lru_cache(maxsize=1)
def _lenders() -> np.ndarray:
    """For each attempt, from which bucket each empty bucket borrows."""
    return np.random.default_rng(20240501).integers(0, BUCKETS, (48, BUCKETS))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers of sorted distinct 64-bit hashes; a row for each set, zeros for an empty one."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    low = np.uint64(64 - BUCKET_BITS)
    for i, s in enumerate(sets):
        bucket = (s >> low).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        value = (s[first] << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
        zeros = 64 - np.frexp(value.astype(np.float64))[1]
        zeros = np.maximum(zeros, 0)
        rest = (value << zeros.astype(np.uint64)) << np.uint64(1)
        out[i, bucket[first]] = 1 + zeros * (1 << MANTISSA) + (rest >> np.uint64(64 - MANTISSA)).astype(np.int64)
    own = out.copy()
    some = own.any(axis=1)
    for lender in _lenders():
        empty = (out == 0) & some[:, None]
        if not empty.any():
            break
        out = np.where(empty, own[:, lender], out)
    else:
        for i in np.flatnonzero((out == 0).any(axis=1) & some):  # very small sets: the next bucket that has one
            full = np.flatnonzero(out[i])
            out[i] = out[i][full[np.searchsorted(full, np.arange(BUCKETS)) % len(full)]]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """int64 keys, a column for each band."""
    parts = sketch[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from registers, less what agrees by chance."""
    same = float(np.mean(a == b))
    return max(0.0, (same - BY_CHANCE) / (1 - BY_CHANCE))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, per_text = word_hashes(texts, LOWER_TO_SPACE)
    rolling, out, at = Rolling(h), [], 0
    for n in per_text.tolist():
        if n >= k:
            starts = np.arange(at, at + n - k + 1)
            out.append(np.unique(mix(rolling.window(starts, starts + k))))
        elif n:
            whole = rolling.window(np.array([at]), np.array([at + n]))
            out.append(mix(whole + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def exact_set(text: bytes, k: int) -> frozenset:
    words = text.translate(LOWER_TO_SPACE).split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else ())
    return frozenset(zip(*(words[i:] for i in range(k)), strict=False))


SKETCH_DDL = "rid long, k long, n long, d1 long, d2 long, sketch binary"


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data = unpack(batch.column(2))
            for part in slices(data):
                sets = shingle_sets(data[part], k)
                size = part.stop - part.start
                with np.errstate(over="ignore"):
                    d1 = np.array([np.sum(mix(s + np.uint64(11))) for s in sets], np.uint64).view(np.int64)
                    d2 = np.array([np.sum(mix(s ^ np.uint64(0x5555555555555555))) for s in sets], np.uint64).view(np.int64)
                sketch = registers(sets)
                n = np.fromiter(map(len, sets), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, size), batch.column(1).slice(part.start, size), pa.array(n), pa.array(d1), pa.array(d2), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    ["rid", "k", "n", "d1", "d2", "sketch"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, sketch) to (node, n, keys)."""
    for batch in small_batches(batches):
        sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS)
        keys = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS, band_keys(sketch).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], ["node", "n", "keys"])


def _differences(k: int, percent: int):
    """(node, z, root, head, z of the head) to (head, node, root, size, w, class, d): w times 100 + percent, and the elements of D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for batch in small_batches(batches):
            data = unpack(batch.column(1))
            heads = batch.column(3).to_pylist()
            for part in slices(data):
                rows: list[tuple] = []
                for i, own in zip(range(part.start, part.stop), shingle_sets(data[part], k), strict=True):
                    if last is None or last[0] != heads[i]:
                        last = heads[i], shingle_sets([unpack_one(batch.column(4)[i].as_py())], k)[0]
                    d = np.setxor1d(own, last[1], assume_unique=True)
                    w = (100 + percent) * len(d) - (100 - percent) * len(own)
                    rows.append((len(d), w, weight_class(w, len(last[1]), percent), d.view(np.int64)))
                n, w, c, d = zip(*rows, strict=True)
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                size = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).slice(part.start, size) for j in (3, 0, 2)), pa.array(n, pa.int64()), pa.array(w, pa.int64()), pa.array(c, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(d))],
                    ["head", "node", "root", "size", "w", "class", "d"],
                )

    return run


DIFFERENCES_DDL = "head long, node long, root long, size long, w long, class long, d array<long>"


def weight_class(w: int, head_size: int, percent: int) -> int:
    """Below 2 * STEPS if the node is linked with the head; w is at least -(100 - percent) * head_size."""
    unit = max(1, (100 - percent) * head_size)
    above = w + unit
    if above <= 2 * unit:
        return min(2 * STEPS - 1, STEPS * above // unit)
    if above < 5 * unit:
        return STEPS * above // unit
    return 5 * STEPS + int(math.log(above / (5 * unit), FAR))


def prefix_keys(differences: DataFrame, percent: int) -> DataFrame:
    """key, node, root: the useful elements of a node's prefixes, for each class of partners in its head's groups."""
    facts = ["head", "node", "root", "size", "w", "class"]
    linked = F.lit(2 * STEPS)
    each = differences.select(*facts, F.explode("d").alias("h"))
    useful = each.groupBy("head", "h").agg(F.count("*").alias("c"), F.max("class").alias("far"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter((F.col("far") >= linked) & (F.col("lo") != F.col("hi")))
    ordered = each.join(useful.select("head", "h", "c"), ["head", "h"]).groupBy(*facts).agg(F.sort_array(F.collect_list(F.struct("c", "h")))["h"].alias("common"))
    # read twice, so computed once
    ordered = written(ordered, "ordered")
    # a head has some 50 classes; of a class: its least w, its largest size, and up to which w of a partner one of it has a useful element in its prefix
    per_overlap = 2 * (100 + percent)
    kinds = ordered.groupBy("head", "class").agg(F.min("w").alias("least"), F.max("size").alias("most"), F.max(per_overlap * F.size("common") - F.col("w")).alias("bound"), F.count("*").alias("c"))
    kinds = kinds.groupBy("head").agg(F.collect_list(F.struct(F.col("class").alias("other"), "least", "most", "bound", "c")).alias("kinds"))
    # a head that a third of all nodes have is dealt over HEAD_SALTS tasks
    kinds = kinds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HEAD_SALTS - 1))))
    rows = ordered.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(HEAD_SALTS)).cast("int")).join(kinds, ["head", "salt"])

    def emitted(kind):
        """How many of its useful elements the node emits for a class."""
        overlap = F.greatest(F.lit(1), F.ceil((F.col("w") + kind["least"]) / per_overlap).cast("int"))
        some = ((F.col("class") >= linked) | (kind["other"] >= linked)) & (overlap <= F.least("size", kind["most"])) & ((kind["other"] != F.col("class")) | (kind["c"] > 1)) & (F.col("w") <= kind["bound"])
        # the others come first
        return F.when(some, F.greatest(F.lit(0), F.least(F.size("common") - overlap + 1, F.size("common")))).otherwise(0)

    sent = F.filter(F.transform("kinds", lambda x: F.struct(x["other"].alias("other"), emitted(x).alias("n"))), lambda x: x["n"] > 0)
    keys = F.flatten(F.transform(sent, lambda x: F.transform(F.slice("common", F.lit(1), x["n"]), lambda h: F.xxhash64("head", F.least("class", x["other"]), F.greatest("class", x["other"]), h))))
    return rows.withColumn("keys", keys).filter("size(keys) > 0").select("node", "root", F.explode("keys").alias("band"))


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[int, frozenset]] = {}

        def of(side: int, rid: int, z: bytes) -> frozenset:
            """The set of a side; rows come with one side's documents in runs."""
            if side not in last or last[side][0] != rid:
                last[side] = rid, exact_set(unpack_one(z), k)
            return last[side][1]

        for batch in small_batches(batches):
            out = []
            for a, za, sa, b, zb, sb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(sa, np.uint16), np.frombuffer(sb, np.uint16)
                spread = 6 * (0.25 / min(BUCKETS, max(1, len(np.unique(x[0]))))) ** 0.5
                if estimate(*x) < percent / 100 - spread:
                    continue
                p, q = of(0, a, za), of(1, b, zb)
                both = len(p & q)
                if both and 100 * both >= percent * (len(p) + len(q) - both):
                    out.append((a, b))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return run


def unpack_one(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def confirmed(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those linked on full sets, as (u, v)."""
    left = bodies.select(F.col("rid").alias("ra"), F.col("z").alias("za"), F.col("sketch").alias("sa"))
    right = bodies.select(F.col("rid").alias("rb"), F.col("z").alias("zb"), F.col("sketch").alias("sb"))
    rows = pairs.join(left, F.col("a") == F.col("ra")).select("a", "za", "sa", "b").join(right, F.col("b") == F.col("rb"))
    return rows.select("a", "za", "sa", "b", "zb", "sb").mapInArrow(_confirm(k, percent), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that has an edge: root is the smallest node of its component. Alternating large and small stars; each round is a table."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges, old = written(small, "edges"), edges
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def _fits(n: str, m: str, percent: int):
    """Sizes that allow the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def star_pairs(groups: DataFrame) -> DataFrame:
    """The rows of groups (band, node, n, maybe more of the node) with ``head``, ``head_n`` and so on: the node of the group that shares most keys with others."""
    facts = groups.columns[2:]
    sizes = groups.groupBy("band").agg(F.count("*").alias("size"))
    weight = groups.join(sizes, "band").groupBy("node").agg(F.sum("size").alias("weight"))
    heads = groups.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "node", *facts)).alias("head"))
    return groups.join(heads.select("band", F.col("head.node").alias("head"), *(F.col(f"head.{c}").alias(f"head_{c}") for c in facts)), "band")


def split_groups(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the groups that fall into several components, with ``root``."""
    placed = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    return placed.join(split, "band")


def late_links(groups: DataFrame, links: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All links, and the roots: those that heads have shown and those between nodes that no head shows."""
    roots = written(components(links), "roots")
    open_ = written(split_groups(groups.select("band", "node", "n", "head"), roots).filter("node <> head").select("head", "node", "n", "root").distinct(), "open")
    some = open_.select("node").unionByName(open_.select(F.col("head").alias("node"))).distinct()
    bodies = written(bodies.join(some, F.col("rid") == F.col("node"), "left_semi"), "open-bodies")
    mine = bodies.select(F.col("rid").alias("rn"), F.col("z").alias("zn"))
    theirs = bodies.select(F.col("rid").alias("rh"), F.col("z").alias("zh"))
    both = open_.join(mine, F.col("node") == F.col("rn")).select("node", "zn", "root", "head").join(theirs, F.col("head") == F.col("rh")).select("node", "zn", "root", "head", "zh")
    differences = written(both.mapInArrow(_differences(shingle, percent), DIFFERENCES_DDL), "differences")
    sizes = open_.groupBy("node").agg(F.max("n").alias("n"))
    keyed = prefix_keys(differences, percent)
    split = keyed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    narrow = written(keyed.join(split, "band").join(sizes, "node").select("band", "node", "n", "root"), "narrow")

    stars = written(star_pairs(narrow), "narrow-stars")
    discard(differences, open_)
    pairs = stars.filter("root <> head_root").filter(_fits("n", "head_n", percent)).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    more = written(confirmed(pairs, bodies, shingle, percent), "links")
    links = links.unionByName(more)
    roots = written(components(links), "roots")
    left = split_groups(narrow.select("band", "node", "n"), roots)
    # the largest component of each group; of two nodes of different components one is outside it
    major = left.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "root"))["root"].alias("major"))
    left = written(left.join(major, "band"), "narrow-left")
    minor = left.filter("root <> major").select("band", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("root_b"))
    once = (F.col("root") == F.col("major")) | (F.col("node") < F.col("b"))
    crossed = left.join(minor, "band").filter((F.col("root") != F.col("root_b")) & once & _fits("n", "m", percent))
    last = written(confirmed(crossed.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), bodies, shingle, percent), "links")
    discard(bodies, narrow, stars, left)
    if last.isEmpty():
        return links, roots
    links = links.unionByName(last)
    return links, components(links)


def _members(df: DataFrame, key: str, text: str, shingle: int, percent: int) -> tuple[DataFrame, bool]:
    """k, th, n, component_id, root for each row, and whether a key repeats: only ``root`` tells groups apart whose smallest keys are equal."""
    rows, repeated = keyed_texts(df, key, text)
    rid = (F.xxhash64("k", "th") if repeated else F.col("k")).alias("rid")
    single = rows.dropDuplicates(["k", "th"]) if repeated else rows
    sketches = written(single.select(rid, "k", "t").mapInArrow(_sketches(shingle), SKETCH_DDL), "sketches")

    classes = written(sketches.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("rid").alias("node"), F.count("*").alias("size")), "classes")
    nodes = classes.select("node", "n").join(sketches.select("rid", "sketch"), F.col("node") == F.col("rid")).select("node", "n", "sketch")
    nodes = nodes.mapInArrow(_keys, "node long, n long, keys array<long>")
    bands = written(nodes.select("node", "n", F.explode("keys").alias("band")), "bands")
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band")
    groups = written(star_pairs(bands.join(shared, "band")), "groups")
    discard(bands)

    # the texts of nodes that share a key with another
    some = groups.select("node").distinct()
    registers_of = sketches.select(F.col("rid").alias("srid"), "sketch")
    bodies = packed(single).select(rid, "z").join(some, F.col("rid") == F.col("node"), "left_semi").join(registers_of, F.col("rid") == F.col("srid")).select("rid", "z", "sketch")
    bodies = written(bodies, "bodies")

    pairs = groups.filter(F.col("node") != F.col("head")).filter(_fits("n", "head_n", percent)).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    links = written(confirmed(pairs, bodies, shingle, percent), "links")
    _, roots = late_links(groups, links, bodies, shingle, percent)
    discard(bodies, groups)

    # a class of many documents is dealt over SALTS tasks, the others meet theirs as a whole
    rooted = classes.join(roots, "node", "left").select("d1", "d2", "n", "size", F.coalesce("root", "node").alias("root"))
    salted = sketches.select("rid", "k", "n", "d1", "d2", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt"))
    large = rooted.filter(F.col("size") >= LARGE_CLASS).select("d1", "d2", "n", "root", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    first = written(salted.join(large, ["d1", "d2", "n", "salt"], "left"), "members")
    others = first.filter("root IS NULL").drop("root").join(rooted.filter(F.col("size") < LARGE_CLASS), ["d1", "d2", "n"], "left")
    member = first.filter("root IS NOT NULL").select("rid", "k", "n", "root").unionByName(others.select("rid", "k", "n", F.coalesce("root", "rid").alias("root")))
    if repeated:
        least = member.groupBy("root").agg(F.min("k").alias("component_id"))
        member = rows.select(rid, "k", "th").join(member.drop("k").join(least, "root"), "rid").select("k", "th", "n", "component_id", "root")
    else:
        member = member.select("k", F.lit(0).cast("long").alias("th"), "n", F.col("root").alias("component_id"), "root")
    return member, repeated


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """key, th, n_shingles, component_id, kept for each row; ``th`` is 0 unless a key repeats."""
    member, _ = _members(df, key, text, shingle, percent)
    null = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return member.select(null("k").alias(key), "th", F.col("n").alias("n_shingles"), null("component_id").alias("component_id"), (F.col("k") == F.col("component_id")).alias("kept"))


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """Exactly one row of each group, with all its columns.

    That is the row with the smallest key (NULL first); of rows that share it, the one with the smallest
    text hash, and of rows that repeat both, the least by all columns as JSON.
    """
    member, repeated = _members(df, key, text, shingle, percent)
    k = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY))
    if not repeated:
        gone = member.filter("k <> component_id").select(F.col("k").alias("_k"))
        return df.join(gone, k == F.col("_k"), "left_anti")
    # repeated rows meet within a task before the shuffle
    th = text_hash(F.coalesce(F.col(text).cast("string"), F.lit("")))
    # as JSON any column has an order, a map too
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    one = df.groupBy(k.alias("_k"), th.alias("_th")).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    first = member.groupBy("root").agg(F.min(F.struct("k", "th")).alias("first")).select(F.col("first.k").alias("_k"), F.col("first.th").alias("_th"))
    return one.join(first, ["_k", "_th"], "left_semi").select("_row.*")
