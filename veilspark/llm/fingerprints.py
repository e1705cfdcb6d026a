"""Document fingerprints: Order MinHash over words, with Spark's own functions only.

A text is cut into words, and every run of K words is a k-mer that carries its occurrence
number, so that repeats count.  An entry of the signature takes the two least k-mers of the text
under the entry's order, keeps them in text order and hashes the tuple.  Two texts agree in an entry
if they share both k-mers in the same order, so moves and rewrites cost likeness as they cost
edit distance, not only as they change the set of k-mers.

The ENTRIES orders are rotations of one: k-mers lie on the circle of 64-bit hashes, and the
order of entry i begins at the i-th of ENTRIES points that divide it evenly.  So one sorted array
holds all orders, and the two least of an entry are found by binary search: nothing is exploded,
aggregated or shuffled.

A k-mer travels as one long: 38 bits of hash above 26 bits of position. Sorting brings equal
k-mers of a text together, in text order; their places in the run are the occurrence numbers.

``neighbours`` pairs each document with the next one by key without a global sort in one
task: keys are cut into buckets at quantiles, and each bucket gets a guest copy of the
row that follows its last one.  A key that fills several quantiles has as many buckets, dealt by
the hash of the text.

Defined results: NULL texts are empty; a text without a word has one k-mer, the empty one,
and a text of fewer than K words one of all its words, which is then both of a tuple; words are cut after 16 characters and
ideographs stand alone, so that unspaced text has k-mers too; equal texts have equal
fingerprints; a NULL key is the smallest; rows with the same key are ordered by a hash of the text, then the text, and each is fingerprinted; with one
row the next document is itself; an empty table gives no rows; positions beyond 2**26 words
count as the last one, so tuples among them aren't ordered; columns other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import partitions, written

K, ENTRIES = 3, 32
POSITION_BITS = 26
MASK = (1 << POSITION_BITS) - 1
WORD = r"[⺀-鿿가-힯]|[^\x20\x09-\x0D⺀-鿿가-힯]{1,16}"

#: Buckets for each shuffle partition, so that hashing them deals evenly.
BUCKETS = 6


def _bucket(order: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``order``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.lit(bounds)
    n = F.lit(len(bounds))
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.get(table, at + s - 1) <= order), at + s).otherwise(at),
    )


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """b, rn (the row's place), k, t, and of the next row nb, nrn, next_t; the first row follows the last."""
    spark = df.sparkSession
    n = BUCKETS * partitions(spark)
    least = -(1 << 63)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("o"), t.alias("t"), F.xxhash64(t).alias("x"))
    # at most n numbers
    cuts = rows.select(F.percentile_approx("o", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    heavy = {o: m + 1 for o, m in Counter(cuts).items() if m > 1}
    width = 1 + max(heavy.values(), default=0)
    # rows of a heavy key by the upper bits of the hash, other keys of its bucket behind them
    inner = F.lit(0)
    if heavy:
        share = F.element_at(F.create_map(*(F.lit(x) for pair in heavy.items() for x in pair)), F.col("o"))
        after = F.when(_bucket(F.col("o"), sorted(set(cuts))).isin(*(sorted(set(cuts)).index(o) + 1 for o in heavy)), width - 1).otherwise(0)
        inner = F.coalesce(F.floor((F.shiftright("x", 32) + F.lit(1 << 31)) * share / F.lit(1 << 32)).cast("int"), after)
    rows = rows.withColumn("b", _bucket(F.col("o"), sorted(set(cuts))) * width + inner)
    # a row for each bucket; the first row of a bucket goes as a guest to the bucket before it, that of the first bucket to the last one
    firsts = sorted((r.b, r.o, r.x) for r in rows.groupBy("b").agg(F.min(F.struct("o", "x")).alias("f")).select("b", "f.o", "f.x").collect())
    guests = [(o, x, b, firsts[i - 1][0]) for i, (b, o, x) in enumerate(firsts)]
    table = spark.createDataFrame(guests, "first_o long, first_x long, home int, to int")
    guest = rows.join(F.broadcast(table), (F.col("o") == F.col("first_o")) & (F.col("x") == F.col("first_x"))).groupBy("to", "home").agg(F.min(F.struct("o", "x", "t", "k")).alias("f"))
    guest = guest.select(F.col("to").alias("b"), F.lit(1).alias("guest"), "f.k", "f.o", "f.x", "f.t", "home")
    every = rows.select("b", F.lit(0).alias("guest"), "k", "o", "x", "t", F.col("b").alias("home")).unionByName(guest)
    w = Window.partitionBy("b").orderBy("guest", "o", "x", "t")
    placed = every.withColumns({"rn": F.row_number().over(w), "next_t": F.lead("t").over(w), "next_guest": F.lead("guest").over(w), "next_home": F.lead("home").over(w)})
    return placed.filter("guest = 0").select("b", "rn", "k", "t", F.col("next_home").alias("nb"), F.when(F.col("next_guest") == 1, 1).otherwise(F.col("rn") + 1).alias("nrn"), "next_t")


def numbered_kmers(text: str) -> list[tuple[str, Column]]:
    """Named steps from a text column to ``o``: its k-mers, numbered, as longs in any order. Each step is used twice or more, which keeps it from being evaluated within lambdas."""
    b = POSITION_BITS
    return [
        ("_h", F.expr(f"transform(regexp_extract_all({text}, r'{WORD}', 0), x -> xxhash64(x))")),
        ("_s", F.expr(f"sort_array(IF(size(_h) = 0, array(shiftleft(shiftright(xxhash64(''), {b}), {b})), transform(slice(_h, 1, greatest(size(_h) - {K - 1}, 1)), (h, i) -> shiftleft(shiftright(xxhash64(h, get(_h, i + 1), get(_h, i + 2)), {b}), {b}) | least(i, {MASK}))))")),
        ("_e", F.expr(f"zip_with(_s, slice(_s, 2, size(_s)), (x, y) -> coalesce(shiftright(x ^ y, {b}) = 0, false))")),
        ("_d", F.expr("IF(array_contains(_e, true), filter(_s, (x, i) -> _e[i] OR (i > 0 AND _e[greatest(i - 1, 0)])), array())")),
        # where each run of equal k-mers begins: a running maximum by doubling
        ("_v", F.expr(f"transform(_d, (x, i) -> IF(i > 0 AND shiftright(x ^ _d[greatest(i - 1, 0)], {b}) = 0, -1, i))")),
        ("_r", F.expr("IF(size(_d) = 0, _v, aggregate(transform(sequence(0, length(bin(size(_d)))), j -> shiftleft(1, j)), _v, (v, n) -> transform(v, (x, i) -> IF(i >= n, greatest(x, v[greatest(i - n, 0)]), x))))")),
        ("o", F.expr(f"IF(size(_d) = 0, _s, concat(filter(_s, (x, i) -> NOT (_e[i] OR (i > 0 AND _e[greatest(i - 1, 0)]))), transform(_d, (x, i) -> IF(i = _r[i], x, shiftleft(shiftright(xxhash64(shiftright(x, {b}), i - _r[i]), {b}), {b}) | (x & {MASK}L)))))")),
    ]


def with_signature(df: DataFrame, text: str, sig: str) -> DataFrame:
    """``df`` with ``sig``, an array of ENTRIES integers, for a text column."""
    columns = df.columns
    for name, step in numbered_kmers(text):
        df = df.withColumn(name, step)
    df = df.withColumn("_c", F.sort_array("o")).withColumn("_n", F.size("_c"))
    # how many k-mers lie before each point, by binary search with steps that are powers of two
    points = F.array(*[F.lit(-(1 << 63) + i * ((1 << 64) // ENTRIES)).cast("long") for i in range(ENTRIES)])
    steps = F.expr("reverse(transform(sequence(0, length(bin(_n)) - 1), j -> shiftleft(1, j)))")
    before = F.transform(points, lambda p: F.aggregate(F.col("_steps"), F.lit(0), lambda at, s: F.when((at + s <= F.col("_n")) & (F.get(F.col("_c"), at + s - 1) < p), at + s).otherwise(at)))
    df = df.withColumn("_steps", steps).withColumn("_at", before)

    def entry(at: Column, i: Column) -> Column:
        def of(pair: Column) -> Column:
            a, c = pair["a"], pair["c"]
            place = lambda x: x.bitwiseAND(F.lit(MASK))
            kmer = lambda x: F.shiftright(x, POSITION_BITS)
            ordered = F.when(place(a) <= place(c), F.xxhash64(i, kmer(a), kmer(c))).otherwise(F.xxhash64(i, kmer(c), kmer(a)))
            return F.shiftright(ordered, 32).cast("int")

        pair = F.struct(F.get(F.col("_c"), at % F.col("_n")).alias("a"), F.get(F.col("_c"), (at + 1) % F.col("_n")).alias("c"))
        return F.transform(F.array(pair), of)[0]

    return df.withColumn(sig, F.transform("_at", entry)).select(*columns, sig)


def fingerprint_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8)))), "")


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(ENTRIES))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars and fingerprint of each row: a projection."""
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return with_signature(rows, "t", "sig").select(F.col("k").alias(key), F.length("t").cast("long").alias("n_chars"), fingerprint_text(F.col("sig")).alias("fingerprint"))


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last quarter the next document's beginning replaces, and how alike they are."""
    n, quarter = F.length("t"), F.floor(F.length("t") / 4).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - quarter), F.substring("next_t", F.lit(1), quarter))
    rows = neighbours(df, key, text).withColumn("edited", edited)
    signed = with_signature(with_signature(rows, "t", "s"), "edited", "e")
    # read twice by the join below, so computed once
    both = written(signed.select("b", "rn", "nb", "nrn", "k", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), "s", "e"), "signatures")
    others = both.select(F.col("b").alias("ob"), F.col("rn").alias("orn"), F.col("s").alias("next_s"))
    out = both.join(others, (F.col("nb") == F.col("ob")) & (F.col("nrn") == F.col("orn")), "left")
    return out.select(
        F.col("k").alias(key), "n_chars", F.col("sha").alias("edited_sha256"), fingerprint_text(F.col("s")).alias("fingerprint"),
        fingerprint_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )
