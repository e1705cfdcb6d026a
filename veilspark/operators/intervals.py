"""Joins of intervals across rows, and the places of given passages in texts.

Intervals are half open and belong to a key.  They are cut into bins of ``width``, so a join is an equality
on (key, bin) with the overlap as a further condition; nothing is held against all of a key.  Intervals that
touch or are empty don't overlap; a NULL key or bound overlaps nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters to a bin.
WIDTH = 1024


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width).cast("long"), F.floor((end - 1) / width).cast("long"))


def _binned(df: DataFrame, keys: list[str], start: str, end: str, slack: int, width: int) -> DataFrame:
    """keys as _k0 ..., s, e (widened by the slack), bin, and the row itself."""
    rows = df.filter(F.col(start) < F.col(end)).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), (F.col(start) - slack).alias("s"), (F.col(end) + slack).alias("e"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    known = reduce(lambda a, b: a & b, [F.col(f"_k{i}").isNotNull() for i in range(len(keys))])
    return rows.filter(known).select("*", F.explode(_bins(F.col("s"), F.col("e"), width)).alias("bin"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", slack: int = 0, width: int = WIDTH) -> DataFrame:
    """Structs ``left`` and ``right`` of rows that overlap, or are less than ``slack`` apart; a pair comes from the first bin that both are in, so once."""
    k = [f"_k{i}" for i in range(len(keys))]
    a = _binned(left, keys, start, end, slack, width).withColumnsRenamed({"s": "ls", "e": "le", "row": "left"})
    b = _binned(right, keys, start, end, 0, width).withColumnsRenamed({"s": "rs", "e": "re", "row": "right"})
    first = F.floor(F.greatest("ls", "rs") / width) == F.col("bin")
    return a.join(b, [*k, "bin"]).filter((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")) & first).select("left", "right")


def _touched(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, slack: int, width: int) -> DataFrame:
    """Distinct keys and bounds of ``left`` that overlap a row of ``right``; no pair is made, and intervals of ``right`` that fill a bin are one there."""
    k = [f"_k{i}" for i in range(len(keys))]
    a = _binned(left.select(*keys, start, end).distinct(), keys, start, end, slack, width)
    b = _binned(right.select(*keys, start, end), keys, start, end, 0, width).select(*k, "bin", F.greatest("s", F.col("bin") * width).alias("rs"), F.least("e", (F.col("bin") + 1) * width).alias("re")).distinct()
    same = reduce(lambda x, y: x & y, [a[c] == b[c] for c in (*k, "bin")])
    return a.join(b, same & (a["s"] < b["re"]) & (b["rs"] < a["e"]), "left_semi").select("row.*").distinct()


def interval_semi_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", slack: int = 0, width: int = WIDTH) -> DataFrame:
    """The rows of ``left`` that overlap a row of ``right``."""
    return left.join(_touched(left, right, keys, start, end, slack, width), [*keys, start, end], "left_semi")


def interval_anti_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", slack: int = 0, width: int = WIDTH) -> DataFrame:
    """The rows of ``left`` that overlap no row of ``right``; those with a NULL key or bound too."""
    return left.join(_touched(left, right, keys, start, end, slack, width), [*keys, start, end], "left_anti")


#: Inner words of a passage by which it is looked up; shorter ones are looked up by one.
ANCHOR = 4
#: Lengths of the last characters by which passages without an inner word are looked up: the longest that fits.
GRAMS = (32, 16, 8, 4, 2, 1)
#: Gaps to a run, as a power of two.
RUN = 7


def occurrences(df: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str, prepare: Callable[[Column], Column] = lambda text: text, least: int = 3) -> DataFrame:
    """key, item, start, end of every place where a passage stands in a text, left to right without overlap; ``prepare`` is applied to the texts first.

    Passages with fewer words than ``least`` are not sought; with 1 all are, blank ones too, but NULLs and empty ones, which stand nowhere.
    The words behind a passage's first word are whole words of any text that holds it, so ANCHOR of them (or one, for short passages) are
    looked up among the texts' own windows by an equality join, and only what shares one is searched. One or two words may be parts of a text's
    words, so they are looked up by their last characters among the texts' own stretches of that length; these are only made if there are such passages.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    sought = passages.select(F.col(item).alias("_i"), F.col(passage).alias("_p")).filter("_p <> ''").withColumn("_w", words(F.col("_p"))).filter(F.size("_w") >= least)
    sought = sought.withColumn("_w1", F.transform("_w", lambda x: F.xxhash64(F.array(x))))
    # the length of the gram, or 0 for a window of words and -1 for one word
    gram = F.coalesce(*(F.when(F.length("_p") >= g, g) for g in GRAMS))
    sought = sought.withColumn("_kind", F.when(F.size("_w") < 3, gram).when(F.size("_w") < ANCHOR + 2, -1).otherwise(0))
    anchor = F.when(F.col("_kind") > 0, F.xxhash64(F.expr("right(_p, _kind)"))).when(F.col("_kind") < 0, F.get("_w1", F.lit(1))).otherwise(F.xxhash64(*(F.get("_w1", F.lit(1 + k)) for k in range(ANCHOR))))
    sought = sought.select("_i", "_p", "_kind", anchor.alias("_h"))
    # which kinds of windows are wanted: eight rows at most
    kinds = {r._kind for r in sought.select("_kind").distinct().collect()}

    rows = df.select(F.col(key).alias("_d"), F.col(text).alias("_t"))
    windows = rows.select("_d", prepare(F.col("_t")).alias("_t"))
    windows = windows.select("_d", F.transform(words(F.col("_t")), lambda x: F.xxhash64(F.array(x))).alias("_w"), *(["_t"] if max(kinds, default=0) > 0 else []))
    many = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - ANCHOR + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("_w", i + k) for k in range(1, ANCHOR))))
    stretches = lambda g: F.transform(F.regexp_extract_all("_t", F.lit(f"(?s)(?=(.{{{g}}}))"), F.lit(1)), lambda x: F.xxhash64(x))
    wanted = [c for c, k in ((F.col("_w"), -1), (many, 0)) if k in kinds] + [stretches(g) for g in GRAMS if g in kinds] or [F.array().cast("array<long>")]
    # outer: for the inner form the optimiser would compute the windows twice
    windows = windows.select("_d", F.explode_outer(F.array_distinct(F.concat(*wanted))).alias("_h"))
    near = windows.join(sought.select("_i", "_h"), "_h").groupBy("_d").agg(F.collect_set("_i").alias("_is"))

    # a text is prepared once, however many passages may stand in it
    found = near.join(rows, "_d").select("_d", "_is", prepare(F.col("_t")).alias("_t")).select("_d", F.explode_outer("_is").alias("_i"), "_t").join(sought.select("_i", "_p"), "_i").filter(F.col("_t").contains(F.col("_p")))
    gaps = F.call_function("split", F.col("_t"), F.concat(F.lit("\\Q"), F.replace(F.col("_p"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    found = found.withColumn("_g", F.transform(gaps, lambda x: F.length(x)))
    # what stands before a gap is summed over whole runs of gaps first
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    found = found.withColumn("_s", F.transform(F.sequence(F.lit(0), F.shiftright(F.size("_g") - 1, RUN)), lambda j: total(F.slice("_g", F.shiftleft(j, RUN) + 1, 1 << RUN))))
    found = found.withColumn("_s", F.transform("_s", lambda _, j: total(F.slice("_s", 1, j))))
    size = F.length("_p")
    behind = lambda i: F.get("_s", F.shiftright(i, RUN)) + total(F.slice("_g", F.shiftleft(F.shiftright(i, RUN), RUN) + 1, i.bitwiseAND((1 << RUN) - 1) + 1))
    starts = F.transform(F.slice("_g", 1, F.size("_g") - 1), lambda _, i: behind(i) + i * size)
    return found.select(F.col("_d").alias(key), F.col("_i").alias(item), F.explode_outer(starts).alias("start"), size.alias("_n")).select(key, item, "start", (F.col("start") + F.col("_n")).alias("end"))
