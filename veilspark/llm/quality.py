"""Quality rules: counts within a text, and lines that many documents of a host share.

DataFrame functions only.  Every line is hashed in a normalised form and counted over the
distinct documents of its host; a document that consists mostly of lines above the limit is
depleted and goes, and ``kept_documents`` removes such lines from the others.

A distinct document is a distinct set of normalised lines: exact copies, and rows that repeat,
count once, so that they don't make each other look like boilerplate; a document that differs
in any line counts for itself, however many lines it shares.

Defined results: a NULL or blank text has no words and no lines, fails the base rules and is
not kept; a NULL host is the empty one; repeated rows are judged each and alike; a line at the limit
is not above it; texts are read whole, however long; a NULL key is a key of its own; an empty
table gives no rows; columns other than the three named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import NOT_SPACE, SPACE, text_hash, written

# Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"

#: A line is above the limit in its host if more distinct documents hold it than this number and than this part of the host's distinct documents.
LINE_DOCS = 20
LINE_SHARE = 0.02
#: A document is depleted if less than this part of its distinct lines' characters is left.
LEFT_SHARE = 0.3
SALTS = 32


def repeated_words(words: str) -> list[tuple[str, Column]]:
    """Named steps to ``n_repeat_words``: words inside 3-word windows that the text has twice or more.

    Windows are hashed, the position is put into the low bits, and one sort brings equal windows
    together.  Each step is a column that the next one reads more than once, so that the
    optimiser keeps it apart instead of evaluating it inside a lambda again and again.
    """
    bits = f"length(bin(size({words})))"
    return [
        ("_h", F.expr(f"transform({words}, x -> xxhash64(x))")),
        ("_s", F.expr(f"sort_array(transform(slice(_h, 1, greatest(size(_h) - 2, 0)), (h, i) -> shiftleft(shiftright(xxhash64(h, _h[i + 1], _h[i + 2]), {bits}), {bits}) | i))")),
        ("_e", F.expr(f"zip_with(_s, slice(_s, 2, size(_s)), (a, b) -> coalesce(shiftright(a ^ b, {bits}) = 0, false))")),
        ("_p", F.expr(f"CASE WHEN array_contains(_e, true) THEN sort_array(filter(transform(_s, (x, i) -> IF(_e[i] OR (i > 0 AND _e[greatest(i - 1, 0)]), x & (shiftleft(1L, {bits}) - 1L), -1L)), x -> x >= 0)) ELSE array() END")),
        ("n_repeat_words", F.expr(f"aggregate(zip_with(_p, slice(_p, 2, size(_p)), (a, b) -> least(3L, coalesce(b - a, 3L))), 0L, (x, y) -> x + y)")),
    ]


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))


def normal_line(line: Column) -> Column:
    """Lower case, white space runs as one space, digits as 0."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, f"{SPACE}+", " "))), "[0-9]+", "0")


def text_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``df``: key, text hash and the base counts."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = df.select(F.col(key).alias("k"), text_hash(t).alias("th"), t.alias("t"))
    base = base.withColumns({"_w": F.regexp_extract_all("t", F.lit(f"{NOT_SPACE}+"), F.lit(0)), "_l": _lines(F.col("t"))})
    base = base.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count("t", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        }
    )
    for name, step in repeated_words("_w"):
        base = base.withColumn(name, step)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return base.select("k", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def document_lines(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """A row for each distinct normalised line of each row: key, text hash, host, line hash (within the host), characters; ``ident`` is the hash of all the row's lines, ``total`` their characters."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h = F.coalesce(F.col(host).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("k"), text_hash(t).alias("th"), h.alias("host"), F.array_distinct(F.transform(_lines(t), normal_line)).alias("l"))
    rows = rows.withColumn("s", F.transform("l", lambda x: F.struct(F.xxhash64("host", x).alias("lh"), F.length(x).alias("n"))))
    rows = rows.withColumns({"ident": F.xxhash64(F.sort_array(F.col("s.lh"))), "total": F.aggregate("s.n", F.lit(0).cast("long"), lambda a, x: a + x)})
    # not inline: for that the optimiser infers a filter on the array and computes it twice
    return rows.select("k", "th", "host", "ident", "total", F.inline_outer("s")).filter("lh IS NOT NULL")


def removed_lines(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """k, th, line_chars, removed_chars and the hashes of the lines, for documents that hold a line above the limit (one row for repeated rows)."""
    # read twice, so split, normalised and hashed once
    lines = written(document_lines(df, key, text, host), "lines")
    # distinct documents on both sides: copies of one text make no line of the others rarer
    sizes = lines.select("host", "ident").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    # equal lines of one document meet before the shuffle, and again before they are counted
    counted = lines.select("host", "lh", "ident").distinct().groupBy("host", "lh").agg(F.count("*").alias("n_docs"))
    above = counted.filter(F.col("n_docs") > line_docs).join(sizes, "host").filter(F.col("n_docs") > line_share * F.col("host_docs")).select("lh")
    # a line that a third of the documents share is dealt over SALTS tasks; the few lines above the limit are repeated for each
    above = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.select("k", "th", "lh", "n", "total", F.pmod(F.xxhash64("k", "th"), F.lit(SALTS)).cast("int").alias("salt"))
    hit = salted.join(above, ["lh", "salt"]).select("k", "th", "lh", "n", "total").distinct()
    return hit.groupBy("k", "th").agg(F.max("total").cast("long").alias("line_chars"), F.sum("n").cast("long").alias("removed_chars"), F.collect_list("lh").alias("above"))


def _judged(df: DataFrame, key: str, text: str, host: str, line_docs: int, line_share: float, left_share: float) -> DataFrame:
    """A row for each row of ``df``: k, th, the base counts, base_failed, removed_chars, kept, above (NULL without lines above the limit)."""
    removed = removed_lines(df, key, text, host, line_docs, line_share).withColumnsRenamed({"k": "rk", "th": "rth"})
    counts = text_counts(df, key, text)
    joined = counts.join(removed, F.col("k").eqNullSafe(F.col("rk")) & (F.col("th") == F.col("rth")), "left")
    depleted = F.coalesce(F.col("line_chars") - F.col("removed_chars") < left_share * F.col("line_chars"), F.lit(False))
    return joined.select(
        "k", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.coalesce("removed_chars", F.lit(0)).cast("long").alias("removed_chars"), (~F.col("base_failed") & ~depleted).alias("kept"), "above",
    )


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """A row for each row of ``df``: the key, the base counts, base_failed, removed_chars, kept; ``th`` is the hash of the text."""
    return _judged(df, key, text, host, line_docs, line_share, left_share).drop("above").withColumnRenamed("k", key)


def kept_documents(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", chars: str | None = "n_chars", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """The rows that are kept, with all their columns, lines above the limit removed from the text; ``chars`` names a column with its length."""
    judged = _judged(df, key, text, host, line_docs, line_share, left_share).filter(~F.col("kept") | F.col("above").isNotNull())
    judged = judged.select(F.col("k").alias("_k"), F.col("th").alias("_th"), F.col("kept").alias("_kept"), F.col("above").alias("_above")).dropDuplicates(["_k", "_th"])
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h = F.coalesce(F.col(host).cast("string"), F.lit(""))
    rows = df.join(judged, df[key].eqNullSafe(F.col("_k")) & (text_hash(t) == F.col("_th")), "left").filter(F.coalesce("_kept", F.lit(True)))
    left = F.array_join(F.filter(F.split(t, "\n"), lambda x: ~F.array_contains("_above", F.xxhash64(h, normal_line(x)))), "\n")
    rows = rows.withColumn("_left", F.when(F.col("_above").isNotNull(), left))
    new = {text: F.coalesce("_left", text)}
    if chars in df.columns:
        new[chars] = F.coalesce(F.length("_left").cast(df.schema[chars].dataType), F.col(chars))
    return rows.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns))
