"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every URL expands into the suffixes of its host and the prefixes of its path that end in a
slash.  The rules are grouped by the first four bytes of the SHA-256 of their expression; an
expression meets the group with its own four bytes by an equality join on these alone, and each rule
of the group is confirmed, or not, by the whole digest.  Of the rules that fit, the one with the longest host wins, then the one
with the longest path, then the smaller text.

Suffixes with more labels, and prefixes with more slashes, than any rule has are left out:
no rule can equal them.  The expansion of a URL is bounded by the rule table, not by the URL.
The URLs are judged once each: repeated ones meet before the shuffle, and only those that a rule fits are
joined back; URLs without a host are not looked up at all.

Defined results: a NULL URL, or one without ``://``, has an empty host and path; no rule
fits an empty host, and the verdict is then ``block`` (there is nothing to fetch); a URL
that no rule fits is allowed; of rules that tie in both lengths the greatest text wins, and of equal rules
with different verdicts ``block``; a very long URL is expanded as far as the rules reach.  Repeated rows and
keys each get their row, a NULL key too; an empty table gives none; columns other than the two
named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: verdict, host, path; the path starts and ends with a slash.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Up to so many rules are sent to every executor (a row has under 300 bytes); more are joined by a shuffle.
BROADCAST_RULES = 20_000
#: Rows of one URL are dealt over so many tasks where results are joined back.
SALTS = 8
RULES_DDL = "verdict string, rule_host string, rule_path string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to a slash, question mark or number sign: the host, A-Z in lower case; then the path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_table(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or not path.startswith("/") or not path.endswith("/"):
            raise ValueError(f"not a rule: {(verdict, host, path)}")
    return spark.createDataFrame(list(rules), RULES_DDL)


def url_filter(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """A row for each row of ``pages``: key, host, path, rule, verdict."""
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), host.alias("h"), path.alias("p"))
    n_rules, labels, slashes = rules.select(
        F.count("*"), F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("rule_path", "/")))
    ).first()
    labels, slashes = labels or 1, slashes or 1

    expression = F.concat("rule_host", F.lit(" "), "rule_path")
    table = rules.select("verdict", "rule_host", "rule_path", F.sha2(expression, 256).alias("digest"))
    # a row for each short prefix, with all rules that begin so
    table = table.groupBy(F.substring("digest", 1, 8).alias("short")).agg(F.collect_list(F.struct("digest", "rule_host", "rule_path", "verdict")).alias("rules"))
    table = F.broadcast(table) if n_rules <= BROADCAST_RULES else table

    hosts = judged.select("h", "p").distinct()
    parts = F.split("h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    pieces = F.split("p", "/", -1)
    last = F.least(F.size(pieces) - 1, F.lit(slashes - 1))
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), last), lambda n: n > 0), lambda n: F.concat(F.array_join(F.slice(pieces, 1, n), "/"), F.lit("/")))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda q: F.concat(s, F.lit(" "), q))))
    wide = hosts.filter("h <> '' AND p LIKE '/%'").select("h", "p", F.explode(pairs).alias("e")).withColumn("full", F.sha2("e", 256))
    met = wide.join(table, F.substring("full", 1, 8) == F.col("short"))
    confirmed = F.filter("rules", lambda r: r["digest"] == F.col("full"))
    ranked = F.transform(confirmed, lambda r: F.struct(F.length(r["rule_host"]).alias("a"), F.length(r["rule_path"]).alias("b"), F.concat(r["rule_host"], r["rule_path"]).alias("rule"), r["verdict"].alias("verdict")))
    best = met.select("h", "p", F.array_max(ranked).alias("b")).filter("b IS NOT NULL").groupBy("h", "p").agg(F.max("b").alias("b"))
    # a URL that a third of all pages have is dealt over SALTS tasks
    best = best.select(F.col("h").alias("bh"), F.col("p").alias("bp"), "b.rule", "b.verdict", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("bs"))
    salted = judged.withColumn("s", F.pmod(F.xxhash64("k", "u"), F.lit(SALTS)).cast("int"))
    fits = (F.col("h") == F.col("bh")) & (F.col("p") == F.col("bp")) & (F.col("s") == F.col("bs"))
    out = salted.join(best, fits, "left")
    verdict = F.coalesce("verdict", F.when(F.col("h") == "", "block").otherwise("allow"))
    return out.select(F.col("k").alias(key), F.col("h").alias("host"), F.col("p").alias("path"), "rule", verdict.alias("verdict"))
