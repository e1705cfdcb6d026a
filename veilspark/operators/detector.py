"""The detector: one Arrow pass for the whole rule set, as a column expression.

``filter`` gives struct<text, matches, replacements, truncated>, ``scan`` an array of matches. NULL
gives NULL text, NULL matches and 0. An error in a rule fails the task: raw text is never
passed on silently.  A plain ``Detector()`` has the compatible limits, and ``truncated`` says
where one has cut the text; ``Detector.whole()`` searches all of it.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import spans
from veilspark.operators.kernel import LazyKernel
from veilspark.plans.config import Config, CustomRule, DetectionConfig, active_rules

MATCH = pa.struct([("rule_name", pa.string()), ("placeholder", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("entropy", pa.float64()), ("confidence", pa.string())])
RESULT = pa.struct([("text", pa.string()), ("matches", pa.list_(MATCH)), ("replacements", pa.int32()), ("truncated", pa.bool_())])
RESULT_DDL = f"struct<text:string,matches:{spans.MATCH_TYPE},replacements:int,truncated:boolean>"


class Detector:
    """An immutable set of rules; its methods return columns."""

    def __init__(self, config: Config | None = None) -> None:
        self._config = config or Config()
        e = self._config.entropy
        if e.enabled and e.inert and e != Config().entropy:
            warnings.warn(f"no window of {e.min_length} characters has {e.threshold} bits per character", stacklevel=2)

    @classmethod
    def whole(cls, config: Config | None = None) -> Detector:
        """A detector without limits: nothing is cut, and every rule searches texts of any length."""
        return cls((config or Config()).whole())

    @property
    def config(self) -> Config:
        return self._config

    def add_rule(self, name: str, pattern: str, placeholder: str = "[REDACTED]", priority: int = 50) -> Detector:
        """A detector with one more custom rule; ValueError if the pattern isn't safe."""
        return self.add_rule_direct(CustomRule(name, pattern, placeholder, priority))

    def add_rule_direct(self, rule: CustomRule) -> Detector:
        return Detector(self._config.with_custom(rule))

    def _kernel(self, rules: Iterable[str] | None, placeholder: str | None, auto: bool) -> LazyKernel:
        config, only = self._config, None if rules is None else frozenset(rules)
        entropy = config.entropy.enabled and (not auto or config.entropy.mode == "auto")
        return LazyKernel(config, only, placeholder, entropy)

    def filter(self, text: Column | str) -> Column:
        return self.filter_with(text)

    def filter_with(self, text: Column | str, rules: Iterable[str] | None = None, placeholder: str | None = None) -> Column:
        """``rules`` restricts built-in and custom rules by name; ``placeholder`` replaces those of built-in rules."""
        kernel = self._kernel(rules, placeholder, auto=True)

        @F.arrow_udf(RESULT_DDL)
        def redact(column: pa.Array) -> pa.Array:
            run = kernel().filter
            return pa.array([run(x) for x in column.to_pylist()], RESULT)

        return redact(_column(text))

    def scan(self, text: Column | str) -> Column:
        return self.scan_with(text)

    def scan_with(self, text: Column | str, rules: Iterable[str] | None = None) -> Column:
        kernel = self._kernel(rules, None, auto=False)

        @F.arrow_udf(spans.MATCH_TYPE)
        def find(column: pa.Array) -> pa.Array:
            run = kernel().scan
            return pa.array([run(x) for x in column.to_pylist()], pa.list_(MATCH))

        return find(_column(text))

    def redact_or_keep(self, text: Column | str) -> Column:
        """struct<text, matches, replacements, truncated> whose text is the input itself where nothing is replaced and nothing was cut."""
        text = _column(text)
        found = self.filter(text)
        return F.transform(F.array(found), lambda r: F.struct(F.when((r["replacements"] > 0) | r["truncated"], r["text"]).otherwise(text).alias("text"), r["matches"].alias("matches"), r["replacements"].alias("replacements"), r["truncated"].alias("truncated")))[0]


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def filter_text(text: Column | str, config: DetectionConfig | None = None) -> Column:
    return Detector(Config.from_detection_config(config)).filter(text)


def scan_text(text: Column | str, config: DetectionConfig | None = None) -> Column:
    return Detector(Config.from_detection_config(config)).scan(text)


def native_redact(text: Column, rule: str, config: Config | None = None) -> Column:
    """struct<text, replacements> for one rule on normalised text, by Spark's own functions; the configuration's lists, placeholders, toggles and IPv6 limit hold."""
    config = config or Config().whole()
    return spans.apply_replacements(text, spans.resolve_overlaps(native_scan(text, rule, config)))


def native_scan(text: Column, rule: str, config: Config | None = None) -> Column:
    """array of matches of one rule on normalised text, by Spark's own functions."""
    config = config or Config().whole()
    active = {r.name: r for r in active_rules(config)}
    if rule not in active:
        return F.when(text.isNotNull(), F.array().cast(spans.MATCH_TYPE))
    white = config.whitelist
    return spans.rule_spans(text, active[rule], lists=(white.ips, white.domains, white.strings), ipv6_max_bytes=config.limits.ipv6_max_bytes)


def explode_matches(df: DataFrame, text: str = "text", *keys: str, detector: Detector | None = None) -> DataFrame:
    """A row for each match: the key columns and the fields of the match."""
    found = df.select(*keys, (detector or Detector.whole()).scan(text).alias("found"))
    # not inline: for that the optimiser infers a filter on the array and runs the kernel twice
    return found.select(*keys, F.inline_outer("found")).filter("rule_name IS NOT NULL")


def register_sql(spark: SparkSession, detector: Detector | None = None) -> None:
    """SQL functions redact_text, redact_count, scan_count on whole texts; only a given detector has limits.

    redact_truncated says whether a limit has cut a text, of which redact_text then has the head alone.  (Native functions need no registration: use the column forms.)
    """
    detector = detector or Detector.whole()
    full, count = detector._kernel(None, None, True), detector._kernel(None, None, False)

    @F.arrow_udf("string")
    def redact_text(column: pa.Array) -> pa.Array:
        run = full().filter
        return pa.array([run(x)["text"] for x in column.to_pylist()], pa.string())

    @F.arrow_udf("int")
    def redact_count(column: pa.Array) -> pa.Array:
        run = full().filter
        return pa.array([run(x)["replacements"] for x in column.to_pylist()], pa.int32())

    @F.arrow_udf("int")
    def scan_count(column: pa.Array) -> pa.Array:
        run = count().scan
        return pa.array([len(run(x) or ()) for x in column.to_pylist()], pa.int32())

    @F.arrow_udf("boolean")
    def redact_truncated(column: pa.Array) -> pa.Array:
        run = full().prepared
        return pa.array([bool(x) and run(x)[1] for x in column.to_pylist()], pa.bool_())

    for name, function in (("redact_text", redact_text), ("redact_count", redact_count), ("scan_count", scan_count), ("redact_truncated", redact_truncated)):
        spark.udf.register(name, function)
