"""Native column expressions on spans: one rule's matches, Luhn, whitelist, overlaps, replacement.

Offsets are code points from 0, half open, on the text that was searched.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.rules import BY_NAME, DOMAIN_WHITELIST, FOLDED, GATES, HOSTNAME_WHITELIST, IP_RULES, IP_WHITELIST, NEEDLES, Rule

MATCH_FIELDS = "rule_name string, placeholder string, start int, end int, value string, entropy double, confidence string"
MATCH_TYPE = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in MATCH_FIELDS.split(', '))}>>"


def luhn_valid(value: Column) -> Column:
    """13 to 19 ASCII digits (others are ignored) whose check digit is right."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def is_whitelisted(rule_name: str, value: Column, ips=(), domains=(), strings=()) -> Column:
    low = F.lower(value)
    hit = low.isin(*strings) if strings else F.lit(False)
    if rule_name in IP_RULES:
        for pattern in IP_WHITELIST:
            hit = hit | low.rlike(pattern)
        return (hit | low.isin(*[x.lower() for x in ips])) if ips else hit
    if rule_name == "email":
        return hit | F.substring_index(low, "@", -1).isin(*DOMAIN_WHITELIST, *[x.lower() for x in domains])
    return hit | low.isin(*HOSTNAME_WHITELIST)


def _may_match(text: Column, rule: Rule) -> Column:
    """Cheap conditions that every text with a match of a built-in rule fulfils, before its pattern is tried."""
    hit = F.lit(True)
    if rule.name not in BY_NAME or rule.pattern != BY_NAME[rule.name].pattern:
        return hit
    if rule.name in NEEDLES:
        folded, words = NEEDLES[rule.name]
        hit = text.rlike("(?Ui)" + "|".join(words)) if folded else reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    return hit & text.rlike("(?Ud)" + GATES[rule.name]) if rule.name in GATES else hit


def rule_spans(text: Column, rule: Rule | str, whitelist: bool = True, lists: tuple = ((), (), ()), ipv6_max_bytes: int | None = None, checks: bool = True) -> Column:
    """array of matches of one rule, left to right; ``lists`` are further addresses, domains and strings that are never reported; ``checks`` tries the rule's cheap conditions first.

    Values come from one pass and the gaps between them from another; a fold over both gives the offsets.
    """
    rule = BY_NAME[rule] if isinstance(rule, str) else rule
    pattern = rule.java_pattern
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.lit(None).cast(MATCH_TYPE)

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        low = (~luhn_valid(pair["value"])) if rule.name == "credit_card" else F.lit(False)
        item = F.struct(
            F.lit(rule.name).alias("rule_name"),
            F.lit(rule.placeholder).alias("placeholder"),
            start.cast("int").alias("start"),
            end.cast("int").alias("end"),
            pair["value"].alias("value"),
            F.lit(0.0).alias("entropy"),
            F.when(low, "low").otherwise("high").alias("confidence"),
        )
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(item).cast(MATCH_TYPE)).alias("out"))

    pairs = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCH_TYPE).alias("out"))
    found = F.aggregate(pairs, start, add, lambda acc: acc["out"])
    if whitelist:
        found = F.filter(found, lambda m: ~is_whitelisted(rule.name, m["value"], *lists))
    hit = (_may_match(text, rule) & text.rlike(pattern)) if checks else text.rlike(pattern)
    if ipv6_max_bytes is not None and rule.name in ("ipv6", "ipv6_hyphen"):
        hit = hit & (F.octet_length(text) <= ipv6_max_bytes)
    return F.when(text.isNull(), empty).when(hit, found).otherwise(F.array().cast(MATCH_TYPE))


def lowered(text: Column) -> Column:
    """Lower case, with the letters that a pattern without regard to case takes for ASCII ones as these."""
    low = F.lower(text)
    for letter, plain in FOLDED.items():
        low = F.replace(low, F.lit(letter.lower()), F.lit(plain))
    return low


def every_rule_spans(text: Column, low: Column, rules: Iterable[Rule]) -> Column:
    """Matches of each rule, one rule after the other, not resolved; ``low`` is the text ``lowered``. Rules with the same gate share it."""
    empty, by_gate = F.array().cast(MATCH_TYPE), {}
    for rule in rules:
        by_gate.setdefault(GATES.get(rule.name) if rule == BY_NAME.get(rule.name) else None, []).append(rule)
    parts = []
    for gate, same in by_gate.items():
        found = []
        for rule in same:
            spans = rule_spans(text, rule, checks=False)
            if rule == BY_NAME.get(rule.name) and rule.name in NEEDLES:
                folded, words = NEEDLES[rule.name]
                spans = F.when(reduce(lambda a, b: a | b, [(low if folded else text).contains(w) for w in words]), spans).otherwise(empty)
            found.append(spans)
        every = F.concat(*found) if len(found) > 1 else found[0]
        parts.append(every if gate is None else F.when(text.rlike("(?Ud)" + gate), every).otherwise(empty))
    return F.concat(*parts)


def not_covered(candidates: Column, regex_matches: Column) -> Column:
    """Those candidates that overlap no regex match: an interval anti-join within the row."""
    return F.filter(candidates, lambda e: ~F.exists(regex_matches, lambda r: (e["start"] < r["end"]) & (e["end"] > r["start"])))


def _priority(name: Column) -> Column:
    known = [F.when(name == rule.name, F.lit(rule.priority)) for rule in BY_NAME.values() if rule.priority]
    return F.coalesce(*known, F.lit(0))


def resolve_overlaps(matches: Column) -> Column:
    """Disjoint matches in order. Sorted by start, priority and longer first (ties by input order), each match is held against the last one kept."""
    ranked = F.transform(matches, lambda m, i: F.struct(m["start"].alias("s"), _priority(m["rule_name"]).alias("p"), (-m["end"]).alias("e"), i.alias("i"), m.alias("m")))

    def fold(kept: Column, row: Column) -> Column:
        last = F.element_at(kept, -1)
        m, one = row["m"], F.array(row["m"]).cast(MATCH_TYPE)
        swapped = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), one)
        prio, prio_last = row["p"], _priority(last["rule_name"])
        longer = (m["end"] - m["start"]) > (last["end"] - last["start"])
        return (
            F.when((F.size(kept) == 0) | (m["start"] >= F.get(kept, F.size(kept) - 1)["end"]), F.concat(kept, one))
            .when((m["start"] <= last["start"]) & (m["end"] >= last["end"]), swapped)
            .when((last["start"] <= m["start"]) & (last["end"] >= m["end"]), kept)
            .when((prio < prio_last) | ((prio == prio_last) & longer), swapped)
            .otherwise(kept)
        )

    return F.aggregate(F.array_sort(ranked), F.array().cast(MATCH_TYPE), fold)


def apply_replacements(text: Column, matches: Column) -> Column:
    """struct<text, replacements>: high-confidence matches (disjoint, in order) become their placeholders."""
    high = F.filter(matches, lambda m: m["confidence"] == "high")

    def of(hits: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        body = F.aggregate(
            hits,
            start,
            lambda acc, m: F.struct(
                m["end"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), m["placeholder"]).alias("out"),
            ),
            lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
        )
        return F.struct(body.alias("text"), F.size(hits).alias("replacements"))

    return F.transform(F.array(F.coalesce(high, F.array().cast(MATCH_TYPE))), of)[0]
