"""Distinct sketches, table functions, JSON of any shape, ambiguous patterns, entropy by running sums, SQL on whole texts."""

import json
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark import Config, Detector
from veilspark.functions import spans
from veilspark.functions.entropy import high_entropy, plausible
from veilspark.functions.rules import BUILTIN_RULES
from veilspark.operators.detector import register_sql
from veilspark.operators.distinct import add_load, cube_estimates, distinct_cube, sketch_states, stored_states
from veilspark.operators.documents_json import redact_json, redact_variant, string_leaves
from veilspark.operators.table_functions import register_table_functions
from veilspark.plans.ambiguity import ambiguous
from veilspark.plans.config import Limits, validate_rule


def test_sql_searches_whole_texts(spark):
    long = "x " * 60_000 + "a.b@corp.test"
    spark.createDataFrame([(1, long), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("long_texts")
    register_sql(spark)
    rows = spark.sql("SELECT id, redact_text(text) AS t, redact_count(text) AS n, scan_count(text) AS m, redact_truncated(text) AS cut FROM long_texts ORDER BY id").collect()
    assert rows[0].t.endswith("[EMAIL]") and (rows[0].n, rows[0].m, rows[0].cut) == (1, 1, False) and rows[1].t is None and not rows[2].cut
    register_sql(spark, Detector(Config(limits=Limits(max_text_bytes=1_000))))
    row = spark.sql("SELECT redact_text(text) AS t, redact_count(text) AS n, redact_truncated(text) AS cut FROM long_texts WHERE id = 1").first()
    assert (len(row.t), row.n, row.cut) == (1_000, 0, True)
    register_sql(spark)


def test_table_functions(spark):
    register_table_functions(spark)
    rows = [(i, s, t) for i, (s, t) in enumerate([("a", "mail a.b@corp.test"), ("b", None), ("a", "8.8.8.8 and 9.9.9.9"), (None, ""), (None, "x@y.test")])]
    spark.createDataFrame(rows, "id int, source string, text string").createOrReplaceTempView("few_texts")
    got = spark.sql("SELECT d.id, m.rule_name, m.start, m.`end`, m.value, m.confidence FROM few_texts d, LATERAL explode_matches(d.text) m").collect()
    assert sorted(map(tuple, got)) == [(0, "email", 5, 18, "a.b@corp.test", "high"), (2, "ipv4", 0, 7, "8.8.8.8", "high"), (2, "ipv4", 12, 19, "9.9.9.9", "high"), (4, "email", 0, 8, "x@y.test", "high")]
    for how in ("", " PARTITION BY source"):
        got = spark.sql(f"SELECT key, value FROM scan_table(TABLE(SELECT source, text FROM few_texts){how})").collect()
        assert sorted(map(tuple, got), key=repr) == sorted([("a", "a.b@corp.test"), ("a", "8.8.8.8"), ("a", "9.9.9.9"), (None, "x@y.test")], key=repr)
    nothing = spark.sql("SELECT m.* FROM (SELECT * FROM few_texts WHERE id IN (1, 3)) d, LATERAL explode_matches(d.text) m")
    assert nothing.count() == 0


def test_sketches_merge_without_the_first_load(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), None if rng.random() < 0.05 else f"v{rng.randrange(30_000)}") for _ in range(60_000)]
    df = spark.createDataFrame(rows, "lang string, source string, value string").repartition(4)
    by, at = ["lang", "source"], f"{tmp_path}/states"
    first, second = df.randomSplit([0.5, 0.5], seed=1)
    first.write.parquet(f"{tmp_path}/first")
    second.write.parquet(f"{tmp_path}/second")
    for load in ("first", "second", "second"):  # a load that is written again replaces itself
        add_load(sketch_states(spark.read.parquet(f"{tmp_path}/{load}"), by, "value"), at, load)
    states = stored_states(spark, at, by)
    # only stored states are read
    assert all("/states/" in f for f in states.inputFiles())
    assert states.agg(F.sum("n_rows")).first()[0] == sum(v is not None for *_, v in rows)
    exact = {(r.lang, r.source, r.level): r.n_values for r in distinct_cube(df, by, "value").collect()}
    want = Counter()
    for lang, source, v in set(rows):
        want[lang, source, 0] += v is not None
    assert {k: n for k, n in exact.items() if k[2] == 0} == dict(want)
    assert exact[None, None, 3] == len({v for *_, v in rows if v is not None}) and exact["a", None, 1] == len({v for lang, _, v in rows if lang == "a" and v})
    guess = {(r.lang, r.source, r.level): r.n_values for r in cube_estimates(states, by).collect()}
    assert guess.keys() == exact.keys() and all(abs(guess[k] - n) <= max(1, 5 * 0.83 / 64 * n) for k, n in exact.items())


MAIL = "to a.b@corp.test"


def test_json_of_any_shape_stays_byte_for_byte(spark):
    q = json.dumps(MAIL)
    cases = [
        (f'{{"b": [ {q},1.50 ,true], "a\\u0041" :{q}}}', '{"b": [ "to [EMAIL]",1.50 ,true], "a\\u0041" :"to [EMAIL]"}', ["$.b[0]", "$.aA"]),
        (f'{{"parts":[{{"text":{q},"type":"step"}},{{"text":{q},"type":"text"}},{{"type":"tool","state":{{"output":{q}}}}}, {q}]}}', f'{{"parts":[{{"text":{q},"type":"step"}},{{"text":"to [EMAIL]","type":"text"}},{{"type":"tool","state":{{"output":"to [EMAIL]"}}}}, "to [EMAIL]"]}}', ["$.parts[1].text", "$.parts[2].state.output", "$.parts[3]"]),
        (f'{{"a.b@corp.test": {{"type":"step","x":{q}}}}}', '{"a.b@corp.test": {"type":"step","x":"to [EMAIL]"}}', ["$.a.b@corp.test.x"]),
        (q, '"to [EMAIL]"', ["$"]),
        ('"caf\\u00e9 \\n 8.8.8.8 \\ud83d\\ude00"', '"café \\n [IP] 😀"', ["$"]),
        (f"not json {MAIL}", "not json to [EMAIL]", ["$"]),
        ('{"e":"\\u00e9", "n":[1e3,{}, [], "" , " "]}', '{"e":"\\u00e9", "n":[1e3,{}, [], "" , " "]}', []),
        ("[" * 3_000 + q + "]" * 3_000, None, None),
        ("", "", []), ("{", "{", []), (None, None, None),
    ]
    rows = [(i, text) for i, (text, *_) in enumerate(cases)]
    got = {r.i: r.r for r in spark.createDataFrame(rows, "i int, json string").select("i", redact_json("json").alias("r")).collect()}
    for i, (text, want, paths) in enumerate(cases):
        if want is not None or text is None:
            assert (got[i].json, got[i].paths) == (want, paths), text
            assert got[i].n == len(paths or ())
    assert "[EMAIL]" in got[7].json and "corp.test" not in got[7].json
    every = spark.createDataFrame([(cases[1][0],)], "json string").select(redact_json("json", known=None).alias("r")).first().r
    assert every.n == 4


def test_leaves_against_the_parser():
    rng = random.Random(7)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.3:
            return {rng.choice(["a", "b\"]", "parts", "type", "é{"]): value(depth - 1) for _ in range(rng.randrange(4))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return rng.choice([1, None, True, 2.5, "", "x", 'q"{[,:', "é\n\\"])

    def strings(x):
        if isinstance(x, dict):
            return [s for v in x.values() for s in strings(v)]
        return [s for v in x for s in strings(v)] if isinstance(x, list) else [x] if isinstance(x, str) else []

    for _ in range(600):
        x = value(5)
        text = json.dumps(x, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert [json.loads(text[s:e]) for s, e, _ in string_leaves(text, known=None)] == strings(x)


def test_variant_column(spark):
    df = spark.createDataFrame([(f'{{"a":[{json.dumps(MAIL)},2]}}',), (None,)], "j string").select(F.parse_json("j").alias("v"))
    got = [r[0] for r in df.select(F.to_json(redact_variant("v"))).collect()]
    assert got == ['{"a":["to [EMAIL]",2]}', None]


@pytest.mark.parametrize("pattern", ["(a|a)*b", "(a|aa)+", "((a+)b?)*c", r"(\w+\s?)*z", "(a?){30}a{30}", "([a-z]+|[0-9])+!", "(?:[a-z]{2,3}){4,}q", "(?i:k|K)+", "(?:a|b|ab)+c", r"(?:(?:x|\d)+,?)+y"])
def test_ambiguous_patterns_are_refused(pattern):
    with pytest.raises(ValueError, match="without end"):
        validate_rule("r", pattern)
    with pytest.raises(ValueError):
        Detector().add_rule("r", pattern)


@pytest.mark.parametrize("pattern", [r.pattern for r in BUILTIN_RULES] + ["(a|b)*c", "(ab?)+c", r"(\w+\s)*z", r"PROJ-\d{6}", "(?:[^,]*,)*x", "(a++b)+", "(?>(a+)+)b", "(?:[a|b]c)+", r"(a\|b)+c", "(?:ab|ac)*d", "(?:(?:25[0-5]|[01]?\\d\\d?)\\.){3}x", "(?x) a+ # (b|b)+ \n c"])
def test_other_patterns_are_accepted(pattern):
    assert ambiguous(pattern) is None


def test_the_compatible_check_by_name():
    validate_rule("r", "(a|aa)+", compatible=True)
    with pytest.raises(ValueError, match="nested"):
        validate_rule("r", "(a+)+", compatible=True)


def test_refused_patterns_do_run_away():
    """What is refused grows with the text by a power of two; what is accepted doesn't."""
    def took(pattern, n):
        began = time.process_time()
        re.match(pattern, "a" * n + "!")
        return time.process_time() - began

    assert took("(?:a|aa)+b", 26) > 20 * took("(?:ab?)+c", 26)


def brute_stretches(text, threshold, size):
    bits = lambda x: -math.fsum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())
    found, at = [], 0
    while at + size <= len(text):
        if bits(text[at : at + size]) < threshold:
            at += max(1, size // 3)
            continue
        end = at + size
        while end < len(text) and bits(text[at : end + 1]) >= threshold:
            end += 1
        if plausible(text[at:end]):
            found.append((at, end, bits(text[at:end])))
        at = end
    return found


def test_entropy_by_running_sums_against_windows():
    rng, n = random.Random(3), 0
    for _ in range(1_500):
        letters = rng.choice([2, 5, 8, 9, 16, 40])
        text = "".join(chr(65 + rng.randrange(letters)) for _ in range(rng.randint(0, 160)))
        threshold, size = rng.choice([1.0, 2.0, 2.5, 3.0, 3.2]), rng.choice([8, 12, 16])
        want = brute_stretches(text, threshold, size) if math.log2(size) >= threshold else []
        assert high_entropy(text, threshold, size, None) == want
        n += len(want)
    assert n > 800


def test_entropy_of_long_texts_is_linear():
    rng = random.Random(1)
    text = "".join(chr(0x600 + rng.randrange(2_000)) for _ in range(300_000))
    began = time.process_time()
    assert high_entropy(text, 3.0, 12, None)[0][:2] == (0, 300_000)
    assert time.process_time() - began < 20


def test_entropy_by_blocks_equals_brute_force():
    rng, n = random.Random(12), 0
    fillers = ["\n", " ", "a" * 130, "abcdefgh" * 90, "ab\n" * 40]
    for _ in range(25):
        text = "".join(rng.choice([*fillers, "".join(chr(rng.choice([97, 0x4E00, 0x1F600]) + int(rng.random() ** 2 * 40)) for _ in range(rng.randrange(200)))]) for _ in range(rng.randrange(7)))
        for threshold, size in ((3.0, 12), (2.0, 8), (4.0, 30)):
            want = brute_stretches(text, threshold, size)
            assert high_entropy(text, threshold, size, None) == want
            n += len(want)
    assert n > 10


def test_entropy_of_prose_takes_under_a_microsecond_a_character():
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(500)]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ".\n"]) for _ in range(300_000))
    began = time.process_time()
    high_entropy(text, 3.0, 12, None)
    high_entropy("ab" * 1_000_000, 3.0, 12, None)
    assert time.process_time() - began < 1.2e-6 * (len(text) + 2_000_000) / 2


def test_every_rule_with_shared_gates_equals_each_rule(spark, odd_texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts)], "id int, text string")
    rules = BUILTIN_RULES
    low = spans.lowered(F.col("text"))
    together = df.select("id", F.inline_outer(spans.every_rule_spans(F.col("text"), low, rules))).filter("rule_name IS NOT NULL")
    alone = df.select("id", F.inline_outer(F.concat(*[spans.rule_spans(F.col("text"), r, checks=False) for r in rules]))).filter("rule_name IS NOT NULL")
    got, want = sorted(map(tuple, together.collect())), sorted(map(tuple, alone.collect()))
    assert got == want and len({r[1] for r in got}) == len(BUILTIN_RULES)


@pytest.fixture(scope="module")
def odd_texts():
    from test_redaction import POSITIVE

    texts = [t for t, _ in POSITIVE.values()]
    return [*texts, *(t.upper() for t in texts), *(t.replace("s", "ſ").replace("k", "K").replace("i", "İ") for t in texts), None, "", "paſſword=abcd1 apİ_key: zzzz1"]


def test_profiles_never_hide_a_match():
    """Whatever a rule matches passes its gate, its shape and its least number of digits, with digits of other scripts too."""
    from test_redaction import POSITIVE

    from veilspark.functions import rules as R
    from veilspark.operators.kernel import Kernel, Profile

    rng = random.Random(5)
    kernel = Kernel(Config().whole(), None, None, False)
    texts = [t for t, _ in POSITIVE.values()]
    texts += [t.translate({ord("0") + i: chr(0x660 + i) for i in range(10) if rng.random() < 0.5}) for t in texts * 6]
    texts += ["".join(rng.choice(texts) + rng.choice([" ", "é", "", "中", "-", "٣"]) for _ in range(3)) for _ in range(300)]
    seen = set()
    for text in texts:
        profile = Profile(text)
        for rule, pattern, _, gate in kernel.rules:
            if any(m.end() > m.start() for m in pattern.finditer(text)):
                seen.add(rule.name)
                assert profile.may_match(rule.name) and (gate is None or profile.may_pass(gate) and kernel.gates[gate](text)), (rule.name, text)
    assert seen == {r.name for r in BUILTIN_RULES} and set(R.SHAPES) <= set(R.GATES.values()) and set(R.LEAST_DIGITS) <= set(R.GATES)


def test_one_automaton_names_the_same_rules_as_each_needle():
    from veilspark.functions import rules as R
    from veilspark.operators.kernel import Needles

    rng = random.Random(6)
    needles = Needles(R.NEEDLES)
    words = sorted({x for _, xs in R.NEEDLES.values() for x in xs})
    for _ in range(2_000):
        text = "".join(w[: rng.randint(1, len(w))] if rng.random() < 0.4 else w for w in rng.choices([*words, " ", "é", "x", "B"], k=rng.randrange(9)))
        low = text.lower()
        each = {name for name, (_, xs) in R.NEEDLES.items() if any(x.lower() in low for x in xs)}
        assert needles.rules(low) == each
        # nothing that a needle as it is would let through is lost
        assert {name for name, (folded, xs) in R.NEEDLES.items() if any(x in (low if folded else text) for x in xs)} <= each
