"""The pipeline, stage by stage, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from test_copies import brute_groups, brute_passages, corpus  # noqa: E402
from test_scans import brute_quality  # noqa: E402
from test_tokens import check_packing  # noqa: E402

from veilspark.llm import quality, toxicity  # noqa: E402
from veilspark.llm.common import remove_scratch, written  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, frame, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    insult = " You idiot. You stupid moron. You pathetic loser."
    docs = [(i, t * (1 if i % 7 else 2) + (insult if i % 9 == 0 else "")) for i, t in corpus(21, 160)]
    docs += [(500, None), (501, ""), (502, docs[20][1]), (503, "many " * 100)]
    frame(docs).drop("k", "t", "th").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_rules", "toxicity", "near_dedup", "substring_dedup", "packing"]

    before = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    kept = {r[0] for r in brute_quality(before, quality.LINE_DOCS, quality.LINE_SHARE, quality.LEFT_SHARE) if r[-1]}
    docs = written(stages["quality_rules"](spark, docs, folder), "test")
    assert docs.columns == columns and {k for k, _ in pairs(docs)} == kept and 500 not in kept

    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [(k, t) for k, t in pairs(docs) if model.score(t) < toxicity.THRESHOLD]
    assert 0 < len(want) < docs.count()
    docs = written(stages["toxicity"](spark, docs, folder), "test")
    assert docs.columns == columns and pairs(docs) == want

    want = [k for k, _, low, first in brute_groups(pairs(docs), 5) if first]
    docs = written(stages["near_dedup"](spark, docs, folder), "test")
    assert docs.columns == columns and sorted(k for k, _ in pairs(docs)) == sorted(want)

    want = {r[0]: r for r in brute_passages(pairs(docs))}
    docs = written(stages["substring_dedup"](spark, docs, folder), "test")
    assert docs.columns == columns
    for k, t in pairs(docs):
        assert len(re.findall(r"[^\x20\x09-\x0D]+", t)) == want[k][1] - want[k][2]

    rows = stages["packing"](spark, docs, folder).collect()
    check_packing(rows, pairs(docs), 1024)


def test_one_row_of_each_group(spark, frame, tmp_path):
    """Repeated rows, and copies under one key or none."""
    rng = random.Random(31)
    text = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    twice, keyless, keyed, lone = text(80), text(80), text(80), text(80)
    docs = [(1, twice), (1, twice), (1, twice), (2, twice + " end")]
    docs += [(None, keyless), (None, keyless), (None, keyless + " end"), (None, lone)]
    docs += [(3, keyed), (3, keyed + " end"), (3, text(80)), (4, "alone " + text(60)), (5, "")]
    df = frame(docs).drop("k", "t", "th")
    out = written(dict(pipeline.STAGES)["near_dedup"](spark, df, ""), "test")
    assert out.schema == df.schema
    got = pairs(out)
    assert sorted((k for k, _ in got), key=repr) == sorted([1, None, None, 3, 3, 4, 5], key=repr)
    assert sum(t.startswith(keyless) for _, t in got) == 1 and (None, lone) in got and sum(t.startswith(keyed) for _, t in got) == 1
    assert (1, twice) in got
    cut = dict(pairs(dict(pipeline.STAGES)["substring_dedup"](spark, out, "")))
    assert cut[1] == twice and cut[5] == "" and all(t for k, t in cut.items() if k != 5)


def test_stages_of_odd_rows(spark, frame, odd, tmp_path):
    """NULLs, repeated rows and keys, columns with clashing names, and no rows at all, in each stage."""
    at = str(tmp_path)
    spark.createDataFrame([(6, 1, 0), (6, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rng = random.Random(12)
    long = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(80))
    docs = frame([*odd, (20, long), (20, long), (None, long + " end")])
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, at), "test")
        none = written(stage(spark, docs.filter("false"), at), "test")
        assert none.count() == 0
        if name != "packing":
            assert out.columns == columns == none.columns and out.schema == docs.schema
        else:
            assert out.filter("start = 0").count() == docs.count()
        if name in ("quality_rules", "near_dedup"):
            want = {"quality_rules": 3, "near_dedup": 1}[name]
            assert out.filter(F.col("text").startswith(long)).count() == want
        if name == "substring_dedup":
            assert out.filter("doc_id = 20 AND text = ''").count() == 2 and out.filter("text IS NULL").count() == 0


def test_run_and_scratch(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.count() == out.select("doc_id", "start").distinct().count() > 0
    assert out.agg(F.sum("length")).first()[0] == out.dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0]
    assert remove_scratch(spark) > 0 and remove_scratch(spark) == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
