"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import base_spans, classes_by_force, library_ids, targets_by_force

import corpus_pipeline
from quernstone.llm import quality
from quernstone.llm.common import written
from quernstone.llm.queries import quality_model


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents before each stage, and the last stage's rows."""
    found = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        found.append(written(stage(spark, found[-1], sf_dir), f"test-{name.replace(' ', '-')}"))
    return found


def test_stages_keep_the_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[1:-1])


def test_classifier_rejects_what_it_scores_low(spark, sf_dir, stages):
    scores = {r.doc_id: r.score for r in quality.score(stages[0], quality_model(spark, sf_dir)).collect()}
    assert {r.doc_id for r in stages[1].collect()} == {k for k, s in scores.items() if s >= 0.7}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    good, kept = labels.count(), labels.join(stages[1], "doc_id", "left_semi").count()
    assert kept >= 0.95 * good


def test_one_of_each_class_stays(stages):
    want = classes_by_force({r.doc_id: r.text for r in stages[1].collect()})
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(want.values()))


def test_secrets_are_masked_and_nothing_else_changes(stages):
    before, after = ({r.doc_id: r for r in stages[k].collect()} for k in (2, 3))
    assert set(before) == set(after)
    for k, r in after.items():
        if not base_spans(before[k].text):
            assert r == before[k]
        assert r.n_chars == len(r.text)
    assert sum(bool(base_spans(r.text)) for r in after.values()) < max(1, sum(bool(base_spans(r.text)) for r in before.values()))


def test_sources_meet_their_targets(stages):
    size = {r.doc_id: len((r.text or "").split()) for r in stages[3].collect()}
    source = {r.doc_id: r.source for r in stages[3].collect()}
    sizes, taken, longest = Counter(), Counter(), Counter()
    for k, n in size.items():
        sizes[source[k]] += n
        longest[source[k]] = max(longest[source[k]], n)
    times = Counter(r.doc_id for r in stages[4].collect())
    for k, n in times.items():
        taken[source[k]] += n * size[k]
        assert n <= 3
    for x, goal in targets_by_force(dict(sizes)).items():
        assert abs(taken[x] - goal) <= longest[x]


def test_packing_holds_all_tokens(stages):
    docs = stages[4].groupBy("doc_id").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")).collect()
    want = sum(len(library_ids("word_bpe_49k.json", r.text, 1)) * r.n for r in docs)
    pieces = stages[5].collect()
    assert sum(r.length for r in pieces) == want
    totals = Counter()
    for r in pieces:
        totals[r.sequence_id] += r.length
    assert [n for k, n in sorted(totals.items())][:-1] == [2048] * (len(totals) - 1)


def test_run_gives_the_stages_result(spark, sf_dir, stages):
    ran = corpus_pipeline.run(spark, sf_dir)
    columns = ["doc_id", "start", "length", "doc_tokens"]
    firsts = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()))
    assert set(columns) <= set(ran.columns) and firsts(ran) == firsts(stages[5])


def test_pipeline_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    from test_llm import DOCS, ODD

    rows = [(k, x, "en", None if k % 4 == 0 else "a", None) for k, x in enumerate(ODD)] + [(None, x, None, None, 3) for x in ODD] + [(3, x, "de", "b", 1) for x in ODD[:7]]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("id", "key", "score", "node", "kept", "size", "mix_key", "bucket"):
        docs = docs.withColumn(name, F.lit("x"))
    found = {name: stage(spark, docs, sf_dir) for name, stage in corpus_pipeline.STAGES}
    n = {name: df.count() for name, df in found.items()}
    assert all(found[name].columns == docs.columns for name, _ in corpus_pipeline.STAGES[:-1])
    classes = classes_by_force(dict(enumerate(x for _, x, *_ in rows)))
    assert n["MinHash near-dedup"] == len(set(classes.values())) and n["secret scans"] == len(rows) and n["quality classifier"] <= len(rows)
    texts = Counter(x for _, x, *_ in rows)
    assert set(r.text for r in found["mixing sources to target weights"].select("text").collect()) <= set(texts)
    tokens = sum(len(library_ids("word_bpe_49k.json", x, 1)) * k for x, k in texts.items())
    assert found["packing"].agg(F.sum("length")).first()[0] == tokens
