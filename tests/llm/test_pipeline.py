"""The corpus pipeline, stage by stage, on a small fixture."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from telemark.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_pack_what_is_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids, read = docs.columns, [set(r.doc_id for r in docs.select("doc_id").collect())], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, read, SMALL).write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        assert read.columns == columns
        ids.append(set(r.doc_id for r in read.select("doc_id").collect()))
    packed = corpus_pipeline.STAGES[-1][1](spark, read, SMALL)
    assert set(r.doc_id for r in packed.select("doc_id").collect()) == ids[3]
    assert ids[3] == ids[2] <= ids[1] <= ids[0]
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    assert len(good & ids[1]) >= 0.98 * len(good & ids[0])


def test_near_copies_leave_one(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
    a, b = text(), text()
    rows = [(4, a), (2, a + " more words"), (9, b), (None, a), (7, None), (8, None), (11, ""), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.ngram_jaccard_join(spark, docs, SMALL)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [2, 7, 8, 9, 11, 12] and left.count() == 7


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_is_registered_and_runs(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name] is queries.QUERIES[name]
    df = queries.QUERIES[name](spark, SMALL)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_the_pipeline_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
