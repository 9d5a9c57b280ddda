import numpy as np
from pyspark.sql import functions as F

from textmill.llm import quality
from textmill.llm.quality import STATS, WORDS, Machine, features, good_documents, learn, quality_scores


def test_linear_time_form_equals_the_pair_sum():
    rng = np.random.default_rng(1)
    m = Machine(0.3, rng.normal(size=WORDS + STATS), rng.normal(size=(WORDS + STATS, 4)) / 9, np.zeros(STATS), np.ones(STATS))
    bucket, weight, stats = features("some words, and Some more words; 12 of them!")
    x = np.concatenate([weight, m.statistics(stats)])
    at = np.concatenate([bucket, np.arange(WORDS, WORDS + STATS)])
    z = m.bias + m.linear[at] @ x
    for i in range(len(x)):
        for j in range(i):
            z += m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j]
    assert np.isclose(m.score(bucket, weight, stats), 1 / (1 + np.exp(-z)))


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, learn(docs, labels, sample_rows=3000)).join(labels, "doc_id").where("held_out")
    rate = dict(got.groupBy("quality").agg(F.avg("predicted")).collect())
    assert rate[1] > 0.98 and rate[0] < 0.15


def test_odd_texts_and_agreement(odd_docs, odd_rows, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    m = learn(odd_docs, labels)
    got = quality_scores(odd_docs, m).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in got if r["doc_id"] in (1, 6)]
    assert len(set(same)) == 1 and len(same) == 3
    kept = good_documents(odd_docs, m)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r["predicted"] for r in got)


def test_empty_tables(no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = learn(no_docs, none)
    assert quality_scores(no_docs, m).collect() == [] and good_documents(no_docs, m).collect() == []
    assert 0 <= m.score(*features("text")) <= 1
    assert quality.features(None)[0].size == 0
