import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from textmill.llm.common import materialize

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, f in P.STAGES:
        out.append(materialize(f(spark, out[-1], SF), "stage-test"))
    return out


def test_columns_stay_until_the_last(stages):
    assert len(P.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_good_documents(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.where("quality = 1").join(stages[0], "doc_id").select("doc_id")
    assert good.join(stages[1], "doc_id", "left_anti").count() <= 0.01 * good.count()


def test_one_document_of_each_group_stays(stages):
    _, a, b, c, *_ = stages
    assert b.count() == b.select("text").distinct().count() == a.select("text").distinct().count()
    texts = {r["doc_id"]: WORD.findall(r["text"].lower()) for r in b.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items() if w}
    kept = {r[0] for r in c.select("doc_id").collect()}
    posts = {}
    for i, s in sets.items():
        for z in s:
            posts.setdefault(z, []).append(i)
    linked = {i: {j for z in s for j in posts[z] if j != i and 100 * len(s & sets[j]) >= 80 * len(s | sets[j])} for i, s in sets.items()}
    assert all(not (linked[i] & kept) for i in kept if i in linked)
    assert all(linked[i] for i in texts if i not in kept)


def test_mixture_and_tokens(stages):
    *_, c, mixed, last = stages
    before = {r["doc_id"]: r["text"] for r in c.collect()}
    assert all(before[r["doc_id"]] == r["text"] or before[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split() for r in mixed.collect())
    assert mixed.where(F.char_length("text") != F.col("n_chars")).count() == 0
    assert last.count() == mixed.count() and last.where("not lossless or n_tokens <> size(ids)").count() == 0


def test_near_dedup_decides_by_row_not_by_id(spark):
    base = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(base + [x]) for x in ("p", "q", "r"))
    clean = " ".join(f"z{i}" for i in range(40))
    rows = [
        (1, a), (5, b), (5, clean),  # 5 has a near copy and a clean text
        (None, "n " + clean[::-1]), (None, "m " + clean[::-1]), (None, c),  # near copies without ids
        (8, " ".join("k" + w for w in base)), (8, " ".join("k" + w for w in base + ["s"])),  # near copies of one id
        (9, "twice the same text of one id"), (9, "twice the same text of one id"),
        (10, " "), (10, " "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    kept = [tuple(r) for r in out.collect()]
    assert set(kept) <= set(rows)
    assert sorted(i for i, _ in kept if i is not None) == [1, 5, 8, 9, 10, 10]
    assert (1, a) in kept and (5, clean) in kept
    assert len([t for i, t in kept if i is None]) == 1 and (None, c) not in kept
