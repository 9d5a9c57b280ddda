import re
from collections import Counter

from pyspark.sql import functions as F

from textmill.llm.common import materialize
from textmill.llm.mixing import mix_plan, mix_totals, mixed_documents, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] >= 2 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in above}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 900, None: 50, "é": 400, "z": 1}, {"a": 7}, {"a": 0, "b": 5}, {f"s{i}": 3**i for i in range(8)}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        want = water(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want), (got, want)


def test_taken_words_meet_targets_and_reruns_agree(sf_docs):
    first = mix_totals(sf_docs, block_words=500).toPandas()
    second = mix_totals(sf_docs, block_words=500).toPandas()
    key = ["doc_id", "taken"]
    assert first[key].sort_values(key).values.tolist() == second[key].sort_values(key).values.tolist()
    assert (first["taken"] <= 2 * first["size"]).all()
    source = {r[0]: r[1] for r in sf_docs.select("doc_id", "source").collect()}
    for _, g in first.groupby(first["doc_id"].map(source)):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 1
        assert g["size"].sum() == g["source_size"].iloc[0]


def test_any_stretch_of_the_schedule_is_near_the_shares(sf_docs):
    placed, pieces = mix_plan(sf_docs, block_words=200)
    share = {r["rank"]: r["target"] for r in placed.select("rank", "target").distinct().collect()}
    total = sum(share.values())
    rows = pieces.groupBy("slot", "rank").agg(F.sum("words").alias("w")).orderBy("slot").collect()
    head = Counter()
    for r in rows[: len(rows) // 3]:
        head[r["rank"]] += r["w"]
    done = sum(head.values())
    assert all(abs(head[s] / done - t / total) < 0.02 for s, t in share.items())


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = mix_totals(odd_docs).toPandas()
    assert len(got) == len(odd_rows)
    assert sorted(got["size"]) == sorted(len(WORD.findall(t or "")) for _, t in odd_rows)
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    assert mix_totals(no_docs).collect() == [] and mixed_documents(no_docs).collect() == []


def test_mixed_documents_hold_the_taken_words(sf_docs):
    out = materialize(mixed_documents(sf_docs, block_words=500), "mixed-test")
    assert out.columns == sf_docs.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    want = {r["doc_id"]: r["taken"] for r in mix_totals(sf_docs, block_words=500).collect() if r["taken"]}
    assert dict(got) == want


def test_null_and_repeated_ids_take_what_the_plan_says(spark):
    rows = [(None if i % 3 == 0 else i % 40, " ".join(f"w{i}x{j}" for j in range(i % 9 + 1)), f"s{i % 3}", 1, "k") for i in range(300)]
    rows += [(7, "same row twice over", "s1", 1, "k")] * 30 + [(None, None, "s1", 1, "k"), (None, " ", None, 1, "k")]
    # names that the plan uses itself
    for names in ("doc_id,text,source,pass,words", "doc_id,text,source,m_words,m_size", "doc_id,text,source,h,row", "doc_id,text,source,size,rank"):
        docs = spark.createDataFrame(rows, [*names.split(",")]).select(*names.split(","))
        placed, pieces = mix_plan(docs, block_words=50)
        out = mixed_documents(docs, block_words=50)
        assert out.columns == docs.columns
        got = out.collect()
        texts = Counter(r[1] for r in rows)
        assert sum(len(WORD.findall(r["text"])) for r in got) == pieces.agg({"words": "sum"}).first()[0]
        whole = Counter(r["text"] for r in got if r["text"] in texts)
        assert all(n <= 2 * texts[t] for t, n in whole.items()) and placed.count() == len(rows)
