import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from textmill.llm.exact_dedup import build_directory, exact_groups, keep_one


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_equal_brute_force(odd_docs, odd_rows, sf_docs, no_docs):
    assert sorted(map(tuple, exact_groups(odd_docs).collect()), key=repr) == brute(odd_rows)
    rows = [tuple(r) for r in sf_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, exact_groups(sf_docs, capacity=8).collect()), key=repr) == brute(rows)
    assert exact_groups(no_docs).collect() == [] and keep_one(no_docs).collect() == []


def test_hot_group(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_groups(df).where("group_size > 1").groupBy("keep_id", "group_size").count().collect()
    assert [tuple(r) for r in got] == [(5997, 2000, 2000)]


def test_one_row_of_each_text_stays(odd_docs, odd_rows):
    got = keep_one(odd_docs)
    assert got.columns == odd_docs.columns
    texts = sorted((r["text"] or "") for r in got.collect())
    assert texts == sorted({t or "" for _, t in odd_rows})


def test_columns_with_any_names(spark):
    rows = [(1, "a", 1, 2, 3), (2, "a", 4, 5, 6), (None, "b", 7, 8, 9), (2, "a", 4, 5, 6)]
    for names in (("_of", "sha", "row"), ("d_id", "id", "h"), ("bucket", "cell", "kept")):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {names[0]} int, {names[1]} int, {names[2]} int")
        got = keep_one(docs)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=repr) == [(2, "a", 4, 5, 6), (None, "b", 7, 8, 9)]
        assert exact_groups(docs).count() == 4


def test_directory_splits_overfull_buckets(spark):
    slots = spark.range(2000).select(F.xxhash64("id").alias("h"))
    directory, depth = build_directory(slots, 50, 2000)
    placed = slots.join(directory, F.shiftrightunsigned("h", 64 - depth) == F.col("cell"))
    held = placed.groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in held) == 2000
    assert all(r["count"] <= 50 or r["depth"] == depth for r in held)
    # a bucket is the least split that fits: its parent prefix is overfull
    counts = {}
    for r in placed.select("cell").collect():
        for d in range(depth + 1):
            key = (d, r["cell"] >> (depth - d))
            counts[key] = counts.get(key, 0) + 1
    for r in placed.select("cell", "depth").distinct().collect():
        if r["depth"]:
            d = r["depth"] - 1
            assert counts[(d, r["cell"] >> (depth - d))] > 50
