import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmill.llm import sharding as S


def plain(rows, n_shards, bucket_bytes, seed):
    """The same two passes over (key, id, bytes) in one process."""
    total = sum(b for _, _, b in rows)
    buckets = {}
    for key, i, _ in rows:
        buckets.setdefault(key % (total // bucket_bytes + 1), []).append((key, i))
    order = []
    for b in sorted(buckets):
        held = [i for _, i in sorted(buckets[b])]
        rng = random.Random(f"{seed}/{b}/0")
        for j in range(len(held) - 1, 0, -1):
            k = rng.randrange(j + 1)
            held[j], held[k] = held[k], held[j]
        order += held
    size, longer = divmod(len(order), n_shards)
    cuts = [size + (s < longer) for s in range(n_shards)]
    out, at = {}, 0
    for s, n in enumerate(cuts):
        for slot in range(n):
            out[order[at]] = (s, slot)
            at += 1
    return out


def check_law(rows, n_shards):
    per = Counter(r["shard"] for r in rows)
    counts = [per.get(s, 0) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and set(per) <= set(range(n_shards))
    for s in per:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s]))


def test_equals_the_two_passes_in_one_process(spark, sf_docs):
    docs = sf_docs
    key = F.xxhash64(F.lit(13), *docs.columns)
    rows = [tuple(r) for r in docs.select(key, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 1).collect()]
    for bucket_bytes, n_shards in ((20_000, 16), (1 << 30, 7), (300_000, 1)):
        out = S.shuffle_shards(docs, n_shards, bucket_bytes=bucket_bytes).collect()
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out} == plain(rows, n_shards, bucket_bytes, 13)
        check_law(out, n_shards)


def test_rows_and_columns_stay_whole(spark, odd_docs, odd_rows):
    docs = odd_docs.withColumn("slot", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    out = S.shuffle_shards(docs, 4, bucket_bytes=1000)
    assert out.columns == [c for c in docs.columns if c != "slot"] + ["shard", "slot"]
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(odd_rows)
    assert all(r["bucket"] == 2 and r["row"] == 1 and r["m"] == {"a": 1} for r in rows)
    check_law(rows, 4)


def test_empty_and_fewer_rows_than_shards(no_docs, odd_docs):
    assert S.shuffle_shards(no_docs).collect() == []
    rows = S.shuffle_shards(odd_docs, 50).collect()
    check_law(rows, 50)
    with pytest.raises(ValueError):
        S.shuffle_shards(odd_docs, 0)


def test_reruns_agree_whatever_the_tasks_and_seeds_differ(spark, sf_docs):
    def places(df, **options):
        return sorted((r["doc_id"], r["shard"], r["slot"]) for r in S.shuffle_shards(df, bucket_bytes=50_000, **options).collect())

    one = places(sf_docs)
    assert one == places(sf_docs.repartition(9)) and one != places(sf_docs, seed=14)
    # a shuffle, not an order of ids: neighbours in id are far apart
    at = {i: s * 100 + t for i, s, t in one}
    near = sum(abs(at[i] - at[i + 1]) <= 1 for i in range(len(at) - 1))
    assert near < len(at) / 10


def test_one_row_repeated_fills_many_buckets(spark):
    hot = spark.range(6000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("hot " * 5).alias("text"))
    docs = hot.unionByName(spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text")))
    buckets = S.scattered(docs, "text", 5_000, 13).groupBy("bucket", "part").count().collect()
    assert max(r["count"] for r in buckets) * 26 < 6 * 5_000
    rows = S.shuffle_shards(docs, 16, bucket_bytes=5_000).collect()
    assert len(rows) == 8000
    check_law(rows, 16)


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(S.fisher_yates(3, str(s))) for s in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
    assert S.fisher_yates(0, "x") == [] and S.fisher_yates(1, "x") == [0]


def test_written_shards(spark, sf_docs, tmp_path):
    path = S.write_shards(sf_docs, str(tmp_path / "shards"), n_shards=4, bucket_bytes=50_000)
    back = spark.read.parquet(path)
    assert sorted(back.columns) == sorted([*sf_docs.columns, "shard", "slot"]) and back.count() == sf_docs.count()
    check_law(back.collect(), 4)
