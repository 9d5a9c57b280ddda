import random

from pyspark.sql import functions as F

from textmill.llm.merkle import archives_of, audit


def replica(spark, rows):
    return spark.createDataFrame([(a, o, None if p is None else bytearray(p)) for a, o, p in rows], "archive long, offset long, payload binary")


def records(rng, archives=3, each=120):
    rows = []
    for a in range(archives):
        offset = 0
        for _ in range(each):
            p = rng.randbytes(rng.randint(1, 60))
            rows.append((a, offset, p))
            offset += len(p)
    return rows


def test_damage_is_found_and_only_damage(spark):
    rng = random.Random(8)
    a = records(rng)
    b, want = [], set()
    for i, (arch, off, p) in enumerate(a):
        if arch == 1:
            b.append((arch, off, p))
        elif i % 50 == 7:
            b.append((arch, off, p[:-1] + bytes([p[-1] ^ 1])))
            want.add((arch, off, "changed"))
        elif i % 50 == 19:
            want.add((arch, off, "missing"))
        else:
            b.append((arch, off, p))
    b.append((5, 0, b"only here"))
    want.add((5, 0, "extra"))
    roots, leaves, bad = audit(replica(spark, a), replica(spark, b), leaf_bytes=64, fanout=4)
    assert {tuple(r) for r in bad.collect()} == want
    state = {r["archive"]: r["root_a"] == r["root_b"] for r in roots.collect()}
    assert state == {0: False, 1: True, 2: False, 5: False}
    assert {(r["archive"], r["node"]) for r in leaves.collect()} == {(x, o // 64) for x, o, _ in want}


def test_equal_empty_and_odd_replicas(spark):
    rows = [(0, 0, b"a"), (0, 1, None), (0, 2, b""), (0, 3, b"x"), (0, 3, b"x"), (0, 3, b"y")]
    a = replica(spark, rows)
    roots, leaves, bad = audit(a, replica(spark, rows[::-1]), leaf_bytes=2, fanout=2)
    assert bad.count() == 0 and leaves.count() == 0
    assert [r["root_a"] == r["root_b"] for r in roots.collect()] == [True]
    none = replica(spark, [])
    assert [x.count() for x in audit(none, none)] == [0, 0, 0]
    roots, _, bad = audit(a, none)
    assert {r["status"] for r in bad.collect()} == {"missing"} and roots.first()["root_b"] is None


def test_offsets_follow_the_records(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (None, "u", "x")], "page_id long, url string, html string")
    rows = archives_of(pages.select("page_id", "url", "html").unionByName(odd), 20).withColumn("n", F.octet_length("payload"))
    for _, g in rows.toPandas().sort_values("offset").groupby("archive"):
        assert g["offset"].tolist() == [0, *g["n"].cumsum().tolist()[:-1]]
