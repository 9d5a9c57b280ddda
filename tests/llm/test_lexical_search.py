import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textmill.llm import lexical_search as L

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w.translate(LOWER) for w in PATTERN.findall(text or "")]


def brute(docs, items, k):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = 0
            for t in words(text):
                if t in b:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 64)
    text = "Ab-cd É日本x9 " * 40 + "y" * 500 + "\n\tZ_z"
    want = Counter(w.encode() for w in words(text))
    assert L.terms(text) == want and L.terms(None) == Counter() and L.terms(" .;") == Counter()


def test_equals_brute_force(spark, odd_docs, odd_rows, sf_docs, no_docs):
    items = [("a", "one TWO three, x"), ("b", None), ("c", ""), ("d", "Word word word 日本語 text"), ("a", "null id has"), ("e", "absent")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, rank int")
    for k in (1, 3, 20):
        got = sorted((tuple(r) for r in L.search(odd_docs, frame, k).collect()), key=repr)
        assert got == brute(odd_rows, items, k)
    rows = [tuple(r) for r in sf_docs.select("doc_id", "text").collect()]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    asked = [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in L.search(sf_docs, bench, 20).collect()), key=repr)
    assert got == brute(rows, asked, 20)
    assert L.search(no_docs, frame).collect() == [] and L.search(odd_docs, frame.limit(0)).collect() == []


def test_small_tiles_and_groups_give_the_same(spark, sf_docs, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(tuple(r) for r in L.search(sf_docs, bench, 5).collect())
    monkeypatch.setattr(L, "GROUP_BYTES", 4000)
    monkeypatch.setattr(L, "ITEM_TILE", 3)
    monkeypatch.setattr(L, "VOCABULARY_TILE", 16)
    monkeypatch.setattr(L, "DENSE", 100)
    assert sorted(tuple(r) for r in L.search(sf_docs.repartition(7), bench, 5).collect()) == want


def test_ties_are_cut_by_id_in_any_order(spark):
    docs = spark.range(2000).select((1999 - F.col("id")).alias("doc_id"), F.lit("same words here").alias("text"))
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = L.search(docs.repartition(5), items, 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [] or [r["doc_id"] for r in got] == [0, 1, 2, 3]
    more = docs.unionByName(spark.range(3000).select((F.col("id") + 5000).alias("doc_id"), F.lit("else").alias("text")))
    got = L.search(more.repartition(5), items, 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [0, 1, 2, 3] and len({r["score"] for r in got}) == 1


def test_vocabulary_tiles_keep_sums_exact():
    weights = np.array([20_000, 7, 0, 20_000], np.int64)
    items = [{0: 1, 1: 5, 2: 9, 3: 10**7}, {0: 3, 3: 1}]
    (first, tiles), = L.tiles_of(items, weights)
    total = np.zeros((2, 4), np.int64)
    for columns, matrix in tiles:
        assert ((matrix * weights[columns] * L.UNIT).sum(1) < L.EXACT).all()
        for c, counts in zip(columns, matrix.T):
            total[:, c] += counts.astype(np.int64)
    assert first == 0 and len(tiles) > 10 and total.tolist() == [[1, 5, 0, 10**7], [3, 0, 0, 1]]


def test_a_term_repeated_beyond_one_product(spark, monkeypatch):
    monkeypatch.setattr(L, "EXACT", 1 << 36)
    docs = spark.createDataFrame([(1, "rare other"), (2, "common other"), (3, "common rare rare")], "doc_id long, text string")
    items = [(1, "rare " * 300 + "common"), (2, "other rare")]
    got = sorted(tuple(r) for r in L.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == sorted(brute([tuple(r) for r in docs.collect()], items, 20))
