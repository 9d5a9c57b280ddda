import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import whitening as W
from textmill.llm.queries import grid, op11_whitening


def brute(x, k):
    fit = np.unique(x, axis=0)
    centred = fit - fit.min(0)  # small integers: large ones lose digits in a mean
    centred = centred - centred.mean(0)
    v = centred.T @ centred / len(fit)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return len(fit), fit.sum(0), e[:k], u[:, :k], e[:k] / e.sum()


def same_up_to_sign(a, b, tol):
    return all(min(np.abs(a[:, i] - b[:, i]).max(), np.abs(a[:, i] + b[:, i]).max()) < tol for i in range(b.shape[1]))


@pytest.mark.parametrize("values", [
    np.linspace(2, 1, 64),  # flat
    1.0 / np.arange(1, 200) ** 2,  # falling
    np.r_[1e9, np.linspace(2, 1, 150)],  # one far above the rest
    np.r_[np.ones(5), np.zeros(60)],  # ties and a null space
])
def test_eigenpairs_of_known_spectra(values):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = turn @ np.diag(values) @ turn.T
    passes = []
    got, vectors = W.leading(lambda q: (passes.append(q.shape[1]), v @ q)[1], len(values), 8)
    assert np.abs(got - np.sort(values)[::-1][:8]).max() < 1e-12 * values.max() + 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert np.linalg.norm(v @ vectors - vectors * got) < 1e-11 * values.max()
    assert len(passes) > 1 and max(passes) <= len(values)


def test_query_equals_a_dense_decomposition(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", grid(F.col("embedding")).alias("x")).collect()
    x = np.array([r["x"] for r in rows])
    n, s, e, u, share = brute(x, 16)
    got = {}
    for r in op11_whitening(spark, sf).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(x) and all(sorted(g) == list(range(1, 17)) for g in got.values())
    z = np.array([[got[r["vec_id"]][c]["whitened"] for c in range(1, 17)] for r in rows])
    assert same_up_to_sign(z, (x - s / n) @ (u / np.sqrt(e)), 1e-8)
    for r, v in zip(rows, x):
        assert got[r["vec_id"]][1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))
    one = got[rows[0]["vec_id"]]
    assert one[1]["n"] == n and one[1]["identity_error"] < 1e-10
    assert np.allclose([one[c]["explained"] for c in range(1, 17)], share, rtol=1e-10)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (60, 3)) + 10**15
    rows = [(i, [int(a) for a in v], "c") for i, v in enumerate(x)]
    rows += rows[:20]  # repeated rows
    rows += [(100, rows[0][1], "c"), (None, rows[1][1], "c"), (101, None, "c"), (102, [], "c"), (103, [1, None, 2], "c"), (104, [7, 8], "c")]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>, whitened string")
    learnt = W.learn(df, "x", components=2)
    n, s, e, u, share = brute(x, 2)
    assert learnt.n == n and learnt.sums == tuple(sum(int(a) for a in np.unique(x, axis=0)[:, i]) for i in range(3))
    out = W.whiten(df, learnt).collect()
    assert len(out) == 60 + 20 + 2 and sum(r["vec_id"] is None for r in out) == 1
    by_id = {r["vec_id"]: r for r in out}
    assert by_id[100]["whitened"] == by_id[0]["whitened"]
    centred = np.array([[float(a * n - t) / n for a, t in zip(map(int, v), learnt.sums)] for v in x])
    z = np.array([by_id[i]["whitened"] for i in range(60)])
    assert same_up_to_sign(z, centred @ (u / np.sqrt(e)), 1e-8)
    exact = [sum((n * int(a) - t) ** 2 for a, t in zip(v, learnt.sums)) for v in x]
    assert [by_id[i]["deviation"] for i in range(60)] == exact


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [0, 0]), (2, [1 << 40, 0]), (3, [0, 1 << 40])], "vec_id long, x array<long>")
    out = W.whiten(df, W.learn(df, "x")).collect()
    assert [r["deviation"] for r in out] == [None] * 3 and len(out[0]["whitened"]) == 2


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "vec_id long, x array<long>")
    assert W.learn(none) is None and W.whiten(none, None).collect() == []
    one = spark.createDataFrame([(1, [3, 4]), (2, [3, 4])], "vec_id long, x array<long>")
    learnt = W.learn(one)
    assert learnt.n == 1 and len(learnt.values) == 0
    assert [(r["deviation"], r["whitened"]) for r in W.whiten(one, learnt).collect()] == [(0, []), (0, [])]


def test_many_partial_sums_are_added_in_tasks(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.col("id"), F.col("id") % 7).alias("x"))
    blocks = W.packed(df, "x").repartition(W.FAN + 6)
    sums = W.added(blocks, W.FAN + 6, lambda x: x.sum(0), "<i8")
    assert len(sums) <= 9 and np.sum(sums, 0).tolist() == [sum(range(3000)), sum(i % 7 for i in range(3000))]
