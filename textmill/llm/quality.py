"""Quality classifier: a factorisation machine over hashed words, structure
statistics and the text's length.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pair
sum is taken in time linear in the features that are not zero:
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import fold
from textmill.llm.words import word_hashes

#: Hash buckets of words.
WORDS = 1 << 15
STATS = 18
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 punctuation, 7 not ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:] = 1, 2, 3, 4, 5, 7
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 6
_DOT, _BAR, _BANG, _COMMA = b".|!,"


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and their weights (unit length), and the statistics."""
    data = (text or "").encode()
    stats = np.zeros(STATS)
    h, start, end = word_hashes(data)
    if not len(h):
        stats[0], stats[1] = np.log1p(len(data)), 1.0
        return np.empty(0, np.int32), np.empty(0, np.float32), stats
    raw = np.frombuffer(data, np.uint8)
    share = np.bincount(_KIND[raw], minlength=8) / len(raw)
    lengths = end - start
    bucket, count = np.unique((h >> np.uint64(49)).astype(np.int64), return_counts=True)
    weight = np.sqrt(count)
    weight /= np.sqrt((weight * weight).sum())
    lines = data.split(b"\n")
    freq = np.bincount(raw, minlength=256)
    seen = freq[freq > 0] / len(raw)
    stats[:] = [
        np.log1p(len(data)),
        0.0,
        np.log1p(len(h)),
        lengths.mean(),
        lengths.std(),
        (lengths > 14).mean(),
        share[2],
        share[3],
        share[5],
        share[6],
        share[7],
        100 * freq[_BAR] / len(raw),
        100 * freq[_BANG] / len(raw),
        freq[_DOT] / len(h),
        freq[_COMMA] / len(h),
        len(np.unique(h)) / len(h),
        len(set(lines)) / len(lines),
        float(-(seen * np.log2(seen)).sum()),
    ]
    return bucket.astype(np.int32), weight.astype(np.float32), stats


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # WORDS + STATS
    factors: np.ndarray  # (WORDS + STATS, k)
    mean: np.ndarray
    scale: np.ndarray

    def statistics(self, stats: np.ndarray) -> np.ndarray:
        """Statistics as features: standardised, kept within 4 deviations."""
        return np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(STATS)

    def score(self, bucket: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> float:
        x = np.concatenate([weight, self.statistics(stats)])
        at = np.concatenate([bucket, np.arange(WORDS, WORDS + STATS)])
        vx = self.factors[at] * x[:, None]
        pairs = 0.5 * ((vx.sum(0) ** 2).sum() - (vx * vx).sum())
        z = self.bias + self.linear[at] @ x + pairs
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], k: int = 8, epochs: int = 12, batch: int = 256, seed: int = 7) -> Machine:
    """Adam on the logistic loss over labelled feature rows, in a fixed order."""
    rng = np.random.default_rng(seed)
    d = WORDS + STATS
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, STATS))
    m = Machine(0.0, np.zeros(d), rng.normal(0, 0.05, (d, k)), stats.mean(0), np.maximum(stats.std(0), 1e-6))
    if not rows:
        m.factors[:] = 0
        return m
    y = np.array([r[3] for r in rows], float)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m.bias = float(np.log(rate / (1 - rate)))
    tail = np.arange(WORDS, d)
    at = [np.concatenate([r[0], tail]) for r in rows]
    x = [np.concatenate([r[1], m.statistics(r[2])]) for r in rows]
    moments = [np.zeros((d, k + 1)), np.zeros((d, k + 1)), 0.0, 0.0]
    step = 0
    for epoch in range(epochs):
        lr = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            cols = np.concatenate([at[i] for i in pick])
            vals = np.concatenate([x[i] for i in pick])
            sizes = np.array([len(at[i]) for i in pick])
            first = np.cumsum(sizes) - sizes
            vx = m.factors[cols] * vals[:, None]
            sums = np.add.reduceat(vx, first, axis=0)
            pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx * vx).sum(1), first))
            z = m.bias + np.add.reduceat(m.linear[cols] * vals, first) + pairs
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            e = np.repeat(err, sizes) * vals
            grad = np.empty((len(cols), k + 1))
            grad[:, 0] = e
            grad[:, 1:] = e[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            used, inverse = np.unique(cols, return_inverse=True)
            g = np.stack([np.bincount(inverse, grad[:, f], len(used)) for f in range(k + 1)], 1)
            g[:, 0] += 1e-5 * m.linear[used]
            g[:, 1:] += 1e-5 * m.factors[used]
            step += 1
            for b, power, j in ((0.9, 1, 0), (0.999, 2, 1)):
                moments[j][used] = b * moments[j][used] + (1 - b) * g**power
            move = lr * (moments[0][used] / (1 - 0.9**step)) / (np.sqrt(moments[1][used] / (1 - 0.999**step)) + 1e-8)
            m.linear[used] -= move[:, 0]
            m.factors[used] -= move[:, 1:]
            gb = float(err.sum())
            moments[2] = 0.9 * moments[2] + 0.1 * gb
            moments[3] = 0.999 * moments[3] + 0.001 * gb * gb
            m.bias -= lr * (moments[2] / (1 - 0.9**step)) / (np.sqrt(moments[3] / (1 - 0.999**step)) + 1e-8)
    return m


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 12_000,
) -> Machine:
    """Fit on at most ``sample_rows`` labelled documents outside fold 0, drawn by
    hash of the id. Only their hashed features reach the driver. Rows with a
    null label teach nothing; an id labelled twice counts with its larger label."""
    ident = F.col(f"`{id_col}`")
    known = labels.where((fold(ident) != 0) & F.col(f"`{label_col}`").isNotNull())
    known = known.groupBy(ident.alias("l_id")).agg((F.max(f"`{label_col}`") > 0).cast("int").alias("y"))
    drawn = known.orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows)
    texts = docs.select(ident.alias("id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(F.broadcast(drawn), F.col("id") == F.col("l_id")).select("id", "y", "text")  # sample_rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(2)]
            cols = [pa.array([g[i].astype(t).tobytes() for g in got], pa.binary()) for i, t in enumerate(("<i4", "<f4", "<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["id", "y", "bucket", "weight", "stats"])

    made = texts.mapInArrow(run, "id " + dict(texts.dtypes)["id"] + ", y int, bucket binary, weight binary, stats binary")
    rows = [
        (np.frombuffer(r["bucket"], "<i4"), np.frombuffer(r["weight"], "<f4"), np.frombuffer(r["stats"], "<f8"), r["y"], r["id"])
        for r in made.collect()
    ]
    rows.sort(key=lambda r: (r[4], r[3], r[0].tobytes()))
    return fit([r[:4] for r in rows])


def quality_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``id, held_out, score, predicted``. A null text
    scores as an empty one. Only id (for the fold) and text are read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)  # of fixed size
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    schema = rows.drop("_text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            score = [m.score(*features(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=[id_col, "score"])

    out = rows.mapInArrow(run, schema)
    return out.select(
        f"`{id_col}`",
        (fold(F.col(f"`{id_col}`")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the machine does not reject, with all columns. A null
    text is scored as an empty one. Repeated rows are judged each by itself, and
    alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = [m.score(*features(t.as_py())) >= threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
