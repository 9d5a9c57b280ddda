"""Whitening of integer vectors by Chebyshev-filtered subspace iteration.

1. The distinct vectors are packed into blocks: one row holds some thousand
   vectors as the narrowest integers that hold their distances from the block's
   least entry. The blocks are a written table, a fraction of the input's size,
   and all passes read it.
2. Sums per dimension are exact integers, so centring is: an entry less the
   whole part of its dimension's mean is an integer, and only the fraction of the
   mean is subtracted in doubles. No pass multiplies what is not centred.
3. A pass multiplies: each task adds up Xc'(Xc Q) over its blocks for a narrow
   matrix Q. The covariance V itself is never formed; the driver holds matrices of
   ``dimensions x block`` only.
4. Each round damps the unwanted part of the spectrum, [0, least Ritz value of the
   block], by the Chebyshev recurrence of ``degree`` passes, then QR and a
   Rayleigh-Ritz step give new pairs. The product of the Rayleigh-Ritz step is the
   first one of the next filter, so a round takes ``degree`` passes.
5. Pairs are certified in two steps: the residuals ``Vq - eq`` are down to rounding,
   and after another round in which random vectors stand in for all columns but the
   wanted ones the same values come out, so no larger one was missed.
   Where rounds stop helping, the block doubles; at the latest it spans the space,
   and a Rayleigh-Ritz step is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialize

#: Bytes of a block's entries as 64-bit integers.
BLOCK_BYTES = 1 << 20
#: Partial sums that go to the driver as they are; more are added up in tasks first.
FAN = 64
#: Residuals count as rounding up to so many units of the largest value.
ROUNDING = 64 * np.finfo(float).eps
#: A component whose value is below this share of the largest has none.
RANK = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What was learnt: ``n`` distinct vectors, exact ``sums`` per dimension, unit
    ``components`` as columns with their ``values`` (falling) and shares of the
    trace, ``identity_error`` and the number of ``passes`` over the vectors."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists (-1 for null or with a null entry) and all their entries."""
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    if values.null_count:
        owner = np.repeat(np.arange(len(lists)), np.maximum(lengths, 0))
        gone = np.unique(owner[values.is_null().to_numpy(zero_copy_only=False)])
        values = values.filter(pa.array(~np.isin(owner, gone)))
        lengths[gone] = -1
    return lengths, values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, rows, entries`` of the vectors of each length above 0."""
    lengths, values = matrix(lists)
    ends = np.cumsum(np.maximum(lengths, 0))
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        if len(values) == d * len(lengths):
            yield d, rows, values.reshape(-1, d)
        else:
            yield d, rows, values[(ends[rows] - d)[:, None] + np.arange(d)]


def packed(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Distinct vectors in blocks ``d, n, base, width, data``."""
    schema = "d int, n long, base long, width int, data binary"

    def block(x: np.ndarray) -> pa.RecordBatch:
        base = int(x.min())
        reach = int(x.max()) - base
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if reach <= np.iinfo(t).max)
        data = (x.view(np.uint64) - np.uint64(base % (1 << 64))).astype(kind).tobytes()
        row = {"d": x.shape[1], "n": len(x), "base": base, "width": np.dtype(kind).itemsize, "data": data}
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column(0)):
                size = max(1, BLOCK_BYTES // (8 * d))
                x = np.concatenate([*held.pop(d, []), np.ascontiguousarray(x)])
                for at in range(0, len(x) - size + 1, size):
                    yield block(x[at : at + size])
                if len(x) % size:
                    held[d] = [x[len(x) - len(x) % size :]]
        for rest in held.values():
            yield block(rest[0])

    lists = vectors.select(F.col(f"`{vec_col}`").cast("array<bigint>").alias("x")).where("size(x) > 0")
    return lists.distinct().mapInArrow(run, schema)


def unpack(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The integer matrices of a batch of blocks."""
    for d, base, width, data in zip(*(batch.column(c).to_pylist() for c in ("d", "base", "width", "data"))):
        x = np.frombuffer(data, f"<u{width}").astype(np.uint64) + np.uint64(base % (1 << 64))
        yield x.view(np.int64).reshape(-1, d)


def added(blocks: DataFrame, tasks: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> list[np.ndarray]:
    """Sums of ``part(matrix)`` over all blocks: at most ``FAN`` of them or the root
    of the number of tasks, to be added by the caller."""

    def total(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = None
        for a in arrays:
            out = a if out is None else out + a
        if out is not None:
            data = pa.array([np.ascontiguousarray(out, kind).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), data], names=["part", "sums"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from total(part(x) for b in batches for x in unpack(b))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from total(np.frombuffer(v, kind) for b in batches for v in b.column("sums").to_pylist())

    sums = blocks.mapInArrow(first, "part int, sums binary")
    if tasks > FAN:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(second, "part int, sums binary")
    return [np.frombuffer(r["sums"], kind) for r in sorted(sums.collect(), key=lambda r: r["part"])]


def centred(sums: tuple[int, ...], n: int) -> Callable[[np.ndarray], np.ndarray]:
    """``x - sums / n`` in doubles."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole).astype(float) - rest


def learn(vectors: DataFrame, vec_col: str = "x", components: int = 16, degree: int = 10) -> Whitening | None:
    """The leading components of the distinct vectors in ``vec_col``, arrays of integers.

    Null and empty vectors and vectors with a null entry are left out. Vectors of
    one length are learnt from: the length most distinct vectors have, of equal
    counts the largest. Repeated vectors count once, ties (equal eigenvalues) give
    any basis of their space. Of a spectrum with fewer values above 0 (up to
    rounding) than ``components``, only those; none for a single vector. None for
    a table without vectors."""
    spark = vectors.sparkSession
    blocks = materialize(packed(vectors, vec_col), "whiten-blocks")
    common = blocks.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return None
    d, n = common["d"], common["n"]
    blocks = blocks.where(F.col("d") == d)
    tasks = blocks.rdd.getNumPartitions()

    low = np.int64((1 << 32) - 1)
    halves = added(blocks, tasks, lambda x: np.concatenate([(x >> np.int64(32)).sum(0), (x & low).sum(0)]), "<i8")
    sums = tuple((sum(int(h[i]) for h in halves) << 32) + sum(int(h[d + i]) for h in halves) for i in range(d))
    centre = centred(sums, n)
    passes = 1

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return (c.T @ (c @ q)).ravel()

        return np.sum(added(blocks, tasks, part, "<f8"), 0).reshape(q.shape) / n

    trace = float(np.sum(added(blocks, tasks, lambda x: np.array([np.square(centre(x)).sum()]), "<f8"))) / n
    k = min(components, d)
    values, parts = leading(product, d, k, degree)
    keep = values > RANK * max(values[0], 0.0)
    values, parts = values[keep], parts[:, keep]
    error = 0.0
    if len(values):
        scaled = parts / np.sqrt(values)

        def moments(x: np.ndarray) -> np.ndarray:
            z = centre(x) @ scaled
            return np.concatenate([z.sum(0), (z.T @ z).ravel()])

        total = np.sum(added(blocks, tasks, moments, "<f8"), 0) / n
        mean = total[: len(values)]
        cov = total[len(values) :].reshape(len(values), -1) - np.outer(mean, mean)
        error = float(np.abs(cov - np.eye(len(values))).max())
    return Whitening(n, sums, values, parts, values / trace if trace else values, error, passes + 2)


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, degree: int = 10, seed: int = 11):
    """The ``k`` largest eigenpairs of a positive semidefinite matrix of ``d`` rows
    that is known by its products only: ``values, vectors``."""
    rng = np.random.default_rng(seed)
    width = min(d, 2 * k)
    basis = np.linalg.qr(rng.standard_normal((d, width)))[0]

    def ritz(basis: np.ndarray):
        image = product(basis)
        h = basis.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        return values, basis, image, np.linalg.norm(image - basis * values, axis=0)[:k]

    def filtered(basis: np.ndarray, image: np.ndarray, top: float, cut: float) -> np.ndarray:
        # Chebyshev polynomial on [0, cut], scaled so that it is 1 at ``top``
        half = cut / 2
        sigma = half / (top - half)
        tau = 2 / sigma
        before, now = basis, (image - half * basis) * (sigma / half)
        for _ in range(degree - 1):
            following = 1 / (tau - sigma)
            before, now = now, (product(now) - half * now) * (2 * following / half) - before * (sigma * following)
            sigma = following
        return np.linalg.qr(now)[0]

    values, basis, image, left = ritz(basis)
    certain, last = None, math.inf
    while width < d and values[0] > 0:
        top, worst = values[0], left.max()
        # rounding of a product, or a little more where further rounds do not help
        bound = np.maximum(ROUNDING * top, 1e-10 * values[:k])
        settled = worst <= ROUNDING * top or (worst > last / 4 and (left <= bound).all())
        if settled and certain is not None and (np.abs(values[:k] - certain) <= bound).all():
            break
        if settled or worst > 0.7 * last:
            # random vectors: instead of the guards of settled pairs, else beside a block too narrow
            stay = k if settled else width
            certain = values[:k].copy() if settled else None
            width = width if settled else min(d, 2 * width)
            basis = np.linalg.qr(np.concatenate([basis[:, :stay], rng.standard_normal((d, width - stay))], 1))[0]
            values, basis, image, left = ritz(basis)
            last = math.inf
            if width == d:
                break
        else:
            last = worst
        cut = min(max(values[-1], 1e-8 * top), 0.999 * top)
        values, basis, image, left = ritz(filtered(basis, image, top, cut))
    return values[:k], basis[:, :k]


def whiten(rows: DataFrame, learnt: Whitening | None, id_col: str = "vec_id", vec_col: str = "x") -> DataFrame:
    """``id, deviation, whitened`` of each row whose vector has the learnt length and
    no null entry; other rows have no result, and neither has any without a
    ``learnt``. ``whitened`` holds a number for each component; ``deviation`` is the
    exact sum of ``(n x - sums)^2``, null beyond a long. Rows may repeat, each has its
    own result; the id may be null; other columns are not read."""
    schema = rows.select(F.col(f"`{id_col}`").alias(id_col)).withColumns(
        {"deviation": F.lit(None).cast("long"), "whitened": F.array().cast("array<double>")}
    ).schema
    if learnt is None:
        return rows.sparkSession.createDataFrame([], schema)
    d, n, sums = learnt.dimensions, learnt.n, learnt.sums
    centre = centred(sums, n)
    scaled = learnt.components / np.sqrt(learnt.values)

    def deviations(x: np.ndarray, c: np.ndarray) -> pa.Array:
        # n x - sums is n times the centred entry; integers where they fit, else exact ones
        largest = np.square(c * float(n)).sum(1).max(initial=0.0)
        if largest < 2.0**61:
            whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
            return pa.array(np.square((x - whole) * np.int64(n) - rest).sum(1), pa.int64())
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at, x in by_length(batch.column(1)):
                if length != d:
                    continue
                c = centre(x)
                z = np.ascontiguousarray(c @ scaled)
                ends = np.arange(len(z) + 1, dtype=np.int32) * np.int32(z.shape[1])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), deviations(x, c), lists], names=[id_col, "deviation", "whitened"])

    lists = rows.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{vec_col}`").cast("array<bigint>").alias("_x"))
    return lists.where("size(_x) > 0").mapInArrow(run, schema)
