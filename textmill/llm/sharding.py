"""Global shuffle into shards by two external passes.

1. Scatter: each row goes to a bucket by a seeded hash of the whole row. There are
   as many buckets as ``bucket_bytes`` go into the sizes of all texts, so each fits
   in a task's memory, and which rows a bucket gets depends on the rows alone, not
   on the cluster. The only way for a bucket to be much larger is one row that is
   repeated very often (or a text that is larger by itself): such buckets are
   found by a count and their rows scattered again by their position.
2. Shuffle: a task sorts its buckets by hash (on disk where need be), so that a
   bucket starts in the same order whatever came first, holds one bucket at a time,
   permutes it by Fisher-Yates, seeded by bucket, and writes it.

Buckets in a row are the global order. Its shards are runs of equal length: counts
are at most one apart, and a shard is made of whole buckets but for its two ends.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import hashable, materialize
from textmill.session import bounded_broadcast, scratch_path

#: A bucket of more than so many times its intended size is scattered again.
OVERFULL = 4
#: Rows that leave a task in one batch.
BATCH_ROWS = 256


def fisher_yates(n: int, seed: str) -> list[int]:
    """A uniformly random order of ``range(n)``, the same for the same seed."""
    rng = random.Random(seed)
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = rng.randrange(i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def scattered(docs: DataFrame, text_col: str, bucket_bytes: int, seed: int) -> DataFrame:
    """``row`` (all columns), ``key``, ``bucket`` and ``part`` (0 but in overfull buckets)."""
    total = docs.agg(F.sum(text_size(F.col(f"`{text_col}`")))).first()[0] or 0
    n_buckets = total // bucket_bytes + 1
    fields = [F.col(f"`{f.name}`") for f in docs.schema if hashable(f.dataType)]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(F.lit(seed), *fields).alias("key"),
        text_size(F.col(f"`{text_col}`")).alias("bytes"),
        F.monotonically_increasing_id().alias("at"),
    ).withColumn("bucket", F.pmod("key", F.lit(n_buckets).cast("long")))
    held = rows.groupBy("bucket").agg(F.sum("bytes").alias("held"))
    over = held.where(F.col("held") > OVERFULL * bucket_bytes)
    over = materialize(over.select("bucket", F.ceil(F.col("held") / bucket_bytes).alias("parts")), "shard-overfull")
    if over.isEmpty():
        return rows.select("row", "key", "bucket", F.lit(0).cast("long").alias("part"))
    dealt = rows.join(bounded_broadcast(over), "bucket", "left")
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(seed), "at"), F.col("parts")), F.lit(0)).cast("long")
    return dealt.select("row", "key", "bucket", part.alias("part"))


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """``row, bucket, part, pos``: each bucket in its shuffled order."""
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in ("bucket", "part", "pos"))])

    def permuted(held: list[pa.RecordBatch], bucket: int, part: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        order = fisher_yates(whole.num_rows, f"{seed}/{bucket}/{part}")
        for at in range(0, len(order), BATCH_ROWS):
            some = order[at : at + BATCH_ROWS]
            taken = whole.column("row").take(pa.array(some, pa.int64())).combine_chunks()
            columns = [taken if isinstance(taken, pa.Array) else taken.chunk(0)]
            columns += [pa.array([v] * len(some), pa.int64()) for v in (bucket, part)]
            columns.append(pa.array(range(at, at + len(some)), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            owners = list(zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist()))
            at = 0
            while at < len(owners):
                end = at + 1
                while end < len(owners) and owners[end] == owners[at]:
                    end += 1
                if owners[at] != now and held:
                    yield from permuted(held, *now)
                    held = []
                now = owners[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from permuted(held, *now)

    sorted_rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "key")
    return sorted_rows.select("row", "bucket", "part").mapInArrow(run, schema)


def shuffle_shards(
    docs: DataFrame,
    n_shards: int = 16,
    text_col: str = "text",
    bucket_bytes: int = 128 << 20,
    seed: int = 13,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (int) and ``slot`` (long, gapless
    from 0 in each shard) in a uniformly random global order that the seed decides.

    Counts of shards are at most one apart; with fewer rows than shards the last
    shards are empty. Nulls and empty texts are rows like others; equal rows are
    interchangeable, rows that are equal in all but map or variant columns may
    change places between runs. Columns named like the two results are replaced.
    Reruns over the same rows agree, however many tasks there are, but for buckets
    that one repeated row fills: there they agree over the same files. An empty
    table gives no rows."""
    if n_shards < 1 or bucket_bytes < 1:
        raise ValueError("n_shards and bucket_bytes must be at least 1")
    written = materialize(shuffled(scattered(docs, text_col, bucket_bytes, seed), seed), "shard-buckets")
    counts = materialize(written.groupBy("bucket", "part").agg(F.count("*").alias("n")), "shard-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # one narrow row a bucket
    before = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = written.join(bounded_broadcast(starts), ["bucket", "part"])
    place = F.col("start") + F.col("pos")
    size, longer = divmod(total, n_shards)
    edge = longer * (size + 1)
    late = place - F.lit(edge)
    in_long = place < edge

    def div(a: Column, b: int) -> Column:
        return F.floor(a / F.lit(b)) if total < 1 << 52 else (a - F.pmod(a, F.lit(b))) / F.lit(b)

    shard = F.when(in_long, div(place, size + 1)).otherwise(F.lit(longer) + div(late, max(size, 1)))
    slot = F.when(in_long, F.pmod(place, F.lit(size + 1))).otherwise(F.pmod(late, F.lit(max(size, 1))))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in (shard_col, slot_col)]
    return placed.select(*kept, shard.cast("int").alias(shard_col), slot.cast("long").alias(slot_col))


def write_shards(docs: DataFrame, path: str | None = None, **options) -> str:
    """Writes ``shuffle_shards`` as one Parquet folder a shard, rows of a file in the
    order of their slots, and returns the path (by default a new folder below the
    checkpoint folder)."""
    path = path or scratch_path(docs.sparkSession, "shards")
    shard, slot = options.get("shard_col", "shard"), options.get("slot_col", "slot")
    out = shuffle_shards(docs, **options).sortWithinPartitions(shard, slot)
    out.write.partitionBy(shard).parquet(path)
    return path
