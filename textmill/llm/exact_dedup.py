"""Exact duplicates through an extendible-hash index kept in shared files.

1. Every row becomes a narrow key: 64-bit hash, SHA-256, id. Keys are counted by
   hash with map-side partial sums, so a text that fills a third of the rows is one
   entry per map task when it is shuffled. The result is one slot per distinct hash.
2. The directory starts with one bucket per leading bit string of length 0 and
   doubles: a bucket with more than ``capacity`` slots splits on its next bit.
   All depths are found at once from the counts of the deepest cells.
3. The directory sends each row to the owner of its bucket. On the way equal texts of
   a bucket are combined map-side, so a hot chain reaches its owner as one entry a
   map task; the owner groups a chain by the text itself, which compares bytes, and
   keeps the classes of several rows.
4. Classes are the index: files range-partitioned by (bucket, hash). Keys look up
   their class there by bucket, hash and digest; keys of the hottest classes do so
   from a broadcast list, bounded by ``HOT_SHARE``, so no lookup meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialize

#: Deepest directory: 2**16 cells, so the directory never has more rows than that.
MAX_DEPTH = 16
#: A text with more than 1/HOT_SHARE of the rows is joined by broadcast; fewer
#: than HOT_SHARE texts can be that frequent.
HOT_SHARE = 1000


def build_directory(slots: DataFrame, capacity: int, n_slots: int) -> DataFrame:
    """``(cell, depth, bucket)``: the directory after doubling.

    ``cell`` are the ``MAX_DEPTH`` leading bits of the hash at most. A cell's
    bucket is its shortest prefix that holds at most ``capacity`` slots, or the
    whole cell. At most ``2**MAX_DEPTH`` rows, whatever the input."""
    depth = min(MAX_DEPTH, max(1, math.ceil(math.log2(max(1, n_slots) / capacity + 1)) + 3))
    cells = slots.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - depth)"))
    held = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = levels.join(held, ["depth", "prefix"]).where((F.col("held") <= capacity) | (F.col("depth") == depth))
    return fits.groupBy("cell").agg(F.min(F.struct("depth", "prefix")).alias("b")).select(
        "cell",
        F.col("b.depth").alias("depth"),
        # leading 1 keeps prefixes of different length apart
        F.expr("shiftleft(1L, b.depth) + b.prefix").alias("bucket"),
    ), depth


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 12
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Equal texts (a null text counts as empty) form a group; the largest id
    stays. Rows that repeat both id and text are one document written twice:
    each of them carries the group's result, ``group_size`` counts them all. A
    null id never wins against another one; a group of null ids only keeps
    null. Other columns of ``docs`` are not read. An empty table gives no rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    hashed = rows.select("id", "text", F.xxhash64("text").alias("h"))
    keys = materialize(hashed.select("id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "dedup-keys")
    slots = materialize(keys.groupBy("h").agg(F.count("*").alias("n_rows")), "dedup-slots")
    n_slots = slots.count()
    directory, depth = build_directory(slots, capacity, n_slots)
    directory = materialize(directory, "dedup-directory")  # at most 2**MAX_DEPTH rows

    def placed(df: DataFrame) -> DataFrame:
        """``df`` with the bucket that the directory names for its hash."""
        cell = F.shiftrightunsigned(df["h"], 64 - depth)
        return df.join(F.broadcast(directory.select("cell", "bucket")), cell == F.col("cell")).drop("cell")

    chains = placed(hashed).groupBy("bucket", "h", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    chains = chains.where("group_size > 1").select(
        "bucket", "h", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "keep_id", "group_size")
    owners = max(1, min(n_slots // capacity + 1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    classes = materialize(chains.repartitionByRange(owners, "bucket", "h"), "dedup-index")
    n_rows = keys.count()
    hot_size = max(2, n_rows // HOT_SHARE + 1)
    hot = F.broadcast(classes.where(F.col("group_size") >= hot_size))  # fewer than HOT_SHARE rows
    cold = classes.where(F.col("group_size") < hot_size)
    out_cols = ["id", "sha", "keep_id", "group_size"]
    at = ["bucket", "h", "sha"]
    keys = placed(keys)
    by_hot = keys.join(hot, at).select(*out_cols)
    rest = keys.join(hot, at, "left_anti").join(cold, at, "left")
    rest = rest.select(
        "id",
        "sha",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )
    out = by_hot.unionByName(rest)
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each distinct text, with all its columns: that of
    the largest id; of rows that repeat id and text, any one. Rows whose ids are
    null stay if no other row has their text, and one of them does."""
    groups = materialize(exact_groups(docs, id_col, text_col), "dedup-groups")
    ident = F.col(f"`{id_col}`")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    drop = groups.where("not kept").select(ident.alias("d_id"), F.col("text_sha256").alias("d_sha"))
    again = groups.where("kept").groupBy(ident.alias("d_id"), F.col("text_sha256").alias("d_sha")).count().where("count > 1")
    again = materialize(again.select("d_id", "d_sha"), "dedup-again")
    # columns of the input are fields of one struct: no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("id"), F.sha2(text.cast("binary"), 256).alias("sha"))
    same = lambda other: F.col("id").eqNullSafe(other["d_id"]) & (F.col("sha") == other["d_sha"])
    rest = rows.join(drop, same(drop), "left_anti")
    if not again.isEmpty():
        repeated = rest.join(again, same(again), "left_semi").dropDuplicates(["id", "sha"])
        rest = rest.join(again, same(again), "left_anti").unionByName(repeated)
    return rest.select(*[F.col("row")[c].alias(c) for c in docs.columns])
