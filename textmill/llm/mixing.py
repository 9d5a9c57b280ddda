"""Mixing sources to target weights with a low-discrepancy schedule.

Slot ``i`` of the schedule has the golden-ratio point ``frac(i * 0.618...)``
(in 32-bit fixed point, so it is exact). Cumulative target shares cut [0, 1)
into one interval per source; the interval that holds the point names the
slot's source, and slots are ranked within their source. The documents of a
source, in shuffled order and repeated as often as its target needs, are cut
into as many blocks of equal words as the source has slots; slot ``k`` of a
source takes its block ``k``. Any stretch of the schedule is then close to the
target shares, and a source takes exactly its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import WORD_PATTERN, hashable, materialize

#: 2**32 divided by the golden ratio, and 2**32.
GOLDEN, UNIT = 2654435769, 4294967296
#: Hash cells per source for the running word counts; a cell is one window.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2)) -> DataFrame:
    """``(source, source_size, weight, target)`` for each source.

    Sources by code point (null last) take the weights in turn and split
    ``share`` = 3/2 of all words by them; no target passes twice the source's
    words, and what is above goes to the others by weight until none is above.
    That limit is a water level: sources sorted by words per weight fill up
    first, the rest share what is left. Input to the windows is one row per
    source, after aggregation."""
    num, den = share
    w = F.array(*[F.lit(x).cast("long") for x in weights])
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(onward))
        .withColumn("pos", F.row_number().over(fill))
        # level = (num * total - 2 * den * full) / (den * open), kept as a fraction
        .withColumn("a", num * F.col("total") - 2 * den * F.col("full"))
        .withColumn("b", den * F.col("open"))
        .withColumn("capped", 2 * F.col("source_size") * F.col("b") <= F.col("weight") * F.col("a"))
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct("pos", "a", "b"))).over(every))
    )
    target = F.when(F.col("capped"), (2 * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("level.a")).cast("double") / F.col("level.b").cast("double")
    )
    return per.select("source", "source_size", "weight", "rank", target.alias("target"))


def schedule(spark, targets: DataFrame, block_words: int) -> DataFrame:
    """``(slot, rank, k, n_slots, words)``: slot order, the source's rank, the
    slot's rank within the source, the source's slots and its words to take.

    A source whose interval no point meets gets one slot at the end."""
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    n = max(1024, int(total // block_words) + 1) if total else 0
    bits = 10
    words = targets.select("rank", F.floor("target").cast("long").alias("words")).where("words > 0")
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cum = words.withColumn("hi_w", F.sum("words").over(upto)).withColumn("all_w", F.sum("words").over(Window.partitionBy(F.lit(0))))
    cut = cum.withColumn("lo", F.floor((F.col("hi_w") - F.col("words")) / F.col("all_w") * UNIT).cast("long"))
    cut = cut.withColumn("hi", F.floor(F.col("hi_w") / F.col("all_w") * UNIT).cast("long")).where("hi > lo")
    cells = cut.select("rank", "lo", "hi", F.explode(F.expr(f"sequence(lo >> {32 - bits}, (hi - 1) >> {32 - bits})")).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") * GOLDEN) % UNIT).alias("u"))
    points = points.withColumn("cell", F.shiftright("u", 32 - bits))
    hit = points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "rank")
    extra = words.join(hit.select("rank").distinct(), "rank", "left_anti").select((F.col("rank") + n).cast("long").alias("slot"), "rank")
    slots = materialize(hit.unionByName(extra), "mix-slots")
    # rank within the source by slot: slots are dense, so a window over pieces
    # of the slot range and a running count over pieces, never one task a source
    piece = F.floor(F.col("slot") / 65536)
    slots = slots.withColumn("piece", piece)
    counts = slots.groupBy("rank", "piece").agg(F.count("*").alias("c"))
    counts = counts.withColumn("base", F.sum("c").over(Window.partitionBy("rank").orderBy("piece")) - F.col("c"))
    counts = counts.withColumn("n_slots", F.sum("c").over(Window.partitionBy("rank")))
    in_piece = Window.partitionBy("rank", "piece").orderBy("slot")
    ranked = slots.withColumn("k0", F.row_number().over(in_piece) - 1).join(counts, ["rank", "piece"])
    return ranked.join(words, "rank").select("slot", "rank", (F.col("base") + F.col("k0")).alias("k"), "n_slots", "words")


def row_hash(docs: DataFrame) -> Column:
    """128 bits of all columns of a row."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema if hashable(f.dataType)]
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("row"), *cols).alias("b"))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = 65_536,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """``(placed, pieces)``.

    ``placed``: one row per input row: ``id, source, size, start`` (its first
    word among the source's shuffled words), the source's size and target.
    ``pieces``: which words go to which slot: ``slot, rank, id, start, pass,
    skip, words`` (``skip`` words of the document come before the piece; pass 1
    is the repetition). Null or wordless texts have size 0 and give no pieces;
    null is a source of its own; rows with equal ids are placed one by one;
    equal rows share their result in any order. Reruns agree: the order is the
    MD5 of seed and id (of seed and text for a null id), then id, size and a hash
    of the row, ``h``, which ``placed`` holds too."""
    spark = docs.sparkSession
    ident = F.col(f"`{id_col}`")
    named = F.coalesce(ident.cast("string"), F.col(f"`{text_col}`"), F.lit(""))
    order = F.md5(F.concat(F.lit(seed + ":"), named).cast("binary"))
    rows = docs.select(
        row_hash(docs).alias("h"),
        ident.alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        order.alias("key"),
    )
    rows = materialize(rows.withColumn("cell", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")), "mix-sizes")
    targets = materialize(source_targets(rows), "mix-targets")
    # start of each row among its source's words: cell sums, then a window per cell
    per_cell = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_words"))
    per_cell = per_cell.withColumn(
        "base", F.sum("cell_words").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_words")
    ).withColumnsRenamed({"source": "c_source", "cell": "c_cell"})
    inside = Window.partitionBy("source", "cell").orderBy("key", "id", "size", "h").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("upto", F.sum("size").over(inside))
    run = run.join(per_cell, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell")))
    run = run.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).select("h", "id", "source", "size", "start")
    t = targets.withColumnRenamed("source", "t_source")
    placed = materialize(
        run.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
            "h", "id", "source", "size", "start", "source_size", "rank", "target"
        ),
        "mix-placed",
    )
    slots = materialize(schedule(spark, targets, block_words), "mix-schedule")
    blocks = slots.select("rank", "n_slots", "words").distinct()  # one row a source
    # words of pass p stand at [start + p * source_size, + size) of the repeated source
    spans = (
        placed.where("size > 0")
        .join(blocks, "rank")
        .withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("lo", F.col("start") + F.col("pass") * F.col("source_size"))
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words")))
        .where("hi > lo")
        # block k holds the words from floor(k * words / n_slots)
        .withColumn("k", F.explode(F.expr("sequence((lo * n_slots) div words, least(n_slots - 1, ((hi - 1) * n_slots) div words + 1))")))
        .withColumn("b_lo", F.expr("(k * words) div n_slots"))
        .withColumn("b_hi", F.expr("((k + 1) * words) div n_slots"))
        .withColumn("p_lo", F.greatest("lo", "b_lo"))
        .withColumn("p_hi", F.least("hi", "b_hi"))
        .where("p_hi > p_lo")
    )
    pieces = spans.join(slots.select("rank", "k", "slot"), ["rank", "k"]).select(
        "slot",
        "rank",
        "id",
        "start",
        "pass",
        (F.col("p_lo") - F.col("lo")).alias("skip"),
        (F.col("p_hi") - F.col("p_lo")).alias("words"),
    )
    return placed, pieces


def mix_totals(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per input row: ``id, size, source_size, target, taken``: the
    words of the row that the schedule's slots take, repeats counted."""
    placed, pieces = mix_plan(docs, id_col, **how)
    taken = pieces.groupBy("rank", "start", "id").agg(F.sum("words").alias("taken"))
    taken = taken.withColumnsRenamed({"rank": "t_rank", "start": "t_start", "id": "t_id"})
    match = (
        (F.col("rank") == F.col("t_rank"))
        & (F.col("start") == F.col("t_start"))
        & F.col("id").eqNullSafe(F.col("t_id"))
        & (F.col("size") > 0)
    )
    out = placed.join(taken, match, "left")
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: one row for each pass in
    which a document is taken. Where a target ends inside a document, its last
    row holds the first words only, as many as are taken.

    The plan names rows by a hash of all their columns, so null and repeated ids are
    rows like others: the mixture has exactly the plan's words. Rows that repeat in
    every column are one row that is planned several times (map and variant columns
    are not compared; such a row may stand in for its like). Null and wordless
    texts are in no mixture. Columns may have any names. An empty table gives no
    rows."""
    placed, pieces = mix_plan(docs, id_col, text_col, source_col, **how)
    got = pieces.groupBy("rank", "start", "pass").agg(F.sum("words").alias("words"))
    full = placed.where("size > 0").select("h", "rank", "start", "size")
    got = got.join(full, ["rank", "start"]).select("h", "words", "size")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash(docs).alias("h"))
    # rows written several times meet their plans once
    again = materialize(full.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "mix-again")
    if not again.isEmpty():
        once = rows.join(again, "h", "left_semi").dropDuplicates(["h"])
        rows = rows.join(again, "h", "left_anti").unionByName(once)
    out = rows.join(got, "h")
    body = F.col("row")[text_col]
    head = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(f"({WORD_PATTERN})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") >= F.col("size"), body).otherwise(head)
    return out.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
