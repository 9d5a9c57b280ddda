"""A line delta between two versions of files, by patience anchors.

All changed files are compared at once, by number and hash of their lines:

1. Trim: equal lines at the beginning and at the end of a gap are kept. (The whole
   file is the first gap.) The first offset at which the sides differ is a minimum
   over offsets, so nothing is read in order.
2. Anchor: lines that occur once on either side of their gap are candidates. Those
   that no other candidate crosses (a running maximum before, a running minimum
   behind) are in every longest increasing subsequence; only stretches of crossing
   ones, which lines moved about leave, go through patience piles, a stretch a group.
3. Cut: anchors cut their gap into smaller ones, and it starts again, until no gap
   has an anchor. What is left is removed and added.

Rounds are written to the checkpoint folder; each holds only the lines of gaps that
still have lines on both sides. Running values go by pieces of a file, so a long
file spreads over many tasks. Rounds know lines by their hashes only; the texts meet
the numbers of kept and added lines once, at the end, by file.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranges import ordered_scan

#: A line with its end, the last one maybe without.
LINE = r"[^\n]*\n|[^\n]+"
TAGS = {"kept": "  ", "removed": "- ", "added": "+ "}


def _lines(text: F.Column) -> F.Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def numbered(v: DataFrame, keys: list[str], side: str) -> DataFrame:
    """``f, p, line`` of one side: the file's keys, line number from 1, line with its end."""
    x = v.where(F.col(side).isNotNull()).select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("f"), F.posexplode(_lines(F.col(side))).alias("p", "line"))
    return x.select("f", (F.col("p") + 1).cast("long").alias("p"), "line")


def piles(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of a longest run that increases in both ``i`` and ``j``."""
    group = group.sort_values("i")
    js = group["j"].tolist()
    tops, at, back = [], [], []  # smallest top of each pile, its row, the row before in the run
    for n, j in enumerate(js):
        k = bisect_left(tops, j)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            at.append(n)
        else:
            tops[k], at[k] = j, n
    keep, n = [], at[-1] if at else -1
    while n >= 0:
        keep.append(n)
        n = back[n]
    return group.iloc[keep[::-1]][["gap", "i", "j"]]


def increasing(pairs: DataFrame) -> DataFrame:
    """Of ``pairs(gap, i, j)`` a longest subset of each gap in which i and j increase together."""
    d = ordered_scan(pairs, "gap", "i", ["i"], max_col="j").withColumnRenamed("_prev_max", "top")
    d = d.select("gap", "i", "j", "top", (-F.col("i")).alias("r"), (-F.col("j")).alias("s"))
    d = ordered_scan(d, "gap", "r", ["r"], max_col="s").select("gap", "i", "j", "top", (-F.col("_prev_max")).alias("low"))
    free = F.coalesce(F.col("top") < F.col("j"), F.lit(True)) & F.coalesce(F.col("low") > F.col("j"), F.lit(True))
    d = materialize(d.select("gap", "i", "j", free.alias("free")), "delta-pairs")
    rest = d.where("not free")
    if rest.isEmpty():
        return d.select("gap", "i", "j")
    d = d.withColumn("mark", F.when(F.col("free"), F.col("i")))
    rest = ordered_scan(d, "gap", "i", ["i"], max_col="mark").where("not free").select("gap", F.coalesce("_prev_max", F.lit(-1)).alias("part"), "i", "j")
    schema = d.select("gap", "i", "j").schema
    return d.where("free").select("gap", "i", "j").unionByName(rest.groupBy("gap", "part").applyInPandas(piles, schema))


def matches(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pairs, places)`` of two sides ``f, p, line``: ``pairs(f, i, j)`` of kept lines
    by their numbers, and ``places(f, p, after)``: for each added line the number of
    the old line it comes behind."""
    ident = F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit("delta"), F.col("line")).alias("b"))
    rows = old.select("f", F.lit(0).alias("side"), "p", ident.alias("h")).unionByName(new.select("f", F.lit(1).alias("side"), "p", ident.alias("h")))
    rows = rows.select(F.struct("f", F.lit(0).cast("long").alias("g")).alias("gap"), "side", "p", "h")
    pairs, places = [], []
    mine = F.col("side") == 0
    while True:
        rows = rows.repartition("gap")  # sizes, ends and trimming all read this one shuffle
        # sizes of the gaps; an old line's offset follows from the gap's name, the line kept before it
        gaps = rows.groupBy("gap").agg(
            F.sum(F.when(mine, 1).otherwise(0)).alias("n_old"), F.sum(F.when(mine, 0).otherwise(1)).alias("n_new"),
            F.min(F.when(~mine, F.col("p"))).alias("start"))
        r = rows.join(gaps, "gap")
        t = F.when(mine, F.col("p") - 1 - F.col("gap.g")).otherwise(F.col("p") - F.col("start"))
        r = r.withColumn("t", t).withColumn("e", F.when(mine, F.col("n_old")).otherwise(F.col("n_new")) - 1 - F.col("t"))
        both = r.where("n_old > 0 and n_new > 0").withColumn("short", F.least("n_old", "n_new"))
        ends = both.select("gap", "h", "short", F.explode(F.array(
            F.struct(F.lit("t").alias("way"), F.col("t").alias("off")), F.struct(F.lit("e").alias("way"), F.col("e").alias("off")))).alias("x"))
        ends = ends.where("x.off < short").groupBy("gap", "short", "x.way", "x.off").agg((F.min("h") == F.max("h")).alias("same"))
        first = lambda way: F.coalesce(F.min(F.when(~F.col("same") & (F.col("way") == way), F.col("off"))), F.first("short"))
        ends = ends.groupBy("gap").agg(first("t").alias("head"), first("e").alias("tail0"), F.first("short").alias("s0"))
        ends = ends.select("gap", "head", F.least(F.col("tail0"), F.col("s0") - F.col("head")).alias("tail"))
        # what a line is now, and a number: of a pair the new line, else the old line before the place
        r = r.join(ends, "gap", "left").withColumns({"head": F.coalesce("head", F.lit(0)), "tail": F.coalesce("tail", F.lit(0))})
        at_head, at_tail = F.col("t") < F.col("head"), F.col("e") < F.col("tail")
        m_old, m_new = (F.col(c) - F.col("head") - F.col("tail") for c in ("n_old", "n_new"))
        what = (F.when(at_head | at_tail, F.when(mine, F.lit("pair")))
                .when((m_old > 0) & (m_new > 0), F.lit("left")).when(~mine & (m_old == 0), F.lit("place")))
        j = F.when(at_head, F.col("start") + F.col("t")).otherwise(F.col("start") + F.col("n_new") - 1 - F.col("e"))
        g = F.col("gap.g") + F.col("head")
        r = r.withColumn("what", what).where("what is not null").select(
            "what", F.when(F.col("what") == "left", g).alias("g"), F.col("gap.f").alias("f"), "side", "p",
            F.when(F.col("what") == "left", F.col("h")).alias("h"), F.when(F.col("what") == "pair", j).otherwise(g + m_old).alias("to"))
        r = materialize(r, "delta-trimmed")
        pairs.append(r.where("what = 'pair'").select("f", F.col("p").alias("i"), F.col("to").alias("j")))
        places.append(r.where("what = 'place'").select("f", "p", F.col("to").alias("after")))
        left = r.where("what = 'left'").select(F.struct("f", "g").alias("gap"), "side", "p", "h", F.col("to").alias("after"))
        once = left.groupBy("gap", "h").agg(
            F.sum(F.when(mine, 1).otherwise(0)).alias("a"), F.sum(F.when(mine, 0).otherwise(1)).alias("b"),
            F.min(F.when(mine, F.col("p"))).alias("i"), F.min(F.when(~mine, F.col("p"))).alias("j"))
        anchors = materialize(increasing(once.where("a = 1 and b = 1").select("gap", "i", "j")), "delta-anchors")
        if anchors.isEmpty():
            places.append(left.where("side = 1").select("gap.f", "p", "after"))
            break
        pairs.append(anchors.select("gap.f", "i", "j"))
        sides = anchors.select("gap", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("i").alias("p"), F.col("i").alias("mark")),
            F.struct(F.lit(1).alias("side"), F.col("j").alias("p"), F.col("i").alias("mark")))).alias("x")).select("gap", "x.*")
        cut = left.join(anchors.select("gap").distinct().withColumn("cut", F.lit(True)), "gap", "left")
        places.append(cut.where("side = 1 and cut is null").select("gap.f", "p", "after"))
        cut = cut.where("cut").select("gap", "side", "p", "h").join(sides, ["gap", "side", "p"], "left")
        cut = cut.select(F.struct("gap", "side").alias("group"), "gap", "side", "p", "h", "mark")
        cut = ordered_scan(cut, "group", "p", ["p"], max_col="mark").where("mark is null")
        rows = cut.select(F.struct("gap.f", F.coalesce("_prev_max", "gap.g").alias("g")).alias("gap"), "side", "p", "h")
    return _union(pairs), _union(places)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def line_delta(v: DataFrame, keys=("path",)) -> DataFrame:
    """Tagged delta ``keys, seq, line`` of versions ``keys, old, new``: '  ' kept, '- '
    removed, '+ ' added, before each line with its end; ``seq`` (old line, new line)
    orders a file, removed lines before the added ones of the same gap.

    ``restore_side`` gives both texts back exactly. A side that is null or empty has
    no lines; equal sides keep all of them. Keys may be null but not repeat. Lines end
    at '\\n' only. Empty input gives no rows. ``v`` is read once; the rows come dealt by
    the keys."""
    keys = list(keys)
    equal = F.coalesce(F.col("old") == F.col("new"), F.lit(False))
    f = F.struct(*[F.col(f"`{k}`") for k in keys]).alias("f")
    v = materialize(v.select(f, "old", F.when(~equal, F.col("new")).alias("new"), equal.alias("equal")), "delta-versions")
    changed = v.where("not equal").select("f.*", "old", "new")
    pairs, places = matches(*(numbered(changed, keys, side) for side in ("old", "new")))
    # each file meets the numbers of its lines; the rows come out dealt by the keys
    d = v.select("f.*", F.struct("old", "new", "equal").alias("_v"))
    d = d.unionByName(pairs.select("f.*", F.col("i").alias("_i")), allowMissingColumns=True)
    d = d.unionByName(places.select("f.*", F.struct("p", "after").alias("_a")), allowMissingColumns=True)
    ks = [f"`{k}`" for k in keys]
    d = d.groupBy(*ks).agg(*[F.collect_list(c).alias(c) for c in ("_v", "_i", "_a")])
    texts = F.transform("_v", lambda x: F.struct(*[F.coalesce(_lines(x[c]), F.array().cast("array<string>")).alias(c) for c in ("old", "new")], x["equal"].alias("equal")))
    d = d.select(*ks, "_i", "_a", F.explode(texts).alias("_v"))
    n_old, n_new = (F.size(F.col(f"_v.{c}")).cast("long") for c in ("old", "new"))
    every = F.when(n_old > 0, F.sequence(F.lit(1).cast("long"), n_old)).otherwise(F.array().cast("array<bigint>"))
    kept = F.when(F.col("_v.equal"), every).otherwise(F.filter("_i", lambda i: i <= n_old))
    zero = F.lit(0).cast("long")

    def row(side, tag, i, j):
        at = (i if side == "old" else j).cast("int") - 1
        return F.struct(F.struct(i.alias("old"), j.alias("new")).alias("seq"), F.concat(F.lit(TAGS[tag]), F.get(F.col(f"_v.{side}"), at)).alias("line"))

    out = F.concat(
        F.transform(kept, lambda i: row("old", "kept", i, zero)),
        F.transform(F.array_except(every, kept), lambda i: row("old", "removed", i, zero)),
        F.transform(F.filter("_a", lambda a: a["p"] <= n_new), lambda a: row("new", "added", a["after"], a["p"])))
    return d.select(*ks, F.explode(out).alias("_r")).select(*ks, "_r.seq", "_r.line")
