"""Maximal repeated runs of lines over a corpus.

Windows of ``k`` lines are the nodes of a graph, an edge leads from each window to
the one that starts a line later. Two neighbours belong to one run when neither
ever occurs without the other: then the ``k + 1`` lines that both cover occur as
often as each of them. Runs of such neighbours are maximal: at both ends the lines
that come next differ between the places, or the places themselves do. A function
of 200 lines that was copied once is one row, not 199 windows; where ten of its
lines have a third copy, these ten are a run of their own, with all three places.

Three partial aggregations by window hash and two passes of running values by
pieces of a file decide it, whatever the length of the runs: the number of shuffles
does not grow with them, and nothing is ordered over a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import ordered_scan

BLOCK_BUCKET = 1024


def line_windows(lines: DataFrame, k: int, bucket: int = BLOCK_BUCKET) -> DataFrame:
    """``path, line_no, hash, longer``: SHA-256 of the ``k`` lines that start at each
    line, joined by '\\n', and of the ``k + 1`` lines (null where lines are
    missing). The first ``k`` lines of a bucket of lines are copied to the bucket
    before, so that each window lies in one group of bounded size."""
    bucket = max(bucket, k + 1)
    b = F.floor((F.col("line_no") - 1) / F.lit(bucket)).cast("long")
    head = ((F.col("line_no") - 1) % bucket < k) & (b > 0)
    own = F.struct(b.alias("b"), F.lit(True).alias("own"))
    copy = F.when(head, F.struct((b - 1).alias("b"), F.lit(False).alias("own")))
    dealt = lines.select("path", "line_no", "line", F.explode(F.array_compact(F.array(own, copy))).alias("t"))
    w = Window.partitionBy("path", "t.b").orderBy("line_no")
    spans = dealt.select(
        "path", "line_no", F.col("t.own").alias("own"),
        F.collect_list("line").over(w.rowsBetween(0, k)).alias("text"),
        *[F.lead("line_no", n).over(w).alias(f"at_{n}") for n in sorted({k - 1, k}) if n],
    ).where("own")

    def digest(n: int) -> F.Column:
        last = F.col(f"at_{n - 1}") if n > 1 else F.col("line_no")
        whole = last - F.col("line_no") == n - 1
        return F.when(whole, F.sha2(F.array_join(F.slice("text", 1, n), "\n"), 256))

    return spans.select("path", "line_no", digest(k).alias("hash"), digest(k + 1).alias("longer")).where("hash is not null")


def run_places(lines: DataFrame, k: int = 2, bucket: int = BLOCK_BUCKET) -> DataFrame:
    """Every place of every maximal repeated run of at least ``k`` lines: ``path,
    first_line, n_lines, block_hash, n``. ``block_hash`` is that of the run's first
    ``k`` lines, which names the run; ``n`` is its number of places, overlapping
    ones included. Lines must have numbers; a missing number ends a run. A null
    line ends one too, a null path is a file of its own. Empty input gives no rows."""
    if k < 1:
        raise ValueError("k must be >= 1")
    named = lines.where("line is not null").withColumn("path", F.struct("path")).withColumn("line_no", F.col("line_no").cast("long"))
    at = line_windows(named, k, bucket)
    often = at.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    both = at.where("longer is not null").groupBy("longer").agg(F.count("*").alias("n_longer")).where("n_longer > 1")
    at = at.join(often, "hash").join(both, "longer", "left")
    # does the next line's window belong to the same run?
    at = ordered_scan(at.select("path", "line_no", "hash", "n", "n_longer"), "path", "line_no", ["line_no"], next_col="n")
    linked = F.coalesce((F.col("n_longer") == F.col("n")) & (F.col("_next") == F.col("n")), F.lit(False))
    at = at.select("path", "line_no", "hash", "n", F.when(linked, 0).otherwise(1).alias("ends"))
    at = ordered_scan(at, "path", "line_no", ["line_no"], sum_col="ends")
    runs = at.groupBy("path", F.col("_sum_before").alias("run")).agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("windows"),
        F.min_by("hash", "line_no").alias("block_hash"), F.first("n").alias("n"))
    return runs.select("path.path", "first_line", (F.col("windows") + k - 1).alias("n_lines"), "block_hash", "n")


def repeated_runs(lines: DataFrame, k: int = 2, bucket: int = BLOCK_BUCKET) -> DataFrame:
    """The maximal repeated runs, one row each: ``block_hash, n_lines, n, first_path,
    first_line``."""
    return run_places(lines, k, bucket).groupBy("block_hash").agg(
        F.max("n_lines").alias("n_lines"), F.max("n").alias("n"),
        F.min(F.struct("path", "first_line")).alias("first"),
    ).select("block_hash", "n_lines", "n", F.col("first.path").alias("first_path"), F.col("first.first_line").alias("first_line"))
