"""Two versions of a corpus: changed rows, per-file status and line deltas,
unified diffs, and restoring one side of a tagged delta."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.text import split_lines_array


def versions(old: DataFrame, new: DataFrame, keys=("path",), text: str = "text") -> DataFrame:
    """Full outer join of two versions on ``keys``: ``keys, old, new``."""
    o = old.select(*keys, F.col(text).alias("old"))
    n = new.select(*keys, F.col(text).alias("new"))
    return o.join(n, list(keys), "full_outer")


def changed_only(v: DataFrame) -> DataFrame:
    """Rows whose two sides differ (NULL-safe); compared before any diff."""
    return v.filter(~F.col("old").eqNullSafe(F.col("new")))


def status_col() -> F.Column:
    return (
        F.when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("new").isNull(), F.lit("removed"))
        .when(F.col("old") == F.col("new"), F.lit("same"))
        .otherwise(F.lit("modified"))
    )


def snapshot_diff(v: DataFrame, keys=("path",)) -> DataFrame:
    """Per file: ``status`` (added / removed / modified / same) and lines
    added and removed, counted as multisets of lines.

    Equal files are settled without reading their lines. For the others each
    line becomes a ``(key, line, +1/-1)`` row; the sum per ``(key, line)`` is
    pre-aggregated map-side, so repeated lines and large files spread over
    the shuffle by line text."""
    keys = list(keys)
    st = v.select(*keys, status_col().alias("status"), "old", "new")
    empty = F.array().cast("array<string>")
    changed = F.col("status") != "same"

    def signed(col, sign):
        lines = F.when(changed, F.coalesce(split_lines_array(col), empty)).otherwise(empty)
        return F.transform(lines, lambda s: F.struct(s.alias("line"), F.lit(sign).alias("sign")))

    # One sentinel per file keeps every file (and its status) through the
    # aggregation, so no join back to the file list is needed.
    sentinel = F.array(F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("sign")))
    rows = st.select(*keys, "status", F.explode(F.concat(sentinel, signed("old", -1), signed("new", 1))).alias("x"))
    per_line = rows.groupBy(*keys, "status", F.col("x.line").alias("line")).agg(F.sum("x.sign").alias("d"))
    return per_line.groupBy(*keys, "status").agg(
        F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0)).cast("long").alias("lines_added"),
        F.sum(F.when(F.col("d") < 0, -F.col("d")).otherwise(0)).cast("long").alias("lines_removed"),
    )


# The tags of a line delta and the side each belongs to.
DELTA_TAGS = {1: ["  ", "- "], 2: ["  ", "+ "]}


def restore_side(delta: DataFrame, side: int, keys=("path",)) -> DataFrame:
    """From a tagged delta ``(keys, seq, line)`` keep one side: unchanged lines
    ("  ") and removed ("- ", side 1) or added ("+ ", side 2), tag dropped,
    joined in ``seq`` order into ``text`` (one row per file)."""
    if side not in DELTA_TAGS:
        raise ValueError("side must be 1 or 2")
    keys = list(keys)
    tags = F.array(*[F.lit(t) for t in DELTA_TAGS[side]])
    kept = delta.filter(F.array_contains(tags, F.substring("line", 1, 2))).select(
        *keys, "seq", F.substring("line", 3, 1 << 30).alias("line")
    )
    parts = F.array_sort(F.collect_list(F.struct(F.col("seq").alias("n"), F.col("line").alias("t"))))
    return kept.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"),
        F.count("*").cast("long").alias("n_lines"),
    )


@pandas_udf(StringType())
def _unified(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    out = []
    for p, a, b in zip(path, old, new):
        a = "" if a is None else a
        b = "" if b is None else b
        out.append("".join(difflib.unified_diff(
            a.splitlines(keepends=True), b.splitlines(keepends=True), fromfile=str(p), tofile=str(p))))
    return pd.Series(out, dtype=object)


def unified_diff(v: DataFrame, path: str = "path") -> DataFrame:
    """Unified diff text (3 context lines, the path in both headers) for each
    changed row; equal rows are dropped before the Arrow UDF runs, since
    Catalyst cannot see into it."""
    changed = changed_only(v)
    return changed.withColumn("diff", _unified(F.col(path), F.col("old"), F.col("new")))
