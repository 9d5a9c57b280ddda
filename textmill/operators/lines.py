"""Lines: split text into numbered rows and join them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines_array


def split_lines(
    df: DataFrame,
    text: str = "text",
    keepends: bool = False,
    line_col: str = "line",
) -> DataFrame:
    """One row per line (``str.splitlines`` boundaries), ``line_no`` from 1.

    A generator over one row's array: narrow, no shuffle. Empty text gives no
    rows. Other input columns are kept (minus ``text``).
    """
    cols = [c for c in df.columns if c != text]
    return df.select(
        *cols,
        F.posexplode(split_lines_array(F.col(text), keepends)).alias("_pos", line_col),
    ).select(*cols, (F.col("_pos") + 1).cast("int").alias("line_no"), line_col)


def join_lines(
    lines: DataFrame,
    keys: list[str],
    line_no: str = "line_no",
    line: str = "line",
    out: str = "text",
    final_newline: bool = True,
) -> DataFrame:
    """Lines of each key in ``line_no`` order joined by '\\n', plus one final
    newline (as the reference writes files). One shuffle on ``keys``."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col(line).alias("t"))))
    body = F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")
    text = F.concat(body, F.lit("\n")) if final_newline else body
    return lines.groupBy(*keys).agg(text.alias(out), F.count("*").cast("long").alias("n_lines"))
