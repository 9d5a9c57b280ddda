"""Code-hygiene jobs: repeated blocks of lines and unused definitions.

Maximal repeated runs are in ``repeats``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import code_lines

BLOCK_BUCKET = 1024


def duplicate_blocks(lines: DataFrame, k: int = 2, bucket: int = BLOCK_BUCKET) -> DataFrame:
    """Runs of ``k`` consecutive lines that occur more than once.

    Lines are grouped by ``(path, bucket of `bucket` lines)``, a bucket having
    at least ``k`` lines; the first ``k - 1`` lines of each bucket are also
    copied to the previous bucket so that runs crossing a bucket edge are seen
    whole. A rows window inside
    each bounded group collects the ``k`` lines starting at every line, so
    the shuffle carries each line about once and no file lands whole in one
    task. Full runs of consecutive line numbers are hashed (SHA-256 of the
    lines joined by '\\n') and counted with a map-side partial aggregation.
    Returns ``block_hash, n, first_path, first_line``.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    bucket = max(bucket, k)  # a run then touches two buckets at most
    b = F.floor((F.col("line_no") - 1) / F.lit(bucket)).cast("long")
    pos = (F.col("line_no") - 1) % bucket
    own = F.struct(b.alias("b"), F.lit(True).alias("own"))
    prev = F.when((pos < k - 1) & (b > 0), F.struct((b - 1).alias("b"), F.lit(False).alias("own")))
    copies = lines.select("path", "line_no", "line", F.explode(F.array(own, prev)).alias("_t")) \
        .filter(F.col("_t").isNotNull()).select("path", "line_no", "line", "_t.b", "_t.own")
    w = Window.partitionBy("path", "b").orderBy("line_no").rowsBetween(0, k - 1)
    runs = copies.select(
        "path", "line_no", "own",
        F.collect_list("line").over(w).alias("_w"),
        F.max("line_no").over(w).alias("_last"),
    ).filter(F.col("own") & (F.size("_w") == k) & (F.col("_last") - F.col("line_no") == k - 1))
    hashed = runs.select("path", "line_no", F.sha2(F.array_join("_w", "\n"), 256).alias("block_hash"))
    return hashed.groupBy("block_hash").agg(
        F.count("*").cast("long").alias("n"),
        F.min(F.struct("path", "line_no")).alias("_first"),
    ).filter(F.col("n") > 1).select(
        "block_hash", "n", F.col("_first.path").alias("first_path"),
        F.col("_first.line_no").cast("long").alias("first_line"),
    )


# Definition grammars: (kind, pattern, group of the defined name).
DEFINITIONS = [
    ("import", r"^\s*import\s+[A-Za-z_][\w.]*\s+as\s+([A-Za-z_]\w*)\s*$", 1),
    ("import", r"^\s*import\s+([A-Za-z_]\w*)\s*$", 1),
    ("import", r"^\s*from\s+[\w.]+\s+import\s+[A-Za-z_]\w*\s+as\s+([A-Za-z_]\w*)\s*$", 1),
    ("import", r"^\s*from\s+[\w.]+\s+import\s+([A-Za-z_]\w*)\s*$", 1),
    ("function", r"^\s*def\s+([A-Za-z_]\w*)", 1),
    ("class", r"^\s*class\s+([A-Za-z_]\w*)", 1),
    ("variable", r"^([A-Za-z_]\w*)\s*=([^=]|$)", 1),
]
TOKEN = r"[A-Za-z_]\w*"


def definitions(lines: DataFrame) -> DataFrame:
    """``path, line_no, kind, name`` for each line that defines a name (first
    matching grammar wins); names starting with '__' are skipped."""
    kind = None
    name = None
    for k, pat, g in DEFINITIONS:
        hit = F.col("line").rlike(pat)
        kind = F.when(hit, F.lit(k)) if kind is None else kind.when(hit, F.lit(k))
        name = F.when(hit, F.regexp_extract("line", pat, g)) if name is None else \
            name.when(hit, F.regexp_extract("line", pat, g))
    d = lines.select("path", "line_no", kind.alias("kind"), name.alias("name"))
    return d.filter(F.col("name").isNotNull() & ~F.col("name").startswith("__"))


def unused_definitions(lines: DataFrame) -> DataFrame:
    """Imports, functions, classes and module-level variables whose name
    occurs only once (at its definition) among the tokens of its file.

    Only code counts: names in comments and strings, docstrings of many lines
    included, are no uses, and lines inside strings define nothing. Token counts
    are grouped by ``(path, token)`` with partial aggregation, so a large file
    spreads over the shuffle by token."""
    code = code_lines(lines.select("path", "line_no", "line")).drop("line").withColumnRenamed("code", "line")
    toks = code.select("path", F.explode(F.regexp_extract_all("line", F.lit(TOKEN), 0)).alias("name"))
    counts = toks.groupBy("path", "name").agg(F.count("*").alias("_n"))
    d = definitions(code.where("state = 0"))
    return d.join(counts.filter(F.col("_n") == 1), ["path", "name"], "left_semi").select(
        "path", "line_no", "kind", "name")
