"""Corpus operators over ``files(project, path, length, content)``.

Exclusion and size tests work on metadata columns only, so Catalyst prunes
``content`` from the scan until it is needed. A per-project cap, where the
caller gives one, uses ``row_number() <= k``, which Spark plans as a
``WindowGroupLimit`` (top-k per group before the shuffle), so a project of any
size sends at most ``k`` paths per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_suffix, split_lines_array
from ..session import bounded_broadcast, scratch_path

# The two sets of excluded path segments.
LISTING_EXCLUDES = ["node_modules", "dist", "build"]
CORPUS_EXCLUDES = [".git", ".hg", ".svn", ".venv", "venv", "node_modules", "dist", "build", "__pycache__"]
# Bytes of text that share a pack of a large project.
PACK_BYTES = 4_000_000


def exclude_paths(df: DataFrame, segments=LISTING_EXCLUDES, path: str = "path") -> DataFrame:
    """Drop rows where any segment of the (relative) path is in ``segments``."""
    segs = F.array(*[F.lit(s) for s in segments])
    return df.filter(~F.arrays_overlap(F.split(F.col(path), "/"), segs))


def corpus_status(
    files: DataFrame, max_files: int | None = None, max_bytes: int | None = None, segments=CORPUS_EXCLUDES
) -> DataFrame:
    """Every file with its ``status``: 'excluded' (a path segment), 'too large'
    (over ``max_bytes``), 'not UTF-8', 'over the cap' (not among the project's
    first ``max_files`` of the others, by path) or 'kept'. Without limits no
    file is too large or over the cap."""
    segs = F.array(*[F.lit(s) for s in segments])
    content = F.col("content").cast("string") if dict(files.dtypes)["content"] == "binary" else F.col("content")
    first = F.when(F.arrays_overlap(F.split("path", "/"), segs), "excluded")
    if max_bytes is not None:
        first = first.when(F.col("length") > max_bytes, "too large")
    first = first.when(~F.coalesce(F.is_valid_utf8(content), F.lit(True)), "not UTF-8")
    out = files.withColumn("_why", first)
    if max_files is None:
        return out.withColumn("status", F.coalesce("_why", F.lit("kept"))).drop("_why")
    # the cap counts survivors: only paths move to rank them
    ranked = out.where("_why is null").select(F.col("project").alias("_p"), F.col("path").alias("_f"))
    top = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy("_p").orderBy("_f"))).where(F.col("_rn") <= max_files)
    out = out.join(top, F.col("project").eqNullSafe(F.col("_p")) & F.col("path").eqNullSafe(F.col("_f")), "left")
    kept = F.when(F.col("_rn").isNotNull(), "kept").otherwise("over the cap")
    return out.withColumn("status", F.coalesce("_why", kept)).drop("_why", "_p", "_f", "_rn")


def collect_corpus(
    files: DataFrame, max_files: int | None = None, max_bytes: int | None = None, segments=CORPUS_EXCLUDES
) -> DataFrame:
    """The files that ``corpus_status`` keeps; limits hold only if the caller gives them."""
    return corpus_status(files, max_files, max_bytes, segments).where("status = 'kept'").drop("status")


def head_text(files: DataFrame, n: int | None = None) -> DataFrame:
    """First file of each project by path; ``head`` is its text, or the first
    ``n`` characters if the caller asks for so many. A null project is one; rows
    that share the first path all come out."""
    first = files.groupBy("project").agg(F.min("path").alias("path")).select(F.struct("project", "path").alias("_first"))
    out = files.join(first, F.struct("project", "path") == F.col("_first"), "left_semi")
    return out.withColumn("head", F.col("content") if n is None else F.substring("content", 1, n))


def tag_language(files: DataFrame, extensions: DataFrame | None = None, max_dim_rows: int = 100_000) -> DataFrame:
    """Add ``language`` from a caller's ``extensions(suffix, language)`` table by
    file suffix; unknown suffixes (and no table) give ``'unknown'``.

    The extension table is broadcast only after its row count is proven small.
    """
    f = files.withColumn("suffix", F.lower(path_suffix("path")))
    if extensions is None:
        return f.withColumn("language", F.lit("unknown")).drop("suffix")
    ext = extensions.select(F.lower("suffix").alias("suffix"), "language").dropDuplicates(["suffix"])
    out = f.join(bounded_broadcast(ext, max_dim_rows), "suffix", "left")
    return out.withColumn("language", F.coalesce("language", F.lit("unknown"))).drop("suffix")


def corpus_profile(files: DataFrame) -> DataFrame:
    """Files, lines, characters and longest line per project and language.

    Per-file figures come from one narrow projection; the aggregation is
    partial before the shuffle."""
    lens = F.transform(split_lines_array("content"), lambda s: F.char_length(s))
    per_file = files.select(
        "project", "language",
        F.size(lens).alias("n_lines"),
        F.char_length("content").alias("n_chars"),
        F.coalesce(F.array_max(lens), F.lit(0)).alias("longest"),
    )
    return per_file.groupBy("project", "language").agg(
        F.count("*").cast("long").alias("n_files"),
        F.sum("n_lines").cast("long").alias("n_lines"),
        F.sum("n_chars").cast("long").alias("n_chars"),
        F.max("longest").cast("long").alias("longest_line"),
    )


def _packs(files: DataFrame, pack_bytes: int) -> DataFrame:
    """Add ``pack``: the bytes of the project's files before this one, in path
    order, divided by ``pack_bytes``. So packs follow path order, whatever the
    project's size, and one holds ``pack_bytes`` and its last file at most.

    Only paths and sizes move for the running sum. They are range-partitioned
    and written once with their partition's number; each window covers a
    project's rows of one partition, and one row a partition carries the sum."""
    spark = files.sparkSession
    size = F.col("length") if "length" in files.columns else F.octet_length("content")
    # one row a path, with the bytes of all rows that share it: they go to one pack
    narrow = files.groupBy("project", "path").agg(F.sum(F.coalesce(size, F.lit(0)).cast("long")).alias("_size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    path = scratch_path(spark, "packs")
    narrow.repartitionByRange(parts, "project", "path").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    narrow = spark.read.parquet(path).withColumn("_of", F.struct("project", "_part"))
    w = Window.partitionBy("_of").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.groupBy("_of").agg(F.sum("_size").alias("_sum"))
    up = Window.partitionBy("_of.project").orderBy("_of._part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_of", F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_base"))
    before = F.coalesce(F.sum("_size").over(w), F.lit(0))
    # structs as keys: a null project or path is a value like others
    at = narrow.withColumn("_before", before).join(sums, "_of")
    at = at.select(F.struct("project", "path").alias("_at"), F.floor((F.col("_base") + F.col("_before")) / pack_bytes).cast("long").alias("pack"))
    return files.join(at, F.struct("project", "path") == F.col("_at")).drop("_at")


def file_block(path="path", language="language", content="content") -> F.Column:
    """The text of one file inside a project block."""
    return F.concat(
        F.lit("### file: "), F.col(path), F.lit("\n### language: "),
        F.coalesce(F.col(language), F.lit("unknown")), F.lit("\n"),
        F.coalesce(F.col(content), F.lit("")), F.lit("\n### end of file"),
    )


def files_block(files: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """One text per pack of a project: each file's block in path order, separated
    by a blank line. A file without content has an empty block."""
    f = files if "language" in files.columns else files.withColumn("language", F.lit("unknown"))
    f = _packs(f, pack_bytes)
    blocks = F.array_sort(F.collect_list(F.struct(F.col("path").alias("p"), file_block().alias("b"))))
    return f.groupBy("project", "pack").agg(
        F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("block"),
        F.count("*").cast("long").alias("n_files"),
    )


def build_snapshot(files: DataFrame, src_lang: str, tgt_lang: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """One row per project (pack) with the files as an ordered
    ``array<struct<path, language, content>>`` and a fixed summary."""
    f = files if "language" in files.columns else files.withColumn("language", F.lit("unknown"))
    f = _packs(f, pack_bytes)
    arr = F.array_sort(F.collect_list(F.struct("path", "language", "content")))
    return f.groupBy("project", "pack").agg(arr.alias("files")).select(
        F.col("project").alias("root"), "pack",
        F.lit(f"Project to convert from {src_lang} to {tgt_lang}.").alias("summary"),
        "files",
    )
