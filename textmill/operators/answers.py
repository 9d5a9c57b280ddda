"""JSON answers: object check, returned files, issue tables and reports.

Answers are parsed once into VARIANT (``try_parse_json``) and probed with
``schema_of_variant``: unlike ``from_json`` with a string schema, this tells a
JSON string from a number, so ``{"path": 123}`` is rejected as the reference
does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Issue types the analysis may report.
ISSUE_TYPES = ["missing", "unused", "conflict", "outdated", "other"]


def parse_answers(df: DataFrame, col: str = "answer") -> DataFrame:
    """Add ``v`` (VARIANT, NULL unless a JSON object), ``kind``
    ('object' / 'array' / 'scalar' / 'invalid') and ``error``."""
    raw = F.try_parse_json(F.col(col))
    sch = F.schema_of_variant(raw)
    kind = (
        F.when(raw.isNull(), F.lit("invalid"))
        .when(sch.startswith("OBJECT"), F.lit("object"))
        .when(sch.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("scalar"))
    )
    out = df.withColumn("_raw", raw).withColumn("kind", kind)
    return out.withColumn("v", F.when(F.col("kind") == "object", F.col("_raw"))).withColumn(
        "error",
        F.when(F.col("kind") == "invalid", F.lit("invalid JSON"))
        .when(F.col("kind") != "object", F.lit("not a JSON object")),
    ).drop("_raw")


def _is_string(v, path) -> F.Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"


def answer_notes(parsed: DataFrame) -> F.Column:
    """``notes`` as a string: text as is, other JSON values as JSON text,
    missing as ''."""
    return F.when(F.col("v").isNotNull(), F.coalesce(F.try_variant_get("v", "$.notes", "string"), F.lit("")))


def converted_files(parsed: DataFrame, keys=("key",)) -> DataFrame:
    """Entries of ``files`` whose ``path`` and ``content`` are both JSON
    strings, with their position; a non-list gives no rows, non-object
    entries are dropped."""
    arr = F.try_variant_get("v", "$.files", "array<variant>")
    x = parsed.select(*keys, F.posexplode(arr).alias("pos", "e"))
    x = x.filter(_is_string(F.col("e"), "$.path") & _is_string(F.col("e"), "$.content"))
    return x.select(
        *keys, F.col("pos").cast("long").alias("pos"),
        F.try_variant_get("e", "$.path", "string").alias("path"),
        F.try_variant_get("e", "$.content", "string").alias("content"),
    )


def answer_summary(parsed: DataFrame, keys=("key",)) -> DataFrame:
    """One row per answer, bad ones too: ``summary`` and ``notes`` ('' when
    missing, null for a bad answer), ``n_issues`` (0 unless a list) and
    ``error``."""
    issues = F.try_variant_get("v", "$.issues", "array<variant>")
    good = F.col("v").isNotNull()
    return parsed.select(
        *keys,
        F.when(good, F.coalesce(F.try_variant_get("v", "$.summary", "string"), F.lit(""))).alias("summary"),
        answer_notes(parsed).alias("notes"),
        F.coalesce(F.size(issues), F.lit(0)).cast("long").alias("n_issues"),
        "error",
    )


def issues_table(parsed: DataFrame, keys=("key",)) -> DataFrame:
    """One row per entry of ``issues``: ``pos, type, file, detail,
    suggestion`` and ``type_ok``. A missing or non-list ``issues`` gives none."""
    arr = F.try_variant_get("v", "$.issues", "array<variant>")
    x = parsed.select(*keys, F.posexplode(arr).alias("pos", "e"))

    def g(name):
        return F.try_variant_get("e", f"$.{name}", "string")

    return x.select(
        *keys, F.col("pos").cast("long").alias("pos"),
        g("type").alias("type"), g("file").alias("file"), g("detail").alias("detail"),
        g("suggestion").alias("suggestion"), F.coalesce(g("type").isin(ISSUE_TYPES), F.lit(False)).alias("type_ok"),
    )


def issue_report(issues: DataFrame, files: DataFrame, keys=("key",)) -> DataFrame:
    """One row per target file of each answer: issues numbered from 1 in list
    order, rendered as one text; files that are absent from ``files`` (keys +
    ``path``) are reported as ``skipped``. NULL and '' targets are dropped.

    A file's issues are numbered inside the aggregation that gathers them; a
    left join on ``files`` tells which files are there. The report's layout is
    this package's own: a numbered line with the type, then detail and
    suggestion."""
    keys = list(keys)
    it = issues.filter(F.col("file").isNotNull() & (F.col("file") != ""))
    parts = F.array_sort(F.collect_list(F.struct("pos", "type", "detail", "suggestion")))

    def entry(x, i):
        return F.concat(
            F.lit("#"), (i + 1).cast("string"), F.lit(" "), F.coalesce(x["type"], F.lit("unknown")),
            F.lit("\n  what: "), F.coalesce(x["detail"], F.lit("-")),
            F.lit("\n  fix: "), F.coalesce(x["suggestion"], F.lit("-")), F.lit("\n"),
        )

    rep = it.groupBy(*keys, "file").agg(parts.alias("_p"), F.count("*").cast("long").alias("n_issues"))
    rep = rep.withColumn("report", F.array_join(F.transform("_p", entry), "\n")).drop("_p")
    present = files.select(*keys, F.col("path").alias("file")).distinct().withColumn("_present", F.lit(True))
    out = rep.join(present, keys + ["file"], "left")
    return out.select(
        *keys, "file", "n_issues", "report",
        F.when(F.col("_present"), F.lit("ok")).otherwise(F.lit("skipped")).alias("status"),
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("type").agg(F.count("*").cast("long").alias("n"))
