"""Rewrite flows: whole files, line ranges, approvals and output placement."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import drop_echo, path_suffix, safe_name, strip_code_fences, swap_suffix
from ..session import scratch_path
from . import ranges
from .answers import answer_notes, converted_files, parse_answers
from .corpus import PACK_BYTES, files_block
from .infer import batch_infer
from .prompts import render_prompts


def write_approved(
    changes: DataFrame,
    approvals: DataFrame | None,
    out: str | None = None,
    dry_run: bool = True,
    keys=("project", "path"),
    version: str | None = None,
) -> DataFrame:
    """Status per changed row and, unless ``dry_run``, a new version of the
    approved rows written under ``out`` partitioned by project.

    ``changes(keys, old, new[, error])``; ``approvals(keys, approved)``.
    Rows with an ``error`` are never written (status 'error'); unchanged rows
    are skipped; missing approval means no, and of several approvals of a row
    any refusal counts. Status is 'error', 'unchanged', 'rejected', 'would
    write' (dry run) or 'written'. Each call writes a version of its own
    (``version=<name>``, by default the time), so earlier rounds stay."""
    keys = list(keys)
    c = changes
    if approvals is not None:
        once = approvals.groupBy(F.struct(*keys).alias("_for")).agg(F.min(F.coalesce("approved", F.lit(False))).alias("_ok"))
        c = c.join(once, F.struct(*[c[k] for k in keys]) == F.col("_for"), "left").drop("_for")
    else:
        c = c.withColumn("_ok", F.lit(False))
    changed = ~F.col("old").eqNullSafe(F.col("new"))
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    failed = F.col("error").isNotNull() if "error" in c.columns else F.lit(False)
    status = (
        F.when(failed, F.lit("error"))
        .when(~changed, F.lit("unchanged"))
        .when(~ok, F.lit("rejected"))
        .otherwise(F.lit("would write" if dry_run else "written"))
    )
    result = c.withColumn("status", status)
    if not dry_run:
        if out is None:
            raise ValueError("out is required unless dry_run")
        todo = result.filter(F.col("status") == "written").select(*keys, F.col("new").alias("content"))
        name = version or f"{time.time_ns():020d}"
        writer = todo.withColumn("version", F.lit(name)).write.mode("append")
        writer.partitionBy("version", *(["project"] if "project" in keys else [])).parquet(out)
    return result.drop("_ok")


def read_written(spark, out: str, keys=("project", "path")) -> DataFrame:
    """The newest written content of each row over all versions below ``out``.

    Versions that are numbers are in the order of numbers, and before names;
    projects are text, as folders are, and a null project is one."""
    files = spark.read.option("basePath", out)
    found = files.parquet(out).schema
    for name in ("version", "project"):
        if name in found.names:
            found[name].dataType = T.StringType()  # no guess from the names of folders
    rows = files.schema(found).parquet(out)
    order = F.struct(F.when(F.col("version").rlike("^[0-9]+$"), F.lpad("version", 40, "0")).otherwise(F.col("version")).alias("o"), "version")
    newest = rows.groupBy(F.struct(*keys).alias("_row")).agg(F.max(order).alias("_newest"))
    mine = F.struct(*[rows[k] for k in keys])
    return rows.join(newest, (mine == F.col("_row")) & (rows["version"] == F.col("_newest.version"))).select(*keys, "version", "content")


def rewrite_corpus(
    files: DataFrame,
    task: str,
    predict_factory,
    approvals: DataFrame | None = None,
    out: str | None = None,
    dry_run: bool = True,
) -> DataFrame:
    """Whole-file rewriting: render the task's prompt per file, infer, strip
    fences, compare, gate on approvals, write. Returns ``project, path, old,
    new, error, status`` (status 'error' when the model failed)."""
    p = render_prompts(files.withColumnRenamed("content", "code"), task)
    # one pass over the answers: the model is called once per distinct prompt,
    # and when files are written the answers are materialised first
    # prompts carry the path, so they are unique: no de-duplication pass
    a = batch_infer(p, predict_factory, materialize=None if dry_run else True, dedupe=False)
    v = a.select("project", "path", F.col("code").alias("old"),
                 F.when(F.col("error").isNull(), strip_code_fences("answer")).alias("new"), "error")
    return write_approved(v, approvals, out, dry_run)


def partial_rewrite(
    lines: DataFrame,
    selections: DataFrame,
    predict_factory,
    dry_run: bool = True,
    global_instruction: str = "",
    id_col: str = "sel_id",
):
    """Rewrite selected line ranges: extract (range join), render, infer,
    clean the answer (fences, echoed original), and unless ``dry_run`` apply
    the previewed text to the lines.

    Returns ``(results, new_lines)``; ``new_lines`` is None in a dry run. The
    answers applied are the persisted preview, never a second model call.
    """
    sel = selections
    for c, default in (("kind", "custom"), ("instruction", "")):
        if c not in sel.columns:
            sel = sel.withColumn(c, F.lit(default))
    ex = ranges.extract_ranges(lines, sel, id_col).withColumnRenamed("error", "_ex_error")
    ex = ex.withColumn("global_instruction", F.lit(global_instruction)).withColumnRenamed("snippet", "code")
    p = render_prompts(ex, "snippet")
    # selections that failed to extract get no prompt and are never sent
    p = p.withColumn("user_prompt", F.when(F.col("_ex_error").isNull(), F.col("user_prompt")))
    # prompts carry path and line range, so they are unique: no de-duplication
    a = batch_infer(p, predict_factory, materialize=None if dry_run else True, dedupe=False)
    cleaned = drop_echo(strip_code_fences("answer"), F.col("code"))
    ok = F.col("_ex_error").isNull()
    results = a.select(
        id_col, "path", "start_line", "end_line",
        F.when(ok, F.col("code")).alias("original_snippet"),
        F.when(ok & F.col("error").isNull(), cleaned).alias("refactored_snippet"),
        F.coalesce(F.col("_ex_error"), F.concat(F.lit("model error: "), F.col("error"))).alias("error"),
    )
    if dry_run:
        return results.withColumn("applied", F.lit(False)), None
    spark = lines.sparkSession
    path = scratch_path(spark, "partial-rewrite")
    results.write.parquet(path)
    results = spark.read.parquet(path)
    edits = results.filter(F.col("error").isNull()).select(
        F.col(id_col).alias("edit_id"), "path", "start_line", "end_line", F.col("refactored_snippet").alias("snippet"))
    new_lines, status = ranges.apply_edits(lines, edits)
    applied = status.select(F.col("edit_id").alias(id_col), F.col("error").alias("_apply_error"))
    results = results.join(applied, id_col, "left").select(
        id_col, "path", "start_line", "end_line", "original_snippet", "refactored_snippet",
        F.coalesce("error", "_apply_error").alias("error"),
        (F.col("error").isNull() & F.col("_apply_error").isNull()).alias("applied"),
    )
    return results, new_lines


def place_outputs(converted: DataFrame, originals: DataFrame, tgt_lang: str, keys=("key",)) -> DataFrame:
    """Where converted files go.

    ``converted(keys, pos, path, content)``; ``originals(keys, orig_path, root,
    single)``. Single-file mode keeps the original stem and takes only the
    suffix of the first returned file (no suffix keeps the old one); action
    'rename' or 'replace'. Project mode writes each file under
    ``<root>_converted_to_<safe target>/``; absolute paths and '..'
    segments are refused (``error``)."""
    keys = list(keys)
    c = converted.join(originals, keys)
    w = Window.partitionBy(*keys).orderBy("pos")
    c = c.withColumn("_rn", F.row_number().over(w))
    single = c.filter(F.col("single") & (F.col("_rn") == 1))
    sfx = path_suffix("path")
    target = F.when(sfx != "", swap_suffix("orig_path", sfx)).otherwise(F.col("orig_path"))
    single = single.select(*keys, "pos", target.alias("target_path"),
                           F.when(target != F.col("orig_path"), F.lit("rename")).otherwise(F.lit("replace"))
                           .alias("action"), F.lit(None).cast("string").alias("error"))
    proj = c.filter(~F.col("single"))
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    out_dir = F.concat(F.col("root"), F.lit("_converted_to_"), safe_name(F.lit(tgt_lang)), F.lit("/"))
    proj = proj.select(
        *keys, "pos",
        F.when(~unsafe, F.concat(out_dir, F.col("path"))).alias("target_path"),
        F.lit("write").alias("action"),
        F.when(unsafe, F.lit("unsafe path")).alias("error"),
    )
    return single.unionByName(proj)


def convert_projects(
    files: DataFrame,
    src_lang: str,
    tgt_lang: str,
    predict_factory,
    target_stack_desc: str | None = None,
    pack_bytes: int = PACK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Project conversion: one prompt per project (per pack of a large
    project) with all its files, a JSON answer, the returned files validated
    and placed under ``<project>_converted_to_<safe target>/``.

    Returns ``(files_out, notes)``: ``project, pack, pos, path, content,
    target_path, action, error`` per returned file, and ``project, pack,
    notes, error`` per answer (a non-object answer is an error there)."""
    desc = target_stack_desc or f"An idiomatic {tgt_lang} project using its standard library."
    blocks = files_block(files, pack_bytes).select(
        "project", "pack", F.col("block").alias("files_block"),
        F.lit(src_lang).alias("src_lang"), F.lit(tgt_lang).alias("tgt_lang"),
        F.lit(desc).alias("target_stack_desc"),
        F.lit(f"Project to convert from {src_lang} to {tgt_lang}.").alias("summary"),
    )
    p = render_prompts(blocks, "convert")
    a = batch_infer(p, predict_factory, dedupe=False).select(
        "project", "pack", "answer", F.col("error").alias("_model_error"))
    parsed = parse_answers(a)
    notes = parsed.select("project", "pack", answer_notes(parsed).alias("notes"),
                          F.coalesce(F.concat(F.lit("model error: "), "_model_error"), "error").alias("error"))
    conv = converted_files(parsed, keys=("project", "pack"))
    originals = blocks.select("project", "pack", F.lit(None).cast("string").alias("orig_path"),
                              F.col("project").alias("root"), F.lit(False).alias("single"))
    placed = place_outputs(conv, originals, tgt_lang, keys=("project", "pack"))
    out = conv.join(placed, ["project", "pack", "pos"])
    return out, notes

