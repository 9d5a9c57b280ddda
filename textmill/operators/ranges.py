"""Line-range joins: extract line ranges and replace them by new text.

The join between ``lines(path, line_no, line)`` and ranges
``(path, start_line, end_line)`` is an equi-join on ``(path, bucket)`` with
the range test as a residual condition: each range is exploded over the
buckets of ``bucket_lines`` lines it covers, each line falls in one bucket.
So the join shuffles on a key finer than the file, a single huge file is
spread over many tasks, and Spark never falls back to a nested-loop join.
Ranges are first clipped to the file's length (a partial aggregation), so a
range ending past the file never explodes into empty buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines_array
from ..session import materialize

BUCKET_LINES = 1024


def _bucket(pos) -> F.Column:
    return F.floor((pos - 1) / F.lit(BUCKET_LINES)).cast("long")


def range_join(lines: DataFrame, ranges: DataFrame, start: str, end: str, how: str = "inner") -> DataFrame:
    """Join ``lines`` to ``ranges`` on ``path`` and ``start <= line_no <= end``.

    ``ranges`` must already be clipped to the file (``end <= n_lines``).
    With ``how='left'`` lines outside every range are kept with NULLs.
    """
    lb = lines.withColumn("_b", _bucket(F.col("line_no")))
    rb = ranges.withColumn(
        "_b", F.explode(F.sequence(_bucket(F.col(start)), F.greatest(_bucket(F.col(end)), _bucket(F.col(start)))))
    ).withColumnRenamed("path", "_rpath")
    cond = [
        lb["path"] == rb["_rpath"],
        lb["_b"] == rb["_b"],
        lb["line_no"] >= rb[start],
        lb["line_no"] <= rb[end],
    ]
    return lb.join(rb, cond, how).drop("_b", "_rpath")


def dyadic_cover(lo: F.Column, hi: F.Column) -> F.Column:
    """Numbers ``lo..hi`` as at most two aligned blocks of ``2**level`` numbers a
    level: an array of (level, index)."""
    none = F.array().cast("array<struct<level:int,index:bigint>>")
    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), none.alias("out"))

    def step(a, level):
        left, right = a["lo"] % 2 == 1, (a["hi"] % 2 == 0) & (a["lo"] + a["lo"] % 2 <= a["hi"])
        block = lambda at: F.array(F.struct(level.alias("level"), at.alias("index")))
        some = F.concat(a["out"], F.when(left, block(a["lo"])).otherwise(none), F.when(right, block(a["hi"])).otherwise(none))
        up = F.struct(F.shiftright(a["lo"] + a["lo"] % 2, 1).alias("lo"),
                      F.shiftright(a["hi"] - F.when(right, 1).otherwise(0), 1).alias("hi"), some.alias("out"))
        return F.when(a["lo"] <= a["hi"], up).otherwise(a)

    levels = F.ceil(F.log2((hi - lo + 2).cast("double"))).cast("int") + 1
    many = F.aggregate(F.sequence(F.lit(0), levels), start, step, lambda a: a["out"])
    one = F.array(F.struct(F.lit(0).alias("level"), lo.cast("long").alias("index")))
    return F.when(lo == hi, one).otherwise(many)


def dyadic_join(lines: DataFrame, ranges: DataFrame, start: str, end: str) -> DataFrame:
    """The inner ``range_join`` for ranges of any length. A range is at most two rows a
    level of aligned blocks of buckets, instead of one for each bucket, and a line
    probes the block above it at each level that occurs: one where ranges are short,
    some twenty where they span files of ten million lines."""
    blocks = dyadic_cover(_bucket(F.col(start)), F.greatest(_bucket(F.col(end)), _bucket(F.col(start))))
    rb = materialize(ranges.withColumn("_c", F.explode(blocks)).withColumnRenamed("path", "_rpath"), "range-blocks")
    levels = [r["l"] for r in rb.select(F.col("_c.level").alias("l")).distinct().collect()]  # one a power of two
    probes = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(_bucket(F.col("line_no")), n).alias("index")) for n in sorted(levels)])
    if not levels:
        probes = F.array().cast("array<struct<level:int,index:bigint>>")
    lb = lines.withColumn("_d", F.explode(probes))
    cond = [lb["path"] == rb["_rpath"], lb["_d.level"] == rb["_c.level"], lb["_d.index"] == rb["_c.index"],
            lb["line_no"] >= rb[start], lb["line_no"] <= rb[end]]
    return lb.join(rb, cond).drop("_d", "_c", "_rpath")


# Lines a piece of a file spans in running values over its edits.
PIECE_LINES = 65_536


def ordered_scan(df: DataFrame, group: str, at: str, order: list, max_col=None, sum_col=None, next_col=None) -> DataFrame:
    """Running values over the rows of each ``group`` in ``order`` without a
    window over a whole group: ``_prev_max`` (max of ``max_col`` over earlier
    rows), ``_sum_before`` (sum of ``sum_col`` over earlier rows), ``_next``
    (``next_col`` of the next row) and ``_first`` (first row of the group).

    A row belongs to the piece ``at div PIECE_LINES`` of its group, ``at`` being
    the first column of ``order``, so pieces are in order and do not depend on
    how the data is partitioned. Windows run inside each (group, piece); one
    row a piece, scanned across the pieces of the group, supplies what comes
    before and after. Both sides are dealt by the same two columns."""
    d = df.withColumn("_piece", F.floor(F.col(at) / PIECE_LINES).cast("long"))
    w = Window.partitionBy(group, "_piece").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(None).cast("long")
    d = d.withColumns({
        "_mx": F.col(max_col).cast("long") if max_col else none,
        "_sm": F.col(sum_col).cast("long") if sum_col else F.lit(0).cast("long"),
        "_nx": F.col(next_col).cast("long") if next_col else none,
    })
    summary = d.groupBy(group, "_piece").agg(
        F.max("_mx").alias("_pmax"), F.sum("_sm").alias("_psum"), F.min_by("_nx", F.struct(*order)).alias("_pnext")
    )
    ws = Window.partitionBy(group).orderBy("_piece")
    wb = ws.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        group, "_piece",
        F.max("_pmax").over(wb).alias("_cmax"),
        F.sum("_psum").over(wb).alias("_csum"),
        F.lead("_pnext").over(ws).alias("_cnext"),
        (F.row_number().over(ws) == 1).alias("_cfirst"),
    )
    d = d.withColumns({
        "_lmax": F.max("_mx").over(before),
        "_lsum": F.sum("_sm").over(before),
        "_lnext": F.lead("_nx").over(w),
        "_lfirst": F.row_number().over(w) == 1,
    })
    out = d.join(summary, [group, "_piece"])
    return out.select(
        *df.columns,
        F.greatest("_lmax", "_cmax").alias("_prev_max"),
        (F.coalesce("_lsum", F.lit(0)) + F.coalesce("_csum", F.lit(0))).alias("_sum_before"),
        F.coalesce("_lnext", "_cnext").alias("_next"),
        (F.col("_lfirst") & F.col("_cfirst")).alias("_first"),
    )


def file_lengths(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``path, n_file_lines``: from ``files(path, n_lines)``, which also names
    empty files, or else from the lines that are there."""
    if files is not None:
        return files.select("path", F.col("n_lines").alias("n_file_lines"))
    return lines.groupBy("path").agg(F.max("line_no").alias("n_file_lines"))


def extract_ranges(
    lines: DataFrame, selections: DataFrame, id_col: str = "sel_id", files: DataFrame | None = None
) -> DataFrame:
    """Text of lines ``start_line..end_line`` (1-based, inclusive) for each
    selection, joined by '\\n'. A range past the end is cut, as slices are.

    Adds ``snippet``, ``n_snippet_lines`` and ``error``: 'file not found' when
    the path is neither in ``files(path, n_lines)`` nor, without that table, in
    the lines; 'invalid range' unless ``1 <= start <= end``.
    """
    sel = selections.join(file_lengths(lines, files), "path", "left")
    error = (
        F.when(F.col("n_file_lines").isNull(), F.lit("file not found"))
        .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), F.lit("invalid range"))
    )
    sel = sel.withColumn("error", error)
    good = sel.filter(F.col("error").isNull() & (F.col("start_line") <= F.col("n_file_lines"))).select(
        id_col, "path", F.col("start_line").alias("_s"), F.least("end_line", "n_file_lines").alias("_e")
    )
    hit = dyadic_join(lines.select("path", "line_no", "line"), good, "_s", "_e")
    parts = F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), F.col("line").alias("t"))))
    snippets = hit.groupBy(id_col).agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("snippet"),
        F.count("*").cast("long").alias("n_snippet_lines"),
    )
    out = sel.join(snippets, id_col, "left")
    ok = F.col("error").isNull()
    return out.select(
        *[c for c in selections.columns],
        F.when(ok, F.coalesce("snippet", F.lit(""))).alias("snippet"),
        F.when(ok, F.coalesce("n_snippet_lines", F.lit(0).cast("long"))).alias("n_snippet_lines"),
        "error",
    )


def plan_edits(lines: DataFrame, edits: DataFrame, id_col: str = "edit_id", files: DataFrame | None = None):
    """Validate edits ``(path, start_line, end_line, snippet)`` and compute
    where they land.

    An edit needs ``1 <= start <= end`` and an existing file; edits that
    overlap another edit of the same file are all rejected (the reference
    applies them in turn to shifted lines). Overlap is found with a running
    maximum of ``end_line`` and the next ``start_line`` in start order, so no
    pairs are formed; running values come from ``ordered_scan``, so no window
    spans the edits of a file. Returns ``(ok, status)``: the valid edits with
    the clipped range ``_s.._e``, their new lines, the line change ``_delta``,
    the shift accumulated by earlier edits of the file, the next edit's start
    and the rank in the file; and one status row per edit with ``error``.
    """
    e = edits.join(file_lengths(lines, files), "path", "left")
    basic = (
        F.when(F.col("n_file_lines").isNull(), F.lit("file not found"))
        .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), F.lit("invalid range"))
    )
    e = e.withColumn("_basic", basic)
    # overlaps: the max end of earlier edits and the start of the next one,
    # in (start, end, id) order within the file
    good = ordered_scan(e.filter(F.col("_basic").isNull()), "path", "start_line", ["start_line", "end_line", id_col],
                        max_col="end_line", next_col="start_line")
    overl = (F.col("_prev_max") >= F.col("start_line")) | (F.col("_next") <= F.col("end_line"))
    good = good.withColumn("error", F.when(overl, F.lit("overlapping edit")))
    status = e.filter(F.col("_basic").isNotNull()).select(*edits.columns, F.col("_basic").alias("error")) \
        .unionByName(good.select(*edits.columns, "error"))

    n = F.col("n_file_lines")
    ok = good.filter(F.col("error").isNull()).select(
        *edits.columns, "n_file_lines",
        F.least(F.col("start_line"), n + 1).alias("_s"),
        F.least(F.col("end_line"), n).alias("_e"),
        split_lines_array(F.coalesce("snippet", F.lit(""))).alias("_new"),
    )
    ok = ok.withColumn("_delta", F.size("_new") - F.greatest(F.col("_e") - F.col("_s") + 1, F.lit(0)))
    # line shift from earlier edits, the next edit's start, first edit of the file
    ok = ordered_scan(ok, "path", "_s", ["_s", "start_line", id_col], sum_col="_delta", next_col="_s")
    ok = ok.select(*[c for c in ok.columns if not c.startswith("_") or c in ("_s", "_e", "_new", "_delta")],
                   F.col("_sum_before").alias("_shift_before"), F.col("_next").alias("_next_s"),
                   F.when(F.col("_first"), 1).otherwise(2).alias("_rank"))
    return ok, status


def edited_files(lines: DataFrame, edits: DataFrame, files: DataFrame | None = None, id_col: str = "edit_id") -> DataFrame:
    """``path, n_lines`` of every file after its edits, empty ones included."""
    ok, _ = plan_edits(lines, edits, id_col, files)
    change = ok.groupBy("path").agg(F.sum("_delta").alias("_change"))
    out = file_lengths(lines, files).join(change, "path", "left")
    return out.select("path", (F.col("n_file_lines") + F.coalesce("_change", F.lit(0))).cast("long").alias("n_lines"))


def apply_edits(
    lines: DataFrame, edits: DataFrame, id_col: str = "edit_id", files: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Replace lines ``start..end`` of each file by the edit's lines; all
    other lines are kept. Returns ``(new_lines, status)``: the new
    ``lines(path, line_no, line)`` of every file (files without edits pass
    through unchanged) and one status row per edit with ``error``. Which files
    exist is taken from ``files(path, n_lines)`` if given, so an empty file can
    be edited; ``edited_files`` says which files are left without lines.

    Line numbers are computed, not re-ranked: a kept line moves by the line
    change of the edits before it, found by one range join against the
    segments between edits. No window spans a whole file.
    """
    ok, status = plan_edits(lines, edits, id_col, files)

    def seg(s, e, shift, drop):
        return F.struct(s.alias("seg_s"), e.alias("seg_e"), shift.cast("int").alias("shift"), F.lit(drop).alias("drop"))

    # For every edit, in one pass: the dropped range, the kept segment after
    # it (up to the next edit or the end of the file) with its shift, and for
    # the first edit of the file the segment before it (shift 0).
    segs = F.array(
        seg(F.col("_s"), F.col("_e"), F.lit(0), True),
        seg(F.col("_e") + 1, F.coalesce(F.col("_next_s") - 1, F.col("n_file_lines")),
            F.col("_shift_before") + F.col("_delta"), False),
        F.when(F.col("_rank") == 1, seg(F.lit(1), F.col("_s") - 1, F.lit(0), False)),
    )
    ranges = ok.select("path", F.explode(segs).alias("g")).filter(
        F.col("g").isNotNull() & (F.col("g.seg_s") <= F.col("g.seg_e"))
    ).select("path", "g.*")
    tagged = range_join(lines.select("path", "line_no", "line"), ranges, "seg_s", "seg_e", how="left")
    kept = tagged.filter(~F.coalesce(F.col("drop"), F.lit(False))).select(
        "path", (F.col("line_no") + F.coalesce("shift", F.lit(0))).cast("int").alias("line_no"), "line"
    )
    added = ok.select("path", "_s", "_shift_before", F.posexplode("_new").alias("_k", "line")).select(
        "path", (F.col("_s") + F.col("_shift_before") + F.col("_k")).cast("int").alias("line_no"), "line"
    )
    return kept.unionByName(added), status
