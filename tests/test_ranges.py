"""Line-range extraction and edits (merge), against slicing in Python."""

from pyspark.sql import functions as F

from textmill.operators import lines as L
from textmill.operators import ranges


def lines_df(spark, files):
    data = [(p, i + 1, t) for p, text in files.items() for i, t in enumerate(text.splitlines())]
    return spark.createDataFrame(data, "path string, line_no int, line string")


def apply(spark, files, edits):
    e = spark.createDataFrame(edits, "edit_id long, path string, start_line int, end_line int, snippet string")
    new_lines, status = ranges.apply_edits(lines_df(spark, files), e)
    joined = {r.path: r.text for r in L.join_lines(new_lines, ["path"]).collect()}
    return joined, {r.edit_id: r.error for r in status.collect()}


def py_merge(text, s, e, snippet):
    ls = text.splitlines()
    return "\n".join(ls[: s - 1] + snippet.splitlines() + ls[e:]) + "\n"


FILE = "l1\nl2\nl3\nl4\nl5"


def test_merge_middle_first_last(spark):
    for s, e in [(2, 3), (1, 1), (5, 5)]:
        got, st = apply(spark, {"f": FILE}, [(1, "f", s, e, "new a\nnew b")])
        assert got["f"] == py_merge(FILE, s, e, "new a\nnew b") and st[1] is None


def test_two_edits_in_one_file_use_original_numbers(spark):
    got, _ = apply(spark, {"f": FILE}, [(1, "f", 1, 1, "A\nA2"), (2, "f", 4, 5, "D")])
    assert got["f"] == "A\nA2\nl2\nl3\nD\n"


def test_overlapping_edits_are_rejected(spark):
    got, st = apply(spark, {"f": FILE}, [(1, "f", 1, 2, "X"), (2, "f", 2, 3, "Y"), (3, "f", 5, 5, "Z")])
    assert st[1] == st[2] == "overlapping edit" and st[3] is None
    assert got["f"] == "l1\nl2\nl3\nl4\nZ\n"


def test_bad_bounds_set_error(spark):
    got, st = apply(spark, {"f": FILE}, [(1, "f", 0, 1, "X"), (2, "f", 3, 2, "Y"), (3, "g", 1, 1, "Z")])
    assert st == {1: "invalid range", 2: "invalid range", 3: "file not found"}
    assert got["f"] == FILE + "\n"


def test_end_past_file_and_empty_replacement(spark):
    got, _ = apply(spark, {"f": FILE, "g": FILE}, [(1, "f", 4, 99, "T"), (2, "g", 2, 3, "")])
    assert got["f"] == py_merge(FILE, 4, 99, "T")
    assert got["g"] == py_merge(FILE, 2, 3, "")


def test_append_past_end(spark):
    got, _ = apply(spark, {"f": FILE}, [(1, "f", 50, 60, "tail")])
    assert got["f"] == py_merge(FILE, 50, 60, "tail")


def test_extract_ranges(spark):
    sel = spark.createDataFrame(
        [(1, "f", 2, 3), (2, "f", 4, 99), (3, "nope", 1, 1), (4, "f", 9, 10), (5, "f", 3, 2)],
        "sel_id long, path string, start_line int, end_line int")
    out = {r.sel_id: (r.snippet, r.error) for r in ranges.extract_ranges(lines_df(spark, {"f": FILE}), sel).collect()}
    ls = FILE.splitlines()
    assert out[1] == ("\n".join(ls[1:3]), None)
    assert out[2] == ("\n".join(ls[3:99]), None)
    assert out[3] == (None, "file not found")
    assert out[4] == ("", None)
    assert out[5] == (None, "invalid range")


def test_range_join_plan_has_no_nested_loop(spark):
    sel = spark.createDataFrame([(1, "f", 2, 3)], "sel_id long, path string, start_line int, end_line int")
    out = ranges.extract_ranges(lines_df(spark, {"f": FILE}), sel)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_split_join_round_trip(spark):
    texts = ["a\nb", "a\n\nb\n", "x", "one\r\ntwo"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    joined = {r.doc: r.text for r in L.join_lines(L.split_lines(df, "text"), ["doc"]).collect()}
    for i, t in enumerate(texts):
        assert joined[i] == "\n".join(t.splitlines()) + "\n"
    assert F  # keep import used


def test_random_edits_against_python(spark):
    import random

    rnd = random.Random(11)
    files, edits, expected = {}, [], {}
    eid = 0
    for f in range(25):
        n = rnd.randint(1, 30)
        text = "\n".join(f"f{f}l{i}" for i in range(1, n + 1))
        files[f"p{f}"] = text
        # non-overlapping edits in original numbering, applied by a forward walk
        cuts, pos = [], 1
        while pos <= n + 2 and len(cuts) < 4:
            s = pos + rnd.randint(0, 4)
            e = s + rnd.randint(0, 3)
            cuts.append((s, e, "\n".join(f"new{eid}_{k}" for k in range(rnd.randint(0, 3)))))
            pos = e + 1
        src, ls, cursor = text.splitlines(), [], 1
        for s, e, snip in sorted(cuts):
            s0, e0 = min(s, n + 1), min(e, n)
            ls += src[cursor - 1: s0 - 1] + snip.splitlines()
            cursor = max(cursor, e0 + 1)
        ls += src[cursor - 1:]
        expected[f"p{f}"] = "\n".join(ls) + "\n" if ls else None
        for s, e, snip in cuts:
            edits.append((eid, f"p{f}", s, e, snip))
            eid += 1
    got, st = apply(spark, files, edits)
    assert all(v is None for v in st.values())
    for p, want in expected.items():
        assert got.get(p) == want, p


def test_running_values_cross_pieces(spark, monkeypatch):
    # 60 edits of one file over many pieces: shifts and overlap checks must
    # carry across their borders
    monkeypatch.setattr(ranges, "PIECE_LINES", 16)
    text = "\n".join(f"l{i}" for i in range(1, 301))
    edits = [(i, "f", 5 * i + 1, 5 * i + 2, f"n{i}a\nn{i}b\nn{i}c") for i in range(60)]
    edits.append((100, "f", 299, 300, "end"))
    edits.append((101, "f", 7, 8, "clash"))  # overlaps edit 1 (lines 6-7)
    got, st = apply(spark, {"f": text}, edits)
    assert st[1] == st[101] == "overlapping edit"
    assert sum(v is None for v in st.values()) == 60
    ls, out, cursor = text.splitlines(), [], 1
    for _, _, s, e, snip in sorted((x for x in edits if x[0] not in (1, 101)), key=lambda x: x[2]):
        out += ls[cursor - 1: s - 1] + snip.splitlines()
        cursor = e + 1
    out += ls[cursor - 1:]
    assert got["f"] == "\n".join(out) + "\n"


def test_many_edits_of_one_file(spark):
    # every fourth line of 400,000 becomes two lines, every eighth is deleted
    n = 400_000
    lines = spark.range(1, n + 1).select(
        F.lit("big").alias("path"), F.col("id").cast("int").alias("line_no"), F.concat(F.lit("l"), F.col("id")).alias("line"))
    at = (F.col("id") * 4).cast("int")
    edits = spark.range(1, n // 4 + 1).select(
        F.col("id").alias("edit_id"), F.lit("big").alias("path"), at.alias("start_line"), at.alias("end_line"),
        F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("a"), at, F.lit("\nb"), at)).alias("snippet"))
    new, status = ranges.apply_edits(lines, edits)
    assert status.where("error is not null").count() == 0
    got = new.agg(F.count("*"), F.count_distinct("line_no"), F.max("line_no"), F.min("line_no")).first()
    assert tuple(got) == (n, n, n, 1)  # as many lines come as go
    # line 8k + 4 became two lines at its place, line 8k is gone
    k = F.regexp_extract("line", r"(\d+)", 1).cast("int")
    kind = F.substring("line", 1, 1)
    want = F.when(kind == "b", k + 1).otherwise(k) + F.when((k % 8 > 4) & (kind == "l"), 1).otherwise(0)
    assert new.where(F.col("line_no") != want).count() == 0


def test_empty_files_and_full_deletion(spark):
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "path string, line_no int, line string")
    files = spark.createDataFrame([("a", 2), ("b", 1), ("none", 0)], "path string, n_lines long")
    edits = spark.createDataFrame(
        [(1, "a", 1, 9, ""), (2, "none", 1, 1, "new"), (3, "gone", 1, 1, "x")],
        "edit_id long, path string, start_line int, end_line int, snippet string")
    new, status = ranges.apply_edits(lines, edits, files=files)
    assert {r["edit_id"]: r["error"] for r in status.collect()} == {1: None, 2: None, 3: "file not found"}
    assert sorted(map(tuple, new.collect())) == [("b", 1, "z"), ("none", 1, "new")]
    left = ranges.edited_files(lines, edits, files)
    assert {r["path"]: r["n_lines"] for r in left.collect()} == {"a": 0, "b": 1, "none": 1}


def test_dyadic_blocks_cover_ranges_once(spark):
    import random

    rng = random.Random(3)
    pairs = [(a, a + rng.choice([0, 1, 2, 5, 100, 9_000, 1 << 20])) for a in [0, 1, 2, 7, 8, 1023, 1024] + [rng.randrange(1 << 24) for _ in range(60)]]
    df = spark.createDataFrame(pairs, "lo long, hi long").select("lo", "hi", ranges.dyadic_cover(F.col("lo"), F.col("hi")).alias("c"))
    for r in df.collect():
        spans = sorted((b["index"] << b["level"], ((b["index"] + 1) << b["level"]) - 1) for b in r.c)
        assert spans[0][0] == r.lo and spans[-1][1] == r.hi and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) <= 2 * (r.hi - r.lo + 2).bit_length()


def test_long_and_short_ranges_of_a_long_file(spark):
    n = 40_000
    lines = spark.range(1, n + 1).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("line_no"), F.col("id").cast("string").alias("line"))
    wanted = [(1, 1, n), (2, 5, 5), (3, 1020, 1030), (4, 1024, 39_000), (5, 30_000, 10 * n), (6, 1, 1), (7, n + 1, n + 5)]
    sel = spark.createDataFrame([(i, "f", a, b) for i, a, b in wanted], "sel_id int, path string, start_line int, end_line int")
    out = {r.sel_id: (r.snippet, r.n_snippet_lines, r.error) for r in ranges.extract_ranges(lines, sel).collect()}
    for i, a, b in wanted:
        want = [str(x) for x in range(a, min(b, n) + 1)]
        assert out[i] == ("\n".join(want), len(want), None)
    assert ranges.extract_ranges(lines, sel.limit(0)).collect() == []
