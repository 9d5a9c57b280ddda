"""Batch inference, prompts and the rewrite flows with deterministic stubs."""

import pytest
from pyspark.sql import functions as F

from textmill.operators import infer, prompts, rewrite
from textmill.operators import lines as L
from textmill.plans import stubs


def test_prompt_defaults(spark):
    df = spark.createDataFrame([("a.py", "x = 1", "", None, "style", None)],
                               "path string, code string, instruction string, global_instruction string, "
                               "kind string, summary string")
    p = prompts.render_prompts(df, "snippet").first()
    assert "Note for this selection: N/A" in p.user_prompt and "Overall guidance: N/A" in p.user_prompt
    assert prompts.CODE_OPEN + "x = 1" + prompts.CODE_CLOSE in p.user_prompt
    conv = spark.createDataFrame([("py", "go", "d", None, "blk")],
                                 "src_lang string, tgt_lang string, target_stack_desc string, summary string, "
                                 "files_block string")
    assert "(no summary provided)" in prompts.render_prompts(conv, "convert").first().user_prompt


def test_errors_stay_on_their_row(spark):
    def flaky_factory():
        def predict(systems, users):
            out = []
            for u in users:
                if "boom" in u:
                    raise RuntimeError("boom")
                out.append(None if "empty" in u else u.upper())
            return out
        return predict

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ok", "boom", "empty", "ok"])], "id long, u string")
    df = df.withColumn("s", F.lit("sys"))
    got = {r.id: (r.answer, r.error) for r in infer.batch_infer(df, flaky_factory, "s", "u").collect()}
    assert got[0] == ("OK", None) and got[3] == ("OK", None)
    assert got[1][0] is None and got[1][1].startswith("model error")
    assert got[2] == (None, "empty answer")


def test_identical_prompts_answered_once(spark, tmp_path):
    log = tmp_path / "calls"

    def factory():
        def predict(systems, users):
            with open(log, "a") as f:
                f.write("".join(u + "\n" for u in users))
            return [u for u in users]
        return predict

    df = spark.createDataFrame([(i, "same") for i in range(50)] + [(99, "other")], "id long, u string")
    out = infer.batch_infer(df.withColumn("s", F.lit("x")), factory, "s", "u")
    assert out.count() == 51
    assert sorted(log.read_text().splitlines()) == ["other", "same"]


def test_partial_rewrite_applies_the_preview(spark):
    text = "keep\nthe one\nthe two\nend"
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text.splitlines())],
                                  "path string, line_no int, line string")
    sel = spark.createDataFrame([(1, "f", 2, 3), (2, "g", 1, 1)], "sel_id long, path string, start_line int, "
                                                                   "end_line int")
    res, new_lines = rewrite.partial_rewrite(lines, sel, stubs.replace_stub(), dry_run=False)
    r = {x.sel_id: x for x in res.collect()}
    assert r[1].refactored_snippet == "THE one\nTHE two" and r[1].applied
    assert r[2].error == "file not found" and not r[2].applied
    assert L.join_lines(new_lines, ["path"]).first().text == "keep\nTHE one\nTHE two\nend\n"
    dry, none = rewrite.partial_rewrite(lines, sel, stubs.replace_stub(), dry_run=True)
    assert none is None and not any(x.applied for x in dry.collect())


def test_write_approved(spark, tmp_path):
    ch = spark.createDataFrame([("p", "a", "x", "y"), ("p", "b", "x", "x"), ("p", "c", "1", "2")],
                               "project string, path string, old string, new string")
    ap = spark.createDataFrame([("p", "a", True), ("p", "c", False)], "project string, path string, approved boolean")
    dry = {r.path: r.status for r in rewrite.write_approved(ch, ap).collect()}
    assert dry == {"a": "would write", "b": "unchanged", "c": "rejected"}
    out = str(tmp_path / "v2")
    rewrite.write_approved(ch, ap, out=out, dry_run=False).collect()
    written = spark.read.parquet(out).collect()
    assert [(r.path, r.content, r.project) for r in written] == [("a", "y", "p")]


def test_place_outputs(spark):
    conv = spark.createDataFrame([(1, 0, "x/test.ts", "c"), (1, 1, "y.ts", "d"), (2, 0, "noext", "e"),
                                  (3, 0, "ok/a.go", "f"), (3, 1, "../evil", "g"), (3, 2, "/abs", "h")],
                                 "key long, pos long, path string, content string")
    orig = spark.createDataFrame([(1, "src/test.py", "proj", True), (2, "src/m.py", "proj", True),
                                  (3, "src", "proj", False)],
                                 "key long, orig_path string, root string, single boolean")
    got = {(r.key, r.pos): (r.target_path, r.action, r.error)
           for r in rewrite.place_outputs(conv, orig, "C++ 14").collect()}
    assert got[(1, 0)] == ("src/test.ts", "rename", None) and (1, 1) not in got
    assert got[(2, 0)] == ("src/m.py", "replace", None)
    assert got[(3, 0)] == ("proj_converted_to_C___14/ok/a.go", "write", None)
    assert got[(3, 1)][2] == got[(3, 2)][2] == "unsafe path"


def test_json_mode(spark):
    def factory():
        def predict(systems, users):
            return ['{"files": []}' if u == "good" else "[1]" for u in users]
        return predict

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, u string").withColumn("s", F.lit("x"))
    got = {r.id: (r.error, r.answer_json is not None) for r in infer.batch_infer(df, factory, "s", "u", json=True)
           .collect()}
    assert got == {1: (None, True), 2: ("answer is not a JSON object", False)}


def test_row_path_without_dedupe(spark):
    def factory():
        def predict(systems, users):
            if any("boom" in u for u in users):
                raise RuntimeError("boom")
            return [u[::-1] for u in users]
        return predict

    df = spark.createDataFrame([(1, "abc"), (2, "boom"), (3, None)], "id long, u string").withColumn("s", F.lit("x"))
    got = {r.id: (r.answer, r.error) for r in infer.batch_infer(df, factory, "s", "u", dedupe=False).collect()}
    assert got[1] == ("cba", None) and got[3] == (None, None)
    assert got[2][0] is None and got[2][1].startswith("model error")


def test_convert_projects(spark):
    files = spark.createDataFrame([("p", "a.py", "the x", "python"), ("p", "pkg/b.py", "y", "python"),
                                   ("q", "c.py", "z", "python")],
                                  "project string, path string, content string, language string")
    out, notes = rewrite.convert_projects(files, "python", "Type Script", stubs.convert_stub(".ts"))
    got = sorted((r.project, r.pos, r.target_path, r.content) for r in out.collect())
    assert got == [("p", 0, "p_converted_to_Type_Script/a.ts", "THE x"),
                   ("p", 1, "p_converted_to_Type_Script/pkg/b.ts", "y"),
                   ("q", 0, "q_converted_to_Type_Script/c.ts", "z")]
    assert {r.project: r.notes for r in notes.collect()} == {"p": "2 files converted", "q": "1 files converted"}

    def bad_factory():
        return lambda systems, users: ["[1, 2]" for _ in users]

    _, bad = rewrite.convert_projects(files, "python", "go", bad_factory)
    assert {r.error for r in bad.collect()} == {"not a JSON object"}


def test_every_template_renders(spark):
    import string

    fields = set()
    for system, user in prompts.TEMPLATES.values():
        for t in (system, user):
            fields |= {n for _, n, _, _ in string.Formatter().parse(t) if n}
    row = {f: f"<{f}>" for f in sorted(fields)}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{f} string" for f in row))
    for task in prompts.TEMPLATES:
        r = prompts.render_prompts(df, task).first()
        assert r.system_prompt and r.user_prompt and "{" not in r.user_prompt.replace("{{", "")
        for f in fields:
            if "{" + f + "}" in prompts.TEMPLATES[task][1]:
                assert f"<{f}>" in r.user_prompt
    import pytest

    with pytest.raises(ValueError):
        prompts.render_prompts(df, "nope")


def test_a_store_is_asked_first(spark, tmp_path):
    log, store = tmp_path / "asked", str(tmp_path / "store")

    def factory(fail, poison=None):
        def make():
            def predict(systems, users):
                if fail and poison in users:
                    raise SystemExit("lost")  # no error of a row: it ends the task
                with open(log, "a") as f:
                    f.write("".join(u + "\n" for u in users))
                return [None if u == "q3" else u.upper() for u in users]
            return predict
        return make

    def asked():
        out = log.read_text().split() if log.exists() else []
        log.unlink(missing_ok=True)
        return sorted(out)

    df = spark.range(20).select("id", F.lit("s").alias("s"), F.concat(F.lit("q"), (F.col("id") % 10).cast("string")).alias("u"))
    batch = F.pmod(F.xxhash64(F.sha2(F.concat_ws("\u0000", "s", "u"), 256)), F.lit(5))
    poison = df.orderBy(batch.desc()).first().u  # in the last of five batches
    df = df.unionByName(spark.createDataFrame([(99, "s", None)], df.schema))
    with pytest.raises(Exception):  # the worker is gone, and so is the job
        infer.batch_infer(df, factory(True, poison), "s", "u", store=store, store_batch=2)
    first = set(asked())
    kept = {r.answer for r in infer.stored(spark, store).collect() if r.answer}
    assert 0 < len(kept) < 10
    rows = infer.batch_infer(df, factory(False), "s", "u", store=store, store_batch=4).collect()
    second = asked()
    # what the first run stored is not asked again; a prompt without an answer is
    assert set(second) == {f"q{i}" for i in range(10)} - {a.lower() for a in kept} and first <= {f"q{i}" for i in range(10)}
    by = {r.id: (r.answer, r.error) for r in rows}
    assert len(rows) == 21 and by[99] == (None, None) and by[13] == (None, "empty answer") and by[17] == ("Q7", None)
    again = infer.batch_infer(df, factory(False), "s", "u", store=store).collect()
    assert asked() == ["q3"] and {r.id: r.answer for r in again} == {r.id: r.answer for r in rows}
