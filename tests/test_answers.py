"""JSON answers: object check, returned files, notes, issues and reports."""

from textmill.operators import answers as A


def parsed(spark, items):
    return A.parse_answers(spark.createDataFrame(list(enumerate(items)), "key long, answer string"))


def test_parse_kinds(spark):
    p = parsed(spark, ['{"a": 1}', "[1, 2]", "3", "not json"])
    got = {r.key: (r.kind, r.error) for r in p.collect()}
    assert got == {0: ("object", None), 1: ("array", "not a JSON object"),
                   2: ("scalar", "not a JSON object"), 3: ("invalid", "invalid JSON")}


def test_converted_files_validation(spark):
    p = parsed(spark, [
        '{"files": [{"path": "a.ts", "content": "x"}], "notes": "ok"}',      # good
        '{"files": [{"path": 12, "content": "x"}, {"path": "b.ts"}], "notes": 42}',  # numeric path, missing content
        '{"files": []}',                                                  # empty list
        '{"files": {"path": "c"}}',                                       # not a list
        '{"files": ["oops", {"path": "d.go", "content": ""}]}',           # non-object entry dropped
    ])
    f = sorted((r.key, r.pos, r.path, r.content) for r in A.converted_files(p).collect())
    assert f == [(0, 0, "a.ts", "x"), (4, 1, "d.go", "")]
    notes = {r.key: r.n for r in p.select("key", A.answer_notes(p).alias("n")).collect()}
    assert notes[0] == "ok" and notes[1] == "42" and notes[2] == ""


def test_issue_report(spark):
    p = parsed(spark, [
        '{"summary": "s", "issues": ['
        '{"type": "unused", "file": "requirements.txt", "detail": "d1", "suggestion": "s1"},'
        '{"type": "bogus", "file": "gone.txt", "detail": "d2", "suggestion": "s2"},'
        '{"type": "missing", "file": "requirements.txt", "detail": "d3", "suggestion": "s3"},'
        '{"type": "other", "file": "", "detail": "d4", "suggestion": "s4"}]}',
        '{"summary": "none"}',
    ])
    it = A.issues_table(p)
    assert sorted((r.pos, r.type_ok) for r in it.collect()) == [(0, True), (1, False), (2, True), (3, True)]
    files = spark.createDataFrame([(0, "requirements.txt")], "key long, path string")
    rep = {r.file: r for r in A.issue_report(it, files).collect()}
    assert set(rep) == {"requirements.txt", "gone.txt"}
    assert rep["gone.txt"].status == "skipped" and rep["requirements.txt"].status == "ok"
    assert rep["requirements.txt"].report.startswith("#1 unused\n  what: d1")
    assert "#2 missing" in rep["requirements.txt"].report
    counts = {r.type: r.n for r in A.issue_counts(it).collect()}
    assert counts == {"unused": 1, "bogus": 1, "missing": 1, "other": 1}
