"""Request sessions, routing and typed tool specs."""

from textmill.operators import requests as R


def session(spark, texts):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "session long, turn long, text string")
    return [r.text for r in R.session_requests(df).orderBy("turn").collect()]


def test_exit_quit_blank(spark):
    assert session(spark, ["a", " Exit ", "b"]) == ["a"]
    assert session(spark, ["quit"]) == []
    assert session(spark, ["   ", "exit"]) == []
    assert session(spark, ["a", "", "b"]) == ["a", "b"]


def test_routing(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([
        "refactor lines 10~20 of a.py", "remove dead code", "translate to go", "check package versions",
        "please simplify", "explain this", "hello"])], "id long, text string")
    got = {r.id: (r.tool, r.start_line, r.end_line) for r in R.route_requests(df).collect()}
    assert got[0] == ("refactor_partial", 10, 20)
    assert [got[i][0] for i in range(1, 7)] == ["refactor_dead_code", "convert_language", "deps_analyze",
                                                "refactor_simplify", "analyze", None]


def test_normalize(spark):
    bodies = [
        '{"tool": "refactor_partial", "path": "a.py", "start_line": "3"}',
        '{"tool": "nope"}',
        '{"tool": "convert_language", "tgt_lang": "go"}',
        '{"tool": "analyze", "summary": "false"}',
        '{"tool": "refactor_partial", "start_line": "ten"}',
        "[1]",
        '{"tool": "convert_language", "src_lang": "python", "tgt_lang": "go"}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    got = {r.id: r for r in R.normalize_requests(df).collect()}
    assert (got[0].start_line, got[0].end_line, got[0].kind, got[0].error) == (3, 3, "custom", None)
    assert got[1].error == "unknown tool"
    assert got[2].error == "src_lang and tgt_lang are required"
    assert got[3].error == "summary must be a boolean"  # bool("false") is True in the reference
    assert got[4].error == "start_line is not an integer"
    assert got[5].error == "not a JSON object"
    assert got[6].error is None and "go" in got[6].target_stack_desc and got[6].scope == "auto"
