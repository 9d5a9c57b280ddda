"""Scopes of conversion requests and the union of the dependency checks."""

from textmill.operators.requests import resolve_scope


def test_resolve_scope(spark):
    files = spark.createDataFrame([("src/a.py",), ("src/lib/b.py",), ("top.py",)], "path string")
    cases = [
        ("src/a.py", "auto", "file", 1, None), ("./src/", "auto", "project", 2, None), (".", "project", "project", 3, None),
        ("src/lib", "file", None, 0, "not a file"), ("src/a.py", "project", "project", 2, None), ("top.py", "project", "project", 3, None),
        ("gone", "auto", None, 0, "no such path"), ("", "auto", "project", 3, None), (None, "auto", None, 0, "no such path"),
    ]
    df = spark.createDataFrame([(i, p, s) for i, (p, s, *_) in enumerate(cases)], "i int, path string, scope string")
    got = {r.i: (r.target, r.n_files, r.scope_error) for r in resolve_scope(df, files).collect()}
    assert got == {i: tuple(c[2:]) for i, c in enumerate(cases)}


def test_two_approval_rounds_keep_the_first(spark, tmp_path):
    from textmill.operators.rewrite import read_written, write_approved

    ch = spark.createDataFrame([("p", "a", "x", "y"), ("p", "b", "1", "2"), ("p", "c", "1", "3")],
                               "project string, path string, old string, new string")
    out = str(tmp_path / "out")
    for path in ("a", "b"):
        ap = spark.createDataFrame([("p", path, True), ("p", path, True), ("p", "c", True), ("p", "c", False)],
                                   "project string, path string, approved boolean")
        assert write_approved(ch, ap, out, dry_run=False).count() == 3
    assert sorted((r.path, r.content) for r in read_written(spark, out).collect()) == [("a", "y"), ("b", "2")]
