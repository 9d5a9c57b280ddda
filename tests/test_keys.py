"""Null and repeated keys: no row is lost or multiplied."""

from textmill.operators.corpus import build_snapshot, files_block, head_text
from textmill.operators.rewrite import read_written, write_approved

FILES = [("p", "a.py", "one"), ("p", "b.py", "two"), ("p", "b.py", "two again"), (None, "c.py", "three"), (None, "d.py", None), ("q", None, "four")]


def test_blocks_and_snapshots_hold_each_file_once(spark):
    f = spark.createDataFrame(FILES, "project string, path string, content string")
    for size in (1, 1 << 20):
        assert {(r.project, sum(x.n_files for x in files_block(f, size).collect() if x.project == r.project)) for r in files_block(f, size).collect()} == {
            ("p", 3), (None, 2), ("q", 1)}
        held = [(r.root, x.path, x.content) for r in build_snapshot(f, "py", "go", size).collect() for x in r.files]
        assert sorted(held, key=repr) == sorted(FILES, key=repr)
    assert files_block(f.limit(0)).collect() == []


def test_head_text_of_a_null_project(spark):
    f = spark.createDataFrame(FILES, "project string, path string, content string").where("path is not null")
    assert sorted(((r.project, r.head) for r in head_text(f).collect()), key=repr) == [("p", "one"), (None, "three")]


def test_versions_are_numbers_and_projects_text(spark, tmp_path):
    out = str(tmp_path / "w")
    ch = spark.createDataFrame([("007", "a", "x", "old"), (None, "b", "x", "n")], "project string, path string, old string, new string")
    ok = spark.createDataFrame([("007", "a", True), (None, "b", True)], "project string, path string, approved boolean")
    for version, text in (("9", "nine"), ("10", "ten")):
        done = write_approved(ch.selectExpr("project", "path", "old", f"'{text}' new"), ok, out, dry_run=False, version=version)
        assert [r.status for r in done.collect()] == ["written", "written"]
    got = sorted(((r.project, r.path, r.version, r.content) for r in read_written(spark, out).collect()), key=repr)
    assert got == [("007", "a", "10", "ten"), (None, "b", "10", "ten")]
