"""File tree source, UTF-8 decode, exclusion and corpus caps."""

import os

import pytest
from pyspark.sql import functions as F

from textmill.operators import corpus
from textmill.sources import files as S


@pytest.fixture()
def tree(tmp_path):
    def w(rel, data):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())

    w("main.py", "print(1)\n")
    w("pkg/__init__.py", "")
    w(".env", "KEY=1\n")
    w("pkg/mod.py", "a\r\nb\r\n")
    w("node_modules/x.js", "x")
    w("dist/y.js", "y")
    w(".git/HEAD", "ref")
    w("pkg/__pycache__/m.pyc", b"\x00\xff")
    w("data/bad.txt", b"\xff\xfe\x00bad")
    w("data/big.txt", "z" * 1000)
    w("data/limit.txt", "q" * 500)
    for i in range(10):
        w(f"many/f{i}.txt", str(i))
    return tmp_path


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_folder_lists_hidden_and_underscore_names(spark, tree):
    got = paths(S.scan_files(spark, str(tree)))
    assert ".env" in got and "pkg/__init__.py" in got and "main.py" in got
    assert not any(p.startswith(("node_modules/", "dist/")) for p in got)


def test_corpus_exclusions_and_caps(spark, tree):
    files = S.scan_files(spark, str(tree))
    got = corpus.collect_corpus(files, max_files=40, max_bytes=500)
    names = paths(got)
    assert "data/big.txt" not in names           # 1,000 bytes at a limit of 500
    assert "data/limit.txt" in names             # equal to the limit is kept
    assert "data/bad.txt" not in names           # not UTF-8
    assert not any(".git" in p or "__pycache__" in p for p in names)
    capped = corpus.collect_corpus(files.filter(F.col("path").startswith("many/")), max_files=3)
    assert paths(capped) == ["many/f0.txt", "many/f1.txt", "many/f2.txt"]  # cap of 3 in 10


def test_read_text_decodes_and_normalises(spark, tree):
    t = S.read_text(S.scan_files(spark, str(tree)))
    got = {r.path: (r.text, r.error) for r in t.collect()}
    assert got["pkg/mod.py"] == ("a\nb\n", None)
    assert got["data/bad.txt"] == (None, "not UTF-8")
    assert got["main.py"][0] == "print(1)\n"


def test_single_file_glob_and_missing(spark, tree):
    assert paths(S.scan_files(spark, str(tree / "main.py"))) == ["main.py"]
    g = paths(S.scan_files(spark, str(tree / "many" / "f[0-2].txt")))
    assert [os.path.basename(p) for p in g] == ["f0.txt", "f1.txt", "f2.txt"]
    with pytest.raises(FileNotFoundError):
        S.scan_files(spark, str(tree / "does-not-exist"))


def test_empty_folder_and_all_filtered(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert S.scan_files(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "only" / "dist").mkdir(parents=True)
    (tmp_path / "only" / "dist" / "a.js").write_text("a")
    assert S.scan_files(spark, str(tmp_path / "only")).count() == 0


def test_exclude_relative_paths_only(spark, tmp_path):
    root = tmp_path / "build" / "proj"  # an ancestor named build does not hide the project
    root.mkdir(parents=True)
    (root / "a.py").write_text("a")
    assert paths(S.scan_files(spark, str(root))) == ["a.py"]


def test_size_filter_reaches_binary_scan(spark, tree):
    df = S.fast_scan(spark, str(tree), max_bytes=500)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "length" in plan and ("PushedFilters" in plan or "DataFilters" in plan)


def test_large_flat_folder_is_sharded(spark, tmp_path):
    for i in range(50):
        (tmp_path / f"f{i:02d}.txt").write_text(str(i))
    S.register(spark)
    df = spark.read.format("filetree").options(path=str(tmp_path), project="p", exclude="",
                                               files_per_partition="10").load()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(r.path for r in df.collect()) == [f"f{i:02d}.txt" for i in range(50)]
