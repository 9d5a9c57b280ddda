"""Maximal repeated runs against the definition, in plain Python."""

import hashlib
import random

import pytest

from textmill.operators.repeats import repeated_runs, run_places


def brute(files, k):
    """files: {path: [lines]}"""
    count = {}
    for lines in files.values():
        for size in (k, k + 1):
            for i in range(len(lines) - size + 1):
                block = tuple(lines[i:i + size])
                count[block] = count.get(block, 0) + 1
    runs = {}
    for path, lines in files.items():
        i = 0
        while i + k <= len(lines):
            u = tuple(lines[i:i + k])
            if count[u] < 2:
                i += 1
                continue
            j = i
            while j + k < len(lines):
                a, b, both = tuple(lines[j:j + k]), tuple(lines[j + 1:j + 1 + k]), tuple(lines[j:j + k + 1])
                if not (count[a] == count[b] == count[both]):
                    break
                j += 1
            runs.setdefault(u, []).append((path, i + 1, j - i + k))
            i = j + 1
    return sorted((p, at, n, hashlib.sha256("\n".join(u).encode()).hexdigest(), len(found))
                  for u, found in runs.items() for p, at, n in found)


def frame(spark, files):
    rows = [(p, i + 1, line) for p, lines in files.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "path string, line_no int, line string").repartition(3)


def found(df):
    return sorted((r.path, r.first_line, r.n_lines, r.block_hash, r.n) for r in df.collect())


def test_a_copied_function_is_one_row(spark):
    body = [f"line {i}" for i in range(200)]
    files = {"a": ["x", *body, "y"], "b": ["p", "q", *body], "c": ["z", *body[50:60], "w"]}
    runs = sorted((r.n_lines, r.n, r.first_path, r.first_line) for r in repeated_runs(frame(spark, {p: files[p] for p in "ab"})).collect())
    assert runs == [(200, 2, "a", 2)]
    runs = sorted((r.first_line, r.n_lines, r.n) for r in repeated_runs(frame(spark, files)).collect())
    assert runs == [(2, 51, 2), (52, 10, 3), (61, 141, 2)]


@pytest.mark.parametrize("k,bucket", [(1, 4), (2, 3), (2, 1024), (3, 5), (5, 2)])
def test_equals_the_definition(spark, k, bucket):
    rng = random.Random(k * 100 + bucket)
    files = {f"f{i}": [rng.choice("abcd") if rng.random() < 0.5 else f"u{rng.random()}" for _ in range(rng.randrange(60))] for i in range(12)}
    files["copy"] = files["f3"] + ["tail"] + files["f4"][5:]
    files["same"] = ["again"] * 25
    files["wave"] = ["up", "down"] * 10
    files["blank"] = ["", "", "", "x", "", ""]
    assert found(run_places(frame(spark, files), k, bucket)) == brute(files, k)


def test_gaps_nulls_and_empty_input(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 4, "z"), ("b", 1, "x"), ("b", 2, "y"), ("b", 3, "z"),
            (None, 7, "x"), (None, 8, "y"), ("c", 1, "x"), ("c", 2, None), ("c", 3, "y")]
    df = spark.createDataFrame(rows, "path string, line_no int, line string")
    got = sorted(((r.path, r.first_line, r.n_lines, r.n) for r in run_places(df).collect()), key=repr)
    assert got == [("a", 1, 2, 3), ("b", 1, 2, 3), (None, 7, 2, 3)]
    assert run_places(df.limit(0)).collect() == [] and repeated_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        run_places(df, 0)


def test_runs_longer_than_a_piece(spark):
    n = 70_000
    df = spark.range(2 * n).selectExpr("if(id < %d, 'a', 'b') path" % n, "id %% %d + 1 line_no" % n, "concat('l', id %% %d) line" % n)
    assert [(r.n_lines, r.n, r.first_path, r.first_line) for r in repeated_runs(df, 3).collect()] == [(n, 2, "a", 1)]
