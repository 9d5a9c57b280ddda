"""Lexical states against a scanner that reads character by character."""

import random

from textmill.operators import deps as D
from textmill.operators import hygiene as H
from textmill.operators.lexical import code_lines

MARKS = {1: "'''", 2: '"""', 3: "'", 4: '"'}
OF = {m: s for s, m in MARKS.items()}


def scan(line, state):
    """(code without comments and strings, the next state); f-strings of one line stay."""
    out, i, n = [], 0, len(line)
    if state in MARKS:
        i = close(line, 0, MARKS[state])
        if i is None:
            goes_on = state < 3 or (len(line) - len(line.rstrip("\\"))) % 2 == 1
            return "", state if goes_on else 0
    while i < n:
        word = i == 0 or not (line[i - 1].isalnum() or line[i - 1] == "_")
        pre = 0
        if word:
            for size in (2, 1):
                head = line[i:i + size]
                if len(head) == size and head.isalpha() and set(head.lower()) <= set("rbuf") and line[i + size:i + size + 1] in ("'", '"'):
                    pre = size
                    break
        kept = "f" in line[i:i + pre].lower()
        if kept and line[i:i + pre].lower() not in ("f", "fr", "rf"):
            kept = False
        at = i + pre
        if line[i] == "#":
            return "".join(out) + " ", 0
        if line[at:at + 1] in ("'", '"') and (pre == 0 or kept or set(line[i:at].lower()) <= set("rbu")):
            mark = line[at] * 3 if line.startswith(line[at] * 3, at) else line[at]
            end = close(line, at + len(mark), mark)
            if end is None:
                tail = line[at + len(mark):]
                goes_on = len(mark) == 3 or (len(tail) - len(tail.rstrip("\\"))) % 2 == 1
                return "".join(out) + (line[i:] if kept else "") + " ", OF[mark] if goes_on else 0
            out.append((line[i:end] if kept else "") + " ")
            i = end
        else:
            out.append(line[i])
            i += 1
    return "".join(out), 5 if line.endswith("\\") else 0


def close(line, i, mark):
    while i < len(line):
        if line[i] == "\\":
            i += 2
        elif line.startswith(mark, i):
            return i + len(mark)
        else:
            i += 1
    return None


def brute(lines):
    out, state = [], 0
    for line in lines:
        code, after = scan(line or "", state)
        out.append((state, code))
        state = after
    return out


PARTS = ["'''", '"""', "'", '"', "\\", "#", "a", "f'{x}'", ' f"', "r'", "b", " = ", "\\'", '\\"', "name1", "import os", "''", '""']


def test_states_equal_a_scanner(spark):
    rng = random.Random(5)
    files = {f"f{i}": ["".join(rng.choice(PARTS) for _ in range(rng.randrange(7))) for _ in range(rng.choice([1, 30, 700]))] for i in range(15)}
    files["long"] = ["x = '" + "a\\'" * 30_000, '"""' + "é" * 50_000, "#" * 9, '""" + y']
    files["null"] = ["a = '''", None, "b''' + c"]
    rows = [(p, i + 1, t) for p, lines in files.items() for i, t in enumerate(lines)]
    got = {}
    df = spark.createDataFrame(rows, "path string, line_no int, line string").repartition(5)
    for r in code_lines(df).collect():
        got[r.path, r.line_no] = (r.state, r.code)
    for p, lines in files.items():
        for i, want in enumerate(brute(lines)):
            assert got[p, i + 1] == want, (p, i, lines[max(0, i - 1):i + 1])


def test_a_string_over_many_pieces(spark):
    n = 140_000  # more than two blocks of pieces
    df = spark.range(1, n + 1).selectExpr(
        "'p' path", "id line_no", f"CASE id WHEN 3 THEN 'doc = \"\"\"' WHEN {n - 2} THEN 'end \"\"\"; z = 1' ELSE concat('v', id) END line")
    by = {r.state: r.n for r in code_lines(df).groupBy("state").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert by == {0: 5, 2: n - 5}


def test_names_in_comments_and_strings_are_no_code(spark):
    src = ['"""module about helper', "import nothing", '"""', "import os, sys  # import re", "import json", "def helper(x):", "    '''calls helper'''",
           "    return x", "# helper(1)", "text = 'json'", "print(f'{text}')", "y = 1 + \\", "  2", "print(os, sys)"]
    df = spark.createDataFrame([("p", "a.py", i + 1, t) for i, t in enumerate(src)], "project string, path string, line_no int, line string")
    assert sorted(r.module for r in D.extract_imports(df).collect()) == ["json", "os", "sys"]
    assert sorted(r.name for r in H.unused_definitions(df).collect()) == ["helper", "json", "y"]


def test_equal_numbers_nulls_and_empty(spark):
    rows = [(None, 1, "a = '''"), (None, 2, "b"), (None, 2, "c"), (None, 9, "'''"), ("q", 1, "x")]
    df = spark.createDataFrame(rows, "path string, line_no int, line string")
    assert sorted((r.line_no, r.state, r.code) for r in code_lines(df).collect()) == [
        (1, 0, "a =  "), (1, 0, "x"), (2, 1, ""), (2, 1, ""), (9, 1, "")]
    gap = spark.createDataFrame([("g", 1, "a = 1 + \\"), ("g", 3, "b"), ("g", 4, "c = 2 + \\"), ("g", 5, "d")], df.schema)
    assert [r.state for r in code_lines(gap).orderBy("line_no").collect()] == [0, 0, 0, 5]
    assert code_lines(df.limit(0)).collect() == []


def test_files_without_strings_meet_no_runs(spark):
    """Files in which no line starts inside a string need no join, beside others that do."""
    from textmill.operators.lexical import code_lines

    plain = [("a.py", 1, "import a"), ("a.py", 2, "x = 'import b'")]
    opened = [("b.py", 1, 't = """'), ("b.py", 2, "import c"), (None, 1, "import d")]
    schema = "path string, line_no int, line string"
    alone = code_lines(spark.createDataFrame(plain, schema), only="import")
    assert "Join" not in alone._jdf.queryExecution().executedPlan().toString()
    both = code_lines(spark.createDataFrame(plain + opened, schema), only="import")
    assert sorted(((r.path, r.state, r.code) for r in both.collect()), key=repr) == [
        ("a.py", 0, "import a"), ("a.py", 0, "x =  "), ("b.py", 2, ""), (None, 0, "import d")]
    assert sorted((r.path, r.code) for r in alone.collect()) == [("a.py", "import a"), ("a.py", "x =  ")]
