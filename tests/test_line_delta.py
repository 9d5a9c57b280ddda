"""Line deltas: both sides come back, and the anchors are those of a plain patience diff."""

import random
import re
from bisect import bisect_left

import pandas as pd

from textmill.operators.line_delta import line_delta, numbered, matches, piles
from textmill.operators.versions import restore_side


def lines_of(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text or "")


def patience(a, b, i0=0, j0=0):
    """Kept pairs (numbers from 1) of two lists of lines."""
    out, i, j = [], 0, 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        out.append((i0 + i + 1, j0 + i + 1))
        i += 1
    n, m = len(a), len(b)
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
        out.append((i0 + n + 1, j0 + m + 1))
    x, y = a[i:n], b[i:m]
    once = [(p, y.index(line)) for p, line in enumerate(x) if x.count(line) == 1 and y.count(line) == 1]
    best = []  # longest increasing run, by dynamic programming
    for p, q in once:
        before = [r for (pp, qq), r in zip(once, best) if pp < p and qq < q]
        best.append(max(before, key=len, default=[]) + [(p, q)])
    run = max(best, key=len, default=[])
    if not run:
        return out
    marks = [(-1, -1), *run, (len(x), len(y))]
    out += [(i0 + i + p + 1, j0 + i + q + 1) for p, q in run]
    for (p, q), (pp, qq) in zip(marks, marks[1:]):
        out += patience(x[p + 1:pp], y[q + 1:qq], i0 + i + p + 1, j0 + i + q + 1)
    return out


def frame(spark, cases):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in cases.items()], "path string, old string, new string")


def check(spark, cases):
    v = frame(spark, cases)
    delta = line_delta(v)
    sides = {s: {r.path: r.text for r in restore_side(delta, s).collect()} for s in (1, 2)}
    for k, (a, b) in cases.items():
        assert sides[1].get(k, "") == (a or "") and sides[2].get(k, "") == (b or ""), k


def test_sides_come_back(spark):
    rng = random.Random(2)
    cases = {
        "same": ("a\nb\n", "a\nb\n"), "null_old": (None, "x\ny"), "null_new": ("x\n", None), "empty": ("", "z\n"), "both_empty": ("", ""),
        "no_end": ("a\nb", "a\nb\n"), "repeat": ("x\n" * 9, "x\n" * 4), "swap": ("a\nb\n", "b\na\n"), "tags": ("- a\n+ b\n", "+ b\n- a\n  c\n"),
        "all_new": ("a\nb\n", "c\nd\n"), "cr": ("a\r\nb\r\n", "a\r\nc\r\n"), "blank": ("\n\n\na\n", "\n\na\n\n"), "null": (None, None),
    }
    for i in range(25):
        a = [rng.choice("abcdefgh") * rng.randrange(1, 3) + "\n" if rng.random() < 0.6 else f"u{rng.random()}\n" for _ in range(rng.randrange(60))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            if rng.random() < 0.4:
                b[at:at + rng.randrange(6)] = []
            elif rng.random() < 0.6:
                b[at:at] = [f"n{rng.random()}\n"] * rng.randrange(1, 3)
            else:
                cut = b[at:at + 5]
                b[at:at + 5] = []
                b += cut
        cases[f"r{i}"] = ("".join(a), "".join(b))
    check(spark, cases)
    v = frame(spark, cases)
    changed = v.where("not (old <=> new)")
    pairs, _ = matches(numbered(changed, ["path"], "old"), numbered(changed, ["path"], "new"))
    got = {}
    for r in pairs.collect():
        got.setdefault(r.f.path, []).append((r.i, r.j))
    equal = 0
    for k, (a, b) in cases.items():
        if a == b:
            continue
        found, want = sorted(got.get(k, [])), sorted(patience(lines_of(a), lines_of(b)))
        x, y = lines_of(a), lines_of(b)
        assert all(x[i - 1] == y[j - 1] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        if not k.startswith("r") or found == want:  # of several longest runs any one may be taken
            assert len(found) == len(want), k
            equal += 1
        else:
            assert abs(len(found) - len(want)) <= 0.2 * len(want) + 2, k


    assert equal > 25


def test_a_long_file_with_a_moved_block(spark):
    a = [f"line {i}\n" for i in range(3000)]
    b = a[:500] + a[1000:2500] + a[500:1000] + ["new\n"] + a[2500:2990]
    v = frame(spark, {"f": ("".join(a), "".join(b))})
    delta = line_delta(v)
    by = {r.tag: r["count"] for r in delta.selectExpr("substring(line, 1, 2) tag").groupBy("tag").count().collect()}
    assert by == {"  ": 2490, "- ": 510, "+ ": 501}
    assert restore_side(delta, 2).first().text == "".join(b) and restore_side(delta, 1).first().text == "".join(a)


def test_piles_give_a_longest_run():
    rng = random.Random(1)
    for n in (0, 1, 5, 40):
        js = rng.sample(range(100), n)
        got = piles(pd.DataFrame({"gap": 0, "i": range(n), "j": js}))
        tops = []
        for j in js:
            k = bisect_left(tops, j)
            tops[k:k + 1] = [j]
        assert len(got) == len(tops) and got["j"].is_monotonic_increasing and got["i"].is_monotonic_increasing


def test_keys_and_empty_input(spark):
    v = spark.createDataFrame([("p", None, "a\n", "b\n"), (None, "x", "a\nb\n", "b\n")], "project string, path string, old string, new string")
    out = sorted(((r.project, r.path, r.line) for r in line_delta(v, ("project", "path")).collect()), key=repr)
    assert out == [("p", None, "+ b\n"), ("p", None, "- a\n"), (None, "x", "  b\n"), (None, "x", "- a\n")]
    assert line_delta(v.limit(0), ("project", "path")).collect() == []


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_versions_are_read_once_and_the_delta_comes_dealt_by_its_keys(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [("a", "x\ny\n", "x\nz\n"), ("b", "1\n2\n", "1\n2\n"), ("c", None, "n\n"), (None, "o\n", "o\np\n")]
    v = spark.createDataFrame(rows, "path string, old string, new string").mapInPandas(counted, "path string, old string, new string")
    delta = line_delta(v)
    got = {s: {r.path: r.text for r in restore_side(delta, s).collect()} for s in (1, 2)}
    assert got == {1: {"a": "x\ny\n", "b": "1\n2\n", None: "o\n"}, 2: {"a": "x\nz\n", "b": "1\n2\n", "c": "n\n", None: "o\np\n"}}
    assert read.value == len(rows)
    assert exchanges(restore_side(delta, 1)) == exchanges(delta)  # lines of a file are together already


def test_versions_of_odd_documents(spark, tmp_path):
    from textmill.plans.tables import corpus_versions

    docs = [(1, "a\nb"), (2, "a\nb\nc"), (2, "a\nb\nc"), (11, "x"), (13, None), (None, "q"), (6, None), (26, "k\n\nm\n"), (5, None)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.path, r.old, r.new) for r in corpus_versions(spark, str(tmp_path)).collect()), key=repr)
    two = "a\na\nadded after line 1\nadded after line 1\nb (edited)\nb (edited)"
    want = [("doc/1.txt", "a\nb", "a\nb"), *[("doc/2.txt", "a\nb\nc", two)] * 4, ("doc/11.txt", "x", None), ("doc/13.txt", None, None),
            ("doc/13-copy.txt", None, None), (None, "q", None), ("doc/6.txt", None, None), ("doc/26.txt", "k\n\nm\n", "k\nadded after line 1\n (edited)"),
            ("doc/26-copy.txt", None, "k\n\nm\n"), ("doc/5.txt", None, None)]
    assert got == sorted(want, key=repr)
