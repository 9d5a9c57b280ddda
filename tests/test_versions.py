"""Version diffs: unified diff against difflib, status and line deltas."""

import difflib

import pytest

from textmill.operators import versions as V


def vdf(spark, rows):
    return spark.createDataFrame(rows, "path string, old string, new string")


CASES = [
    ("same", "a\nb\n", "a\nb\n"),
    ("changed", "a\nb\nc\n", "a\nB\nc\n"),
    ("added", None, "x\ny\n"),
    ("removed", "x\ny\n", None),
    ("empty_to_text", "", "t\n"),
    ("text_to_empty", "t\n", ""),
    ("no_final_newline", "a\nb", "a\nc"),
]


@pytest.mark.parametrize("path,old,new", CASES)
def test_unified_diff_matches_difflib(spark, path, old, new):
    out = V.unified_diff(vdf(spark, [(path, old, new)])).collect()
    expected = "".join(difflib.unified_diff((old or "").splitlines(True), (new or "").splitlines(True),
                                            fromfile=path, tofile=path))
    if old == new:
        assert out == []  # equal rows never reach the diff
    else:
        assert out[0]["diff"] == expected
        assert f"--- {path}" in expected and f"+++ {path}" in expected


def test_snapshot_diff_counts(spark):
    rows = [("m", "a\nb\nb\nc", "a\nb\nd\nd\ne"), ("s", "x", "x"), ("n", None, "1\n2"), ("r", "1", None)]
    out = {r.path: (r.status, r.lines_added, r.lines_removed) for r in V.snapshot_diff(vdf(spark, rows)).collect()}
    assert out == {"m": ("modified", 3, 2), "s": ("same", 0, 0), "n": ("added", 2, 0), "r": ("removed", 0, 1)}
    # invariant: added - removed = change in line count
    for p, old, new in rows:
        st, a, r = out[p]
        assert a - r == len((new or "").splitlines()) - len((old or "").splitlines())


def test_restore_side(spark):
    old, new = "a\nb\nc\n", "a\nB\nc\nd\n"
    delta = list(difflib.ndiff(old.splitlines(True), new.splitlines(True)))
    df = spark.createDataFrame([("f", i, d) for i, d in enumerate(delta)], "path string, seq long, line string")
    assert V.restore_side(df, 1).first()["text"] == "".join(difflib.restore(delta, 1)) == old
    assert V.restore_side(df, 2).first()["text"] == "".join(difflib.restore(delta, 2)) == new
    with pytest.raises(ValueError):
        V.restore_side(df, 3)


def test_snapshot_diff_random_against_counter(spark):
    import random
    from collections import Counter

    rnd = random.Random(5)

    def text():
        return "\n".join(rnd.choice(["a", "b", "c", ""]) for _ in range(rnd.randint(0, 12)))

    rows = []
    for i in range(40):
        old = None if i % 9 == 0 else text()
        new = None if i % 7 == 0 else (old if i % 5 == 0 else text())
        if old is None and new is None:
            continue
        rows.append((f"f{i}", old, new))
    got = {r.path: (r.status, r.lines_added, r.lines_removed) for r in V.snapshot_diff(vdf(spark, rows)).collect()}
    for p, old, new in rows:
        a, b = Counter((old or "").splitlines()), Counter((new or "").splitlines())
        status = "added" if old is None else "removed" if new is None else "same" if old == new else "modified"
        want = (status, 0, 0) if status == "same" else (status, sum((b - a).values()), sum((a - b).values()))
        assert got[p] == want, p
