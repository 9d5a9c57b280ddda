"""Version ranges that exclude each other, against a search over a grid of versions."""

import itertools
import random

from textmill.operators import deps as D
from textmill.operators.version_ranges import unsatisfiable


def frame(spark, specs):
    """{pkg: [(op, version)]}"""
    rows = [("p", pkg, op, v, "requirement") for pkg, cl in specs.items() for op, v in cl]
    return spark.createDataFrame(rows, "project string, pkg string, op string, version string, kind string")


def test_known_cases(spark):
    cases = {
        "pins": ([("==", "1.0"), ("==", "1.1")], "==1.0, ==1.1"),
        "equal": ([("==", "1.0"), ("==", "1.0.0")], None),
        "below": ([(">=", "2"), ("<", "1.5")], "<1.5, >=2"),
        "touch": ([(">=", "2"), ("<=", "2.0")], None),
        "strict": ([(">", "2"), ("<=", "2.0")], "<=2.0, >2"),
        "point": ([("<=", "3"), (">=", "3"), ("!=", "3.0")], "!=3.0, <=3, >=3"),
        "wild": ([("==", "1.2.*"), (">=", "1.3")], "==1.2.*, >=1.3"),
        "wild_in": ([("==", "1.2.*"), (">=", "1.2.9")], None),
        "wild_dev": ([("==", "1.3.*"), ("<", "1.3")], "<1.3, ==1.3.*"),
        "wild_pre": ([("==", "1.3.*"), ("<", "1.3rc1")], None),
        "post": ([(">", "1.3"), ("<=", "1.3.post2")], "<=1.3.post2, >1.3"),
        "post_of_pre": ([(">", "1.3rc1"), ("<=", "1.3.post2")], None),
        "compatible": ([("~=", "1.4.2"), ("==", "1.5")], "==1.5, ~=1.4.2"),
        "compatible_in": ([("~=", "1.4"), ("==", "1.9.1")], None),
        "cut_wild": ([(">=", "1.0"), ("<", "1.2"), ("!=", "1.0.*"), ("!=", "1.1.*")], "!=1.0.*, !=1.1.*, <1.2, >=1.0"),
        "cut_some": ([(">=", "1.0"), ("<=", "1.2"), ("!=", "1.0.*"), ("!=", "1.1.*")], None),
        "pre": ([(">=", "2.0"), ("<=", "2.0rc1")], "<=2.0rc1, >=2.0"),
        "open": ([(">=", "1"), ("!=", "1.*")], None),
        "caret": ([("^", "1.2.3"), (">=", "2.0.0")], ">=2.0.0, ^1.2.3"),
        "caret0": ([("^", "0.2.3"), ("=", "0.3.0")], "=0.3.0, ^0.2.3"),
        "tilde": ([("~", "1.2.3"), ("=", "1.2.9")], None),
        "odd": ([("==", "whatever"), ("==", "1"), ("===", "abc")], None),
        "alone": ([(None, None)], None),
    }
    got = {r.pkg: r.clauses for r in unsatisfiable(frame(spark, {k: c for k, (c, _) in cases.items()})).collect()}
    assert got == {k: want for k, (_, want) in cases.items() if want}
    assert unsatisfiable(frame(spark, {"x": [("==", "1")]}).limit(0)).collect() == []


def meets(v, op, w):
    wild = w.endswith(".*")
    nums = [int(x) for x in w.removesuffix(".*").split(".")]
    pad = tuple((nums + [0, 0, 0])[:3])
    if wild:
        return (v[:len(nums)] == tuple(nums)) == (op == "==")
    if op == "~=":
        return v >= pad and v[:len(nums) - 1] == tuple(nums[:-1])
    return {"==": v == pad, "!=": v != pad, ">=": v >= pad, "<=": v <= pad, ">": v > pad, "<": v < pad}[op]


def test_equals_a_search_over_a_grid(spark):
    """Versions a.b.c with halves between them, so that the grid is dense where clauses are."""
    rng = random.Random(4)
    specs = {}
    for i in range(300):
        clauses = []
        for _ in range(rng.randrange(1, 6)):
            op = rng.choice(["==", "!=", ">=", "<=", ">", "<", "~="])
            nums = [str(rng.randrange(3)) for _ in range(rng.choice([2, 3]))]
            wild = op in ("==", "!=") and rng.random() < 0.4
            clauses.append((op, ".".join(nums[:2] if wild else nums) + (".*" if wild else "")))
        specs[f"k{i}"] = clauses
    # c in halves stands for versions like 1.2.0.5 that lie between two written ones
    grid = [(a, b, c / 2) for a, b, c in itertools.product(range(5), range(5), range(12))] + [(-1, 0, 0)]
    want = {k for k, cl in specs.items() if not any(all(meets(v, o, w) for o, w in cl) for v in grid)}
    got = {r.pkg for r in unsatisfiable(frame(spark, specs)).collect()}
    assert got == want and 30 < len(got) < 270


def test_from_manifests_and_null_projects(spark):
    lines = spark.createDataFrame(
        [("p", "requirements.txt", 1, "Some_Pkg >= 2, < 3"), ("p", "requirements-dev.txt", 1, "some-pkg == 1.9"),
         (None, "requirements.txt", 1, "x>1"), (None, "requirements.txt", 2, "x<1"), ("q", "requirements.txt", 1, "some-pkg<2")],
        "project string, path string, line_no int, line string")
    got = sorted((tuple(r) for r in unsatisfiable(D.parse_manifests(lines)).collect()), key=repr)
    assert got == [("p", "some-pkg", "==1.9, >=2"), (None, "x", "<1, >1")]


def test_a_rendering_computes_the_picked_choice_only(spark):
    from pyspark.sql import functions as F

    from textmill.plans.tables import picked

    choices = [F.concat(F.lit("a"), F.col("id").cast("string")), F.lit("b"), F.raise_error(F.lit("not picked")).cast("string")]
    out = spark.range(4).select(picked(F.col("id") % 2, choices).alias("x"))
    assert sorted(r.x for r in out.collect()) == ["a0", "a2", "b", "b"]
