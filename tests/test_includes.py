"""Includes of requirement files."""

from textmill.operators import deps as D
from textmill.operators.includes import on_cycles, parse_closure, resolve_includes


def frame(spark, files, project="p"):
    rows = [(project, path, i + 1, t) for path, lines in files.items() for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "project string, path string, line_no int, line string")


FILES = {
    "requirements.txt": ["-r deps/base.in  # shared", "--constraint=limits.txt", "a>=1"],
    "deps/base.in": ["-r./more.in", "-r ../deps/../deps/base.in", "b==1"],
    "deps/more.in": ["--requirement ../requirements.txt", "-r gone.in", "-r https://example.org/r.txt", "-r ../../x", "-r /etc/r", "c"],
    "limits.txt": ["a<2", "-r soft.in"],
    "soft.in": ["d==4"],
    "unused.in": ["-r soft.in", "e"],
}


def test_closure_and_errors(spark):
    files, errors = resolve_includes(frame(spark, FILES))
    assert sorted((r.file, r.kind, r.depth) for r in files.collect()) == [
        ("deps/base.in", "requirement", 1), ("deps/more.in", "requirement", 2), ("limits.txt", "constraint", 1),
        ("requirements.txt", "requirement", 0), ("soft.in", "constraint", 2)]
    assert sorted((r.file, r.line_no, r.error) for r in errors.collect()) == [
        ("deps/base.in", 1, "cycle"), ("deps/base.in", 2, "cycle"), ("deps/more.in", 1, "cycle"), ("deps/more.in", 2, "missing file"),
        ("deps/more.in", 3, "address"), ("deps/more.in", 4, "outside the project"), ("deps/more.in", 5, "outside the project"),
        ("requirements.txt", 1, "cycle")]


def test_checks_see_the_closure(spark):
    rows = parse_closure(frame(spark, FILES))
    got = sorted((r.file, r.pkg, r.kind) for r in rows.collect())
    assert got == [("deps/base.in", "b", "requirement"), ("deps/more.in", "c", "requirement"), ("limits.txt", "a", "constraint"),
                   ("requirements.txt", "a", "requirement"), ("soft.in", "d", "constraint")]
    imports = spark.createDataFrame([("p", "m.py", 1, "b")], "project string, path string, line_no int, module string")
    assert sorted(r.pkg for r in D.unused_deps(rows, imports).collect()) == ["a", "c"]


def test_a_hard_way_beside_a_soft_one(spark):
    files = {"requirements.txt": ["-c c.in", "-r x.in"], "c.in": ["-r y.in"], "x.in": ["-r z.in"], "z.in": ["-r y.in"], "y.in": ["k"]}
    got, errors = resolve_includes(frame(spark, files))
    by = {r.file: (r.kind, r.depth) for r in got.collect()}
    assert by["y.in"] == ("requirement", 2) and by["c.in"] == ("constraint", 1) and errors.collect() == []


def test_long_chains_null_projects_and_empty(spark):
    chain = {"requirements.txt": ["-r 0.in"], **{f"{i}.in": [f"-r {i + 1}.in"] for i in range(7)}, "7.in": ["z"]}
    files, errors = resolve_includes(frame(spark, chain, None).unionByName(frame(spark, {"requirements.txt": ["-r 0.in"]})))
    got = {(r.project, r.file): r.depth for r in files.collect()}
    assert got[None, "7.in"] == 8 and got["p", "requirements.txt"] == 0 and len(got) == 10
    assert [(r.project, r.error) for r in errors.collect()] == [("p", "missing file")]
    files, errors = resolve_includes(frame(spark, chain).limit(0))
    assert files.collect() == [] and errors.collect() == []


def test_edges_on_cycles(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 4), (6, 6), (7, 0), (5, 8)]
    df = spark.createDataFrame([(1, str(a), str(b)) for a, b in edges], "_p int, a string, b string")
    assert sorted((int(r.a), int(r.b)) for r in on_cycles(df).collect()) == [(0, 1), (1, 2), (2, 0), (4, 5), (5, 4), (6, 6)]


def random_projects(spark, n=60):
    import random

    rng = random.Random(5)
    rows = []
    for p in range(n):
        names = ["requirements.txt", "a/requirements-x.txt", *(f"{rng.choice('ab')}/{i}.in" for i in range(rng.randint(0, 7))), None]
        for f in names:
            for i in range(rng.randint(1, 3)):
                to = rng.choice(["../" + str(x) for x in names] + ["0.in", "./1.in", "..", "https://example.org/x", "../../y", "/z", "a//b"])
                line = rng.choice([f"-r {to}", f"--requirement={to}", f"\t-c {to}  # why", f"-r {to}", "x>=1", "-e .", "# -r 0.in", None])
                rows += [(None if p == 7 else f"p{p}", f, i + 1, line)] * rng.choice([1, 1, 1, 2])
    return spark.createDataFrame(rows, "project string, path string, line_no int, line string")


def test_projects_in_a_row_and_by_rounds_agree(spark, monkeypatch):
    from textmill.operators import includes

    lines = random_projects(spark).repartition(3).cache()

    def results():
        files, errors = resolve_includes(lines)
        return [sorted((tuple(r) for r in df.collect()), key=repr) for df in (files, errors, parse_closure(lines))]

    rows = results()
    monkeypatch.setattr(includes, "SMALL_LINES", 0)
    rounds = results()
    assert rows == rounds and all(rows) and {"cycle", "missing file", "address", "outside the project"} == {r[-1] for r in rows[1]}
    monkeypatch.setattr(includes, "SMALL_LINES", 12)
    assert results() == rounds


def test_a_long_chain_takes_no_rounds(spark, monkeypatch):
    from textmill.operators import includes

    written, write = [], includes.materialize
    monkeypatch.setattr(includes, "materialize", lambda df, name: written.append(name) or write(df, name))
    chain = {"requirements.txt": ["-r 0.in"], **{f"{i}.in": [f"-r {i + 1}.in"] for i in range(50)}, "50.in": ["-r 0.in"]}
    files, errors = resolve_includes(frame(spark, chain))
    assert files.count() == 52 and errors.count() == 51 and max(r.depth for r in files.collect()) == 51
    assert len(written) == 2
