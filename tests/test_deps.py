"""Manifest grammar, imports and the four dependency checks on a tiny tree."""

from textmill.operators import deps as D
from textmill.operators import hygiene as H


def lines(spark, files):
    data = [(proj, path, i + 1, t) for (proj, path), text in files.items() for i, t in enumerate(text.splitlines())]
    return spark.createDataFrame(data, "project string, path string, line_no int, line string")


FILES = {
    ("p", "requirements.txt"): "\n".join([
        "Requests==2.0  # pinned", "requests==2.1", "numpy>=1.0", "-r base.txt", "# comment", "",
        "PyYAML[extra]~=5.0 ; python_version >= '3.8'", "flask", "old_lib==1.9"]),
    ("p", "main.py"): "import os, sys as s\nimport yaml\nfrom numpy.linalg import norm\nfrom . import x\n"
                      "from util import helper\nimport missing_pkg.sub",
    ("p", "util.py"): "x = 1",
    ("p", "web/app.js"): "const a = require('@scope/pkg/sub')\nimport b from 'lodash'\nimport c from './local'",
}


def test_parse_manifests(spark):
    r = {x.line_no: x for x in D.parse_manifests(lines(spark, FILES)).collect()}
    assert (r[1].pkg, r[1].op, r[1].version) == ("requests", "==", "2.0")
    assert r[4].kind == "directive" and 5 not in r and 6 not in r
    assert (r[7].pkg, r[7].op, r[7].version, r[7].marker) == ("pyyaml", "~=", "5.0", "python_version >= '3.8'")
    assert (r[8].pkg, r[8].op, r[8].version) == ("flask", None, None)


def test_requirement_grammar(spark):
    text = "\tnumpy\na>=1.0,<2.0\nc===1.2\nb @ https://x.org/b.whl ; os_name == 'nt'\nd [x, y] (>= 1, != 1.5)\n!!\ne 1.0\nf==1.*"
    got = [(x.line_no, x.clause, x.pkg, x.op, x.version, x.kind)
           for x in D.parse_manifests(lines(spark, {("p", "requirements.txt"): text})).orderBy("line_no", "clause").collect()]
    assert got == [
        (1, 0, "numpy", None, None, "requirement"), (2, 0, "a", ">=", "1.0", "requirement"), (2, 1, "a", "<", "2.0", "requirement"),
        (3, 0, "c", "===", "1.2", "requirement"), (4, 0, "b", None, None, "url"), (5, 0, "d", ">=", "1", "requirement"),
        (5, 1, "d", "!=", "1.5", "requirement"), (6, 0, None, None, None, "invalid"), (7, 0, None, None, None, "invalid"),
        (8, 0, "f", "==", "1.*", "requirement")]
    conf = {x.pkg: x.reason for x in D.version_conflicts(D.parse_manifests(lines(spark, {("p", "requirements.txt"): text}))).collect()}
    assert conf == {"numpy": "open range", "d": "open range"}


def test_version_order(spark):
    order = ["1.0.dev1", "1.0a2", "1.0b1", "1.0rc1", "1.0.0", "1.0.post1", "1.0.1", "1.9", "1.10", "2"]
    df = spark.createDataFrame(list(enumerate(order)), "i int, v string")
    assert [r.v for r in df.orderBy(D.version_key("v")).collect()] == order
    one = spark.createDataFrame([("1.0", "1", "1.*", "x")], "a string, b string, c string, d string")
    r = one.select((D.version_key("a") == D.version_key("b")).alias("same"), D.version_key("c").alias("c"), D.version_key("d").alias("d")).first()
    assert r.same and r.c is None and r.d is None


def test_latest_is_reduced_and_wildcards_stay_out(spark):
    reqs = D.parse_manifests(lines(spark, {("p", "requirements.txt"): "a==1.0\nb==1.*\nc==2.0rc1\nd==1.0"}))
    latest = spark.createDataFrame([("a", "1.0.0"), ("a", "0.9"), ("b", "1.5"), ("c", "2.0"), ("c", "1.0"), ("d", "1.0.1"), ("d", "1.0.1")],
                                   "pkg string, version string")
    assert sorted((x.pkg, x.latest) for x in D.outdated_deps(reqs, latest).collect()) == [("c", "2.0"), ("d", "1.0.1")]


def test_package_json(spark):
    files = [("p", "package.json", '{"dependencies": {"Lodash": "^4.17.0", "x": "latest", "y": "file:../y"}, "devDependencies": {"jest": "29.1"}}'),
             ("p", "a/package.json", "[]"), ("p", "b/package.json", "{"), ("p", "c/package.json", "{}"), ("p", "package.json.md", "{}")]
    got = sorted((x.file, x.pkg or "", x.op, x.version, x.marker, x.kind)
                 for x in D.parse_package_json(spark.createDataFrame(files, "project string, path string, content string")).collect())
    assert got == [("a/package.json", "", None, None, None, "invalid"), ("b/package.json", "", None, None, None, "invalid"),
                   ("package.json", "jest", "=", "29.1", "dev", "requirement"), ("package.json", "lodash", "^", "4.17.0", None, "requirement"),
                   ("package.json", "x", None, None, None, "requirement"), ("package.json", "y", None, None, None, "url")]


def test_import_comments_and_joined_statements(spark):
    text = "import os  # read, write\nimport json; import re\nx = 1; from a.b import c\nprint('import z')\n# import q"
    got = sorted((x.line_no, x.module) for x in D.extract_imports(lines(spark, {("p", "m.py"): text})).collect())
    assert got == [(1, "os"), (2, "json"), (2, "re"), (3, "a")]


def test_imports(spark):
    got = sorted((x.path, x.module) for x in D.extract_imports(lines(spark, FILES)).collect())
    assert ("main.py", "os") in got and ("main.py", "sys") in got and ("main.py", "numpy") in got
    assert ("web/app.js", "@scope/pkg") in got and ("web/app.js", "lodash") in got
    assert not any(m.startswith(".") for _, m in got)


def test_checks(spark):
    ln = lines(spark, FILES)
    reqs, imps = D.parse_manifests(ln), D.extract_imports(ln)
    alias = spark.createDataFrame([("yaml", "PyYAML")], "module string, pkg string")
    stdlib = spark.createDataFrame([("os",), ("sys",)], "module string")
    files = spark.createDataFrame([("p", p) for (_, p) in FILES], "project string, path string")
    unused = {x.pkg for x in D.unused_deps(reqs, imps, alias).collect()}
    assert unused == {"requests", "flask", "old-lib"}
    missing = {x.module for x in D.missing_deps(reqs, imps, alias, stdlib, D.project_modules(files)).collect()}
    assert missing == {"missing_pkg", "@scope/pkg", "lodash"}
    conf = {x.pkg: x.reason for x in D.version_conflicts(reqs).collect()}
    assert conf == {"requests": "multiple pins", "numpy": "open range", "flask": "open range"}
    latest = spark.createDataFrame([("old_lib", "1.10"), ("requests", "2.1")], "pkg string, version string")
    out = {(x.pkg, x.version, x.latest) for x in D.outdated_deps(reqs, latest).collect()}
    assert out == {("old-lib", "1.9", "1.10"), ("requests", "2.0", "2.1")}  # 1.10 > 1.9


def test_unused_definitions(spark):
    code = "import os\nimport re as regex\nfrom a import b\ndef used():\n    return b\ndef unused():\n" \
           "    return used()\nclass K:\n    pass\nX = 1\nY = X\n__all__ = []"
    df = spark.createDataFrame([("m.py", i + 1, t) for i, t in enumerate(code.splitlines())],
                               "path string, line_no int, line string")
    got = {(x.kind, x.name) for x in H.unused_definitions(df).collect()}
    assert got == {("import", "os"), ("import", "regex"), ("function", "unused"), ("class", "K"),
                   ("variable", "Y")}


def test_duplicate_blocks(spark):
    data = [("a", i + 1, t) for i, t in enumerate(["x", "y", "z", "x", "y"])] + [("b", 1, "x"), ("b", 2, "y")]
    df = spark.createDataFrame(data, "path string, line_no int, line string")
    got = [(r.n, r.first_path, r.first_line) for r in H.duplicate_blocks(df, 2).collect()]
    assert got == [(3, "a", 1)]


def test_duplicate_blocks_across_bucket_edges(spark):
    from collections import Counter

    import random

    rnd = random.Random(3)
    files = {f"p{f}": [rnd.choice("abc") for _ in range(rnd.randint(1, 40))] for f in range(6)}
    data = [(p, i + 1, t) for p, ls in files.items() for i, t in enumerate(ls)]
    df = spark.createDataFrame(data, "path string, line_no int, line string")
    for k in (1, 2, 3, 5):
        runs = Counter()
        first = {}
        for p in sorted(files):
            ls = files[p]
            for i in range(len(ls) - k + 1):
                key = "\n".join(ls[i:i + k])
                runs[key] += 1
                first.setdefault(key, (p, i + 1))
        want = sorted((n, *first[key]) for key, n in runs.items() if n > 1)
        got = sorted((r.n, r.first_path, r.first_line) for r in H.duplicate_blocks(df, k, bucket=4).collect())
        assert got == want, k
