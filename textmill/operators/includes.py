"""Requirement files that include others: ``-r file`` and ``-c file``.

A file's include lines are edges between files of a project, paths being relative to
the including file. What the manifests of a project reach is found in one of two ways:

- A project of up to ``SMALL_LINES`` lines and ``SMALL_BYTES`` bytes is gathered into
  a row, by one shuffle of the lines, and its edges are followed in that row.
- Larger projects go by a frontier: each round joins the files found last with the
  edges, drops those that are known and writes the rest; a cycle ends it, and there
  are as many rounds as the longest chain of includes has files.

A file reached by ``-r`` alone adds requirements. One that is reached only through a
``-c`` adds constraints: versions that count if a package is required elsewhere.
"""

from __future__ import annotations

from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, py_strip
from ..session import bounded_broadcast, materialize
from .deps import MANIFEST_PATTERNS, parse_manifests, without_comment

# An include line without its comment: option and target.
INCLUDE = r"^(-r|--requirement|-c|--constraint)(?:\s+|=|(?<=^-[rc]))(\S.*)$"
ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://"
# Lines that may be include lines: the first character that is no blank is a dash.
DASH = rf"(?U)^{WS}*-"
# Paths with parts that are empty, '.' or '..'.
STEPS = r"(^|/)\.{0,2}(/|$)"
#: Projects up to this size are gathered into a row.
SMALL_LINES, SMALL_BYTES = 1000, 1 << 20


def resolved(folder: F.Column, target: F.Column) -> F.Column:
    """``target`` seen from ``folder`` ('' is the project's root) without '.' and '..';
    null if it is absolute or leaves the project."""
    whole = F.concat_ws("/", F.nullif(folder, F.lit("")), target)
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))
    walked = F.aggregate(F.split(whole, "/"), start, lambda a, p: F.struct(
        F.when(p.isin("", "."), a["at"]).when(p == "..", F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0))))
        .otherwise(F.concat(a["at"], F.array(p))).alias("at"),
        (a["ok"] & ((p != "..") | (F.size(a["at"]) > 0))).alias("ok")), lambda a: F.when(a["ok"] & (F.size(a["at"]) > 0), F.array_join(a["at"], "/")))
    return F.when(~whole.rlike(STEPS), whole).when(~target.startswith("/"), walked)


def with_includes(lines: DataFrame) -> DataFrame:
    """``lines(project, path, line_no, line)`` as ``_p`` (a struct of the project),
    ``file, line_no, line`` and, for include lines, ``kind, target, to``: 'requirement'
    or 'constraint', the target as written and the path it names (null: an address,
    an absolute path, or one outside the project)."""
    body = F.when(F.col("line").contains("-") & F.col("line").rlike(DASH), py_strip(without_comment("line")))
    e = lines.select(F.struct("project").alias("_p"), F.col("path").alias("file"), "line_no", "line", body.alias("_b"))
    e = e.withColumn("_option", F.nullif(F.regexp_extract("_b", INCLUDE, 1), F.lit("")))
    e = e.withColumn("_rest", F.when(F.col("_option").isNotNull(), F.regexp_extract("_b", INCLUDE, 2)))
    e = e.withColumn("target", F.when(F.ascii("_rest").between(33, 126), F.col("_rest")).otherwise(py_strip("_rest")))
    kind = F.when(F.col("_option").isin("-r", "--requirement"), "requirement").when(F.col("_option").isNotNull(), "constraint")
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", r"/[^/]*$", "")).otherwise(F.lit(""))
    to = F.when(~(F.col("target").contains("://") & F.col("target").rlike(ADDRESS)), resolved(folder, F.col("target")))
    return e.select("_p", "file", "line_no", "line", kind.alias("kind"), "target", to.alias("to"))


def include_edges(lines: DataFrame) -> DataFrame:
    """``project, file, line_no, kind, target, path`` of every include line of
    ``lines(project, path, line_no, line)``, as ``with_includes`` finds them."""
    e = with_includes(lines).where("kind is not null")
    return e.select("_p.project", "file", "line_no", "kind", "target", F.col("to").alias("path"))


def fits(patterns: list[str]) -> F.Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.col("file").rlike(p)
    return out


def by_size(lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The lines of small projects, and those of the others if there are any."""
    used = F.sum(F.coalesce(F.octet_length("line"), F.lit(0)) + F.coalesce(F.octet_length("path"), F.lit(0)))
    sizes = lines.groupBy(F.struct("project").alias("_p")).agg(F.count("*").alias("n"), used.alias("used"))
    large = materialize(sizes.where((F.col("n") > SMALL_LINES) | (F.col("used") > SMALL_BYTES)).select("_p"), "include-large")
    if large.isEmpty():
        return lines, None
    keyed, large = lines.withColumn("_p", F.struct("project")), bounded_broadcast(large)
    return keyed.join(large, "_p", "left_anti").drop("_p"), keyed.join(large, "_p", "left_semi").drop("_p")


def followed(files: list, first: list, to: list, soft: list, max_rounds: int) -> list[int]:
    """For each line of a project, given its file, whether this is a manifest, the file
    it includes and whether by ``-c``: -1 if no manifest reaches its file, or else
    8 * the file's depth + 4 if requirements lead there + 2 if the included file is
    there + 1 if the edge lies on a cycle."""
    there, edges = set(files), {}
    for f, t, s in zip(files, to, soft):
        if t is not None and t in there:
            edges.setdefault(f, set()).add((t, s))
    at, frontier, depth = {}, {(f, True) for f, x in zip(files, first) if x}, 0
    while frontier and depth < max(max_rounds, 1):
        at.update(dict.fromkeys(frontier, depth))
        depth += 1
        frontier = {(t, hard and not s) for f, hard in frontier for t, s in edges.get(f, ())} - at.keys()
    code = {}
    for (f, hard), d in at.items():
        code[f] = (min(d, code[f][0]) if f in code else d, hard or f in code and code[f][1])
    # files that nothing includes or that include nothing go until none is left
    links, n = {f: {t for t, _ in edges[f]} for f in code if f in edges}, -1
    while n != len(links):
        n, ends = len(links), set(chain.from_iterable(links.values()))
        links = {f: some for f, ts in links.items() if f in ends and (some := {t for t in ts if t in links})}
    behind = {}
    for f in links:
        behind[f], last = {f}, [f]
        while last:
            last = {t for x in last for t in links.get(x, ())} - behind[f]
            behind[f] |= last
    return [-1 if f not in code else 8 * code[f][0] + 4 * code[f][1] + 2 * (t in there) + (t in behind and f in behind[t])
            for f, t in zip(files, to)]


def small_projects(lines: DataFrame, patterns: list[str], max_rounds: int, *keep: str) -> DataFrame:
    """``_p, xs``: of each project the lines of files that its manifests reach, as
    structs of ``file``, ``code`` (what ``followed`` says) and the columns ``keep``."""
    @F.arrow_udf("array<int>")
    def codes(files: pa.Array, first: pa.Array, to: pa.Array, soft: pa.Array) -> pa.Array:
        columns = [a.flatten().to_pylist() for a in (files, first, to, soft)]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(files).to_numpy(zero_copy_only=False))]).tolist()
        out = chain.from_iterable(followed(*(c[i:j] for c in columns), max_rounds) for i, j in pairwise(ends))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(out), pa.int32()))

    soft = F.col("kind") == "constraint"
    line = F.struct("file", "to", fits(patterns).alias("first"), soft.alias("soft"), *[c for c in keep if c != "to"])
    g = with_includes(lines).groupBy("_p").agg(F.collect_list(line).alias("xs"))
    g = g.withColumn("codes", codes(*(F.col(f"xs.{c}") for c in ("file", "first", "to", "soft"))))
    coded = F.zip_with("xs", "codes", lambda x, c: F.struct(x["file"].alias("file"), c.alias("code"), *[x[k].alias(k) for k in keep]))
    return g.select("_p", F.filter(coded, lambda x: x["code"] >= 0).alias("xs"))


def _kind(code: F.Column) -> F.Column:
    return F.when(code.bitwiseAND(4) > 0, F.lit("requirement")).otherwise(F.lit("constraint"))


def _error(target: F.Column, path: F.Column, there: F.Column, loop: F.Column) -> F.Column:
    return (F.when(path.isNull() & target.rlike(ADDRESS), "address").when(path.isNull(), "outside the project")
            .when(~there, "missing file").when(loop, "cycle"))


def _reach(lines: DataFrame, patterns: list[str], max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The include edges of all files, and the files that the manifests reach, by rounds."""
    named = lines.withColumn("_p", F.struct("project"))
    everything = materialize(named.select("_p", F.col("path").alias("file")).distinct(), "include-files")
    edges = include_edges(lines).withColumn("_p", F.struct("project")).drop("project").distinct()
    edges = materialize(edges.join(everything.withColumnRenamed("file", "path").withColumn("there", F.lit(True)), ["_p", "path"], "left"), "include-edges")
    good = edges.where("there")
    hard = F.lit("requirement")
    frontier = materialize(everything.where(fits(patterns)).select("_p", "file", hard.alias("kind"), F.lit(0).alias("depth")), "include-0")
    known = [frontier]

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    for depth in range(1, max_rounds):
        step = frontier.join(good.select("_p", "file", F.col("kind").alias("by"), "path"), ["_p", "file"])
        kind = F.when((F.col("kind") == hard) & (F.col("by") == hard), hard).otherwise(F.lit("constraint"))
        found = step.select("_p", F.col("path").alias("file"), kind.alias("kind")).distinct()
        found = found.join(union(known).select("_p", "file", "kind"), ["_p", "file", "kind"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = materialize(found, f"include-{depth}")
        if frontier.isEmpty():
            break
        known.append(frontier)
    reached = union(known).groupBy("_p", "file").agg(F.max("kind").alias("kind"), F.min("depth").alias("depth"))
    reached = materialize(reached, "include-reached")
    return edges, reached


def included_files(lines: DataFrame, patterns: list[str] = MANIFEST_PATTERNS, max_rounds: int = 10_000) -> DataFrame:
    """``project, file, kind, depth`` of ``lines(project, path, line_no, line)``: the
    files whose path fits a pattern (depth 0) and all they include, with the least
    number of includes that leads there; kind 'constraint' if every way there passes
    a ``-c``. A null project is a project. Equal lines at one number are one edge.
    Empty input gives no rows."""
    small, large = by_size(lines)
    # a file once, without what its lines include
    files = F.array_distinct(F.transform("xs", lambda x: F.struct(x["file"].alias("file"), F.shiftright(x["code"], 2).alias("code"))))
    own = small_projects(small, patterns, max_rounds).select("_p", F.inline(files))
    own = own.select("_p.project", "file", _kind(F.shiftleft("code", 2)).alias("kind"), F.shiftright("code", 1).alias("depth"))
    if large is None:
        return own
    _, reached = _reach(large, patterns, max_rounds)
    return own.unionByName(reached.select("_p.project", "file", "kind", "depth"))


def include_errors(lines: DataFrame, patterns: list[str] = MANIFEST_PATTERNS, max_rounds: int = 10_000) -> DataFrame:
    """``project, file, line_no, target, error``: the errors of ``resolve_includes``."""
    small, large = by_size(lines)
    g = small_projects(small, patterns, max_rounds, "line_no", "kind", "target", "to")
    # equal lines at one number are one edge
    wrong = F.array_distinct(F.filter("xs", lambda x: x["kind"].isNotNull() & (x["to"].isNull() | (x["code"].bitwiseAND(3) != 2))))
    bit = lambda n: F.col("code").bitwiseAND(n) > 0
    own = g.select("_p", F.inline(wrong)).select("_p.project", "file", "line_no", "target", _error(F.col("target"), F.col("to"), bit(2), bit(1)).alias("error"))
    if large is None:
        return own
    edges, reached = _reach(large, patterns, max_rounds)
    of_reached = edges.join(reached.select("_p", "file"), ["_p", "file"], "left_semi")
    loops = on_cycles(of_reached.where("there").select("_p", F.col("file").alias("a"), F.col("path").alias("b")).distinct())
    e = of_reached.join(loops.select("_p", F.col("a").alias("file"), F.col("b").alias("path"), F.lit(True).alias("loop")), ["_p", "file", "path"], "left")
    error = _error(F.col("target"), F.col("path"), F.col("there").isNotNull(), F.col("loop"))
    return own.unionByName(e.select("_p.project", "file", "line_no", "target", error.alias("error")).where("error is not null"))


def resolve_includes(lines: DataFrame, patterns: list[str] = MANIFEST_PATTERNS, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``(files, errors)``: ``included_files``, and ``errors(project, file, line_no,
    target, error)``: include lines of these files that are an 'address', lead
    'outside the project', name a 'missing file' or close a 'cycle' (the included
    file leads back to the including one)."""
    return included_files(lines, patterns, max_rounds), include_errors(lines, patterns, max_rounds)


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges ``_p, a, b`` that lie on a cycle. Files that nothing includes, or that
    include nothing, are peeled off until none is left; only what remains (cycles
    and what lies between them) has its pairs closed, in steps that double."""
    left, n = materialize(edges, "cycle-edges"), -1
    while True:
        now = left.count()
        if now in (0, n):
            break
        n = now
        inner = left.join(left.select("_p", F.col("b").alias("a")).distinct(), ["_p", "a"], "left_semi")
        left = materialize(inner.join(left.select("_p", F.col("a").alias("b")).distinct(), ["_p", "b"], "left_semi").select("_p", "a", "b"), "cycle-edges")
    pairs, n = left, -1
    while n:
        now = pairs.count()
        if now in (0, n):
            break
        n = now
        longer = pairs.join(pairs.select("_p", F.col("a").alias("b"), F.col("b").alias("c")), ["_p", "b"]).select("_p", "a", F.col("c").alias("b"))
        pairs = materialize(pairs.unionByName(longer).distinct(), "cycle-pairs")
    back = pairs.select("_p", F.col("b").alias("a"), F.col("a").alias("b"))
    return left.join(back, ["_p", "a", "b"], "left_semi").unionByName(left.where("a = b")).distinct()


def parse_closure(lines: DataFrame, patterns: list[str] = MANIFEST_PATTERNS) -> DataFrame:
    """``parse_manifests`` over the manifests and all files they include. Rows of
    files reached only through ``-c`` have kind 'constraint' where they would be
    'requirement': the checks for unused and missing packages do not count them as
    declared. Include lines are no rows."""
    small, large = by_size(lines)
    g = small_projects(small, patterns, 10_000, "line_no", "line")
    # the file's kind goes through the parser beside the project
    project = F.struct("_p.project", _kind(F.col("code")).alias("kind")).alias("project")
    here = g.select("_p", F.inline("xs")).select(project, F.col("file").alias("path"), "line_no", "line")
    if large is not None:
        _, reached = _reach(large, patterns, 10_000)
        reached = reached.select("_p", F.col("file").alias("path"), F.struct("_p.project", "kind").alias("_of"))
        far = large.withColumn("_p", F.struct("project")).join(reached, ["_p", "path"])
        here = here.unionByName(far.select(F.col("_of").alias("project"), "path", "line_no", "line"))
    rows = parse_manifests(here, [""]).where("kind <> 'directive'")
    soft = (F.col("project.kind") == "constraint") & (F.col("kind") == "requirement")
    rows = rows.withColumn("kind", F.when(soft, F.lit("constraint")).otherwise(F.col("kind")))
    return rows.withColumn("project", F.col("project.project"))
