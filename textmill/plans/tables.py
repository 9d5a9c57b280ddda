"""Access to the driver's parquet tables and the renderings built on them.

The driver tables carry prose, not source trees. Each rendering below turns
them into the operator inputs (files, lines, versions, requests, answers,
manifests) with plain column expressions, and ``plans/oracle.py`` renders the
same inputs in DuckDB SQL from the same expressions, so both sides start from
identical data. All renderings read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Make sure CPU-heavy row work gets at least ``min_partitions`` tasks
    (default: the cluster's parallelism).

    A scan of few large files (one parquet row group each) yields one task
    per file. Rows are then hash-partitioned by their position in the scan
    (``monotonically_increasing_id``): balanced whatever the values (exact
    duplicate rows still differ in position), and repeatable on retry because
    a file split is always read in the same order, so no sort is needed
    before the exchange. When the scan already has enough splits, as any
    large input has, nothing changes and no shuffle is added."""
    try:
        n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # no RDD access (e.g. a Spark Connect session): leave the plan as it is
        return df
    if have >= n:
        return df
    return df.repartition(n, F.monotonically_increasing_id())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def picked(k: F.Column, choices: list[F.Column]) -> F.Column:
    """The choice of number ``k`` from 0; the others are not computed."""
    out = F.when(k == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(k == i, c)
    return out


def stream_source(sf_dir: str, name: str) -> str:
    """A pattern of one choice that names the table for a stream of files: it fits
    whether the table is a file or a folder of files, which a plain path does not."""
    return f"{sf_dir.rstrip('/')}/{{{name}.parquet}}"


# Fixed values of the renderings (shared with the SQL side).
FOLDERS = ["src", "lib", "node_modules", "dist", "build", ".git", "__pycache__"]
LANG_SUFFIX = {"en": ".py", "fr": ".js", "de": ".go", "es": ".txt"}


def doc_path(doc_id="doc_id") -> F.Column:
    """``doc/<id>.txt``: the plain path used by line-level queries."""
    return F.concat(F.lit("doc/"), F.col(doc_id).cast("string"), F.lit(".txt"))


def suffix_for_lang(lang="lang") -> F.Column:
    m = F.create_map(*[x for k, v in LANG_SUFFIX.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(lang)], F.lit(".md"))


def files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(project, path, length, content)`` from ``documents``: project is
    the source, the folder cycles through ``FOLDERS`` by id, the suffix follows
    the language."""
    d = table(spark, sf_dir, "documents")
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS]), (F.col("doc_id") % len(FOLDERS) + 1).cast("int"))
    path = F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), suffix_for_lang())
    return d.select(
        F.col("source").alias("project"),
        path.alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("text").alias("content"),
        "doc_id",
        "lang",
    )


# ------------------------------------------------------------------ line renderings


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines(path, line_no, line)`` of every document (no terminators)."""
    from ..operators.lines import split_lines

    d = table(spark, sf_dir, "documents").select(doc_path().alias("path"), "text")
    return split_lines(d, "text")


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selection per document; some name a missing file, some are
    invalid (end before start), some start past the end."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    path = F.when(i % 10 == 9, F.concat(F.lit("doc/missing-"), i.cast("string"), F.lit(".txt"))).otherwise(doc_path())
    start = (i % 5 + 1 + F.when(i % 13 == 7, 40).otherwise(0)).cast("int")
    end = F.when(i % 23 == 5, start - 1).otherwise(start + i % 4).cast("int")
    return d.select(i.alias("sel_id"), path.alias("path"), start.alias("start_line"), end.alias("end_line"))


def edited_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(files, edits)``: a file for each document and, for some, an empty one
    beside it; the edits of ``edits``, and others that delete whole files or
    put a first line into an empty one."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    lengths = doc_lines(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n_lines"))
    empty = F.concat(F.lit("empty/"), i.cast("string"), F.lit(".txt"))
    named = d.select(doc_path().alias("path")).unionByName(d.where(i % 29 == 3).select(empty.alias("path")))
    files = named.join(lengths, "path", "left").select("path", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"))
    whole = d.where(i % 19 == 4).select(
        (i * 10 + 6).alias("edit_id"), F.concat(F.lit("doc/"), i.cast("string"), F.lit(".txt")).alias("path"),
        F.lit(1).alias("start_line"), F.lit(1_000_000).alias("end_line"), F.lit("").alias("snippet"))
    first = d.where(i % 29 == 3).select(
        (i * 10 + 7).alias("edit_id"), empty.alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.lit("first line").alias("snippet"))
    gone = whole.select(F.col("path").alias("_p"))
    others = edits(spark, sf_dir)
    return files, others.join(gone, others["path"] == F.col("_p"), "left_anti").unionByName(whole).unionByName(first)


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits per document: a two-line replacement near the top; deletions,
    overlapping edits, appends past the end, missing files and invalid
    ranges on some documents."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    a_start = (i % 3 + 1).cast("int")
    rows = [
        (F.lit(True), i * 10, doc_path(), a_start, (a_start + i % 2).cast("int"),
         F.concat(F.lit("edited "), i.cast("string"), F.lit("\nsecond line"))),
        (i % 4 == 0, i * 10 + 1, doc_path(), F.lit(6), F.lit(6), F.lit("")),
        (i % 9 == 0, i * 10 + 2, doc_path(), F.lit(2), F.lit(3), F.lit("overlap")),
        (i % 7 == 3, i * 10 + 3, doc_path(), F.lit(50), F.lit(60), F.lit("tail")),
        (i % 11 == 1, i * 10 + 4, F.concat(F.lit("doc/missing-"), i.cast("string"), F.lit(".txt")),
         F.lit(1), F.lit(1), F.lit("x")),
        (i % 17 == 2, i * 10 + 5, doc_path(), F.lit(0), F.lit(1), F.lit("bad")),
    ]
    arr = F.filter(
        F.array(*[F.struct(c.alias("on"), e.cast("long").alias("edit_id"), p.alias("path"),
                           s.cast("int").alias("start_line"), en.cast("int").alias("end_line"),
                           sn.alias("snippet")) for c, e, p, s, en, sn in rows]),
        lambda x: x["on"],
    )
    return d.select(F.explode(arr).alias("e")).select("e.edit_id", "e.path", "e.start_line", "e.end_line", "e.snippet")


def new_version_lines(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """Lines of the second version: line_no % 7 == 3 dropped, % 5 == 2 edited,
    a line added after % 6 == 1. Ordered by ``k``. Of ``files(path, text)``, or of
    every document."""
    from ..operators.lines import split_lines

    ln = split_lines(files, "text") if files is not None else doc_lines(spark, sf_dir)
    n = F.col("line_no")
    own = F.when(n % 7 == 3, F.lit(None)).when(
        n % 5 == 2, F.concat("line", F.lit(" (edited)"))).otherwise(F.col("line"))
    add = F.when(n % 6 == 1, F.concat(F.lit("added after line "), n.cast("string")))
    x = ln.select("path", "line_no", F.explode(F.array(
        F.struct((n * 10).cast("long").alias("k"), own.alias("t")),
        F.struct((n * 10 + 2).cast("long").alias("k"), add.alias("t")))).alias("x"))
    return x.filter(F.col("x.t").isNotNull()).select("path", F.col("x.k").alias("k"), F.col("x.t").alias("line"))


def corpus_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``versions(path, old, new)``: documents against a second version.
    Ids % 4 == 1 unchanged, % 11 == 0 removed, % 13 == 0 also copied to a
    new path (added)."""
    from ..operators.lines import join_lines
    from ..operators.versions import versions

    d = table(spark, sf_dir, "documents").select(doc_path().alias("path"), "doc_id", "text")
    i = F.col("doc_id")
    changed, stays = i % 4 != 1, i % 11 != 0
    # only texts that change are cut into lines, and only their paths meet the new ones
    lines = new_version_lines(spark, sf_dir, d.where(changed & stays).select("path", "text"))
    edited = join_lines(lines, ["path"], "k", "line", "text", final_newline=False)
    new = d.where(changed & stays).select("path").join(edited.select("path", "text"), "path")
    same = d.where(~changed & stays & F.col("text").isNotNull()).select("path", "text")
    copies = d.where(i % 13 == 0).select(F.concat(F.lit("doc/"), i.cast("string"), F.lit("-copy.txt")).alias("path"), "text")
    return versions(d.select("path", "text"), new.unionByName(same).unionByName(copies))


def line_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged delta ``(path, seq, line)`` between a document and its second
    version, lines with terminators: '  ' kept, '- ' removed, '+ ' added."""
    ln = doc_lines(spark, sf_dir)
    n = F.col("line_no")
    end = F.lit("\n")
    items = F.array(
        F.struct((n * 10).cast("long").alias("seq"),
                 F.when(n % 7 == 3, F.concat(F.lit("- "), "line", end))
                 .when(n % 5 == 2, F.concat(F.lit("- "), "line", end))
                 .otherwise(F.concat(F.lit("  "), "line", end)).alias("t")),
        F.struct((n * 10 + 1).cast("long").alias("seq"),
                 F.when((n % 7 != 3) & (n % 5 == 2), F.concat(F.lit("+ "), "line", F.lit(" (edited)"), end))
                 .alias("t")),
        F.struct((n * 10 + 2).cast("long").alias("seq"),
                 F.when(n % 6 == 1, F.concat(F.lit("+ added after line "), n.cast("string"), end)).alias("t")),
    )
    x = ln.select("path", F.explode(items).alias("x"))
    return x.filter(F.col("x.t").isNotNull()).select("path", F.col("x.seq").alias("seq"), F.col("x.t").alias("line"))


# ------------------------------------------------------------------ requests, answers


def render_requests(c: DataFrame) -> DataFrame:
    """``requests(session, turn, text)`` from conversation rows, with exit
    words and blank requests put in by conversation and turn. Works on
    batch and streaming frames alike."""
    i, t = F.col("conv_id"), F.col("turn")
    text = (
        F.when((i % 4 == 1) & (t == 2), F.lit(" EXIT "))
        .when((i % 6 == 2) & (t == 1), F.lit("quit"))
        .when(t % 7 == 3, F.lit("   "))
        .otherwise(F.col("text"))
    )
    return c.select(i.alias("session"), t.alias("turn"), text.alias("text"))


def requests_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_requests(table(spark, sf_dir, "conversations"))


# Request openings used to render routable requests.
REQUEST_OPENINGS = ["remove dead code in ", "convert this project to go: ", "check dependencies of ",
                    "simplify ", "analyze ", None, ""]


def routed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    k = (t % 7).cast("int")
    opening = F.when(k == 5, F.concat(F.lit("refactor lines "), (t + 1).cast("string"), F.lit("~"),
                                      (t + 5).cast("string"), F.lit(" of ")))
    for j, o in enumerate(REQUEST_OPENINGS):
        if o is not None:
            opening = opening.when(k == j, F.lit(o))
    return c.select("conv_id", "turn", F.concat(opening, F.col("text")).alias("text"))


def tool_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, body)`` JSON tool specs rendered from ``events``."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    u = F.col("user_id").cast("string")
    k = (i % 8).cast("int")
    body = (
        F.when(i % 16 == 15, F.concat(F.lit("tool="), F.col("event_type")))
        .when(k == 0, F.concat(F.lit('{"tool": "analyze", "path": "src/'), u, F.lit('"}')))
        .when(k == 1, F.concat(F.lit('{"tool": "refactor_partial", "path": "a.py", "start_line": '), u,
                               F.lit(', "end_line": '), (F.col("user_id") + 3).cast("string"),
                               F.lit(', "kind": "'), F.col("event_type"), F.lit('"}')))
        .when(k == 2, F.concat(F.lit('{"tool": "refactor_partial", "path": "b.py", "start_line": "'), u,
                               F.lit('"}')))
        .when(k == 3, F.lit('{"tool": "refactor_partial", "start_line": "ten"}'))
        .when(k == 4, F.lit('{"tool": "convert_language", "path": "proj", "src_lang": "python", "tgt_lang": "go"}'))
        .when(k == 5, F.lit('{"tool": "convert_language", "tgt_lang": "rust"}'))
        .when(k == 6, F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .otherwise(F.concat(F.lit('{"tool": "deps_analyze", "summary": "false", '),
                            F.expr("substring(props, 2)")))
    )
    return e.select(i.alias("request_id"), body.alias("body"))


def answers_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``answers(key, answer)``: conversion answers rendered from ``events``:
    good and bad file entries, numeric notes, arrays, bad JSON."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    s = i.cast("string")
    u = F.col("user_id").cast("string")
    k = (i % 6).cast("int")
    ans = (
        F.when(k == 0, F.concat(
            F.lit('{"files": [{"path": "src/e'), s, F.lit('.ts", "content": "v'), u,
            F.lit('"}, {"path": '), u, F.lit(', "content": "x"}, {"path": "p'), s,
            F.lit('", "content": null}], "notes": "'), F.col("event_type"), F.lit('"}')))
        .when(k == 1, F.concat(F.lit('{"files": [], "notes": '), u, F.lit("}")))
        .when(k == 2, F.lit("[1, 2, 3]"))
        .when(k == 3, F.concat(F.lit('{"files": '), F.col("props"), F.lit(', "notes": "n"}')))
        .when(k == 4, F.concat(F.lit('{"files": ['), F.col("props"), F.lit(', "oops", {"path": "q.go", "content": "'),
                               F.col("event_type"), F.lit('"}]}')))
        .otherwise(F.concat(F.lit("not json "), F.col("event_type")))
    )
    return e.select(i.alias("key"), ans.alias("answer"))


# Issue types used by the rendering (one outside the allowed set).
RENDER_ISSUE_TYPES = ["missing", "unused", "conflict", "outdated", "other", "bogus"]


def analysis_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``answers(key, answer)``: one dependency analysis per order, its
    issues from the order's line items (JSON written by ``to_json``)."""
    li = table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    typ = F.element_at(F.array(*[F.lit(x) for x in RENDER_ISSUE_TYPES]), (ln % 6 + 1).cast("int"))
    file = (F.when(ln % 4 == 0, F.lit("requirements.txt")).when(ln % 4 == 1, F.lit("package.json"))
            .when(ln % 4 == 2, F.concat(F.lit("docs/"), F.col("l_partkey").cast("string"), F.lit(".md")))
            .otherwise(F.lit("")))
    issue = F.struct(ln.alias("ln"), F.struct(
        typ.alias("type"), file.alias("file"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("detail"),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("suggestion")).alias("i"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(issue)).alias("xs"))
    body = F.to_json(F.struct(
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("summary"),
        F.transform("xs", lambda x: x["i"]).alias("issues")))
    return g.select(F.col("l_orderkey").alias("key"), body.alias("answer"))


def project_files_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(key, path)``: every order has requirements.txt; open orders
    also package.json."""
    o = table(spark, sf_dir, "orders")
    arr = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("requirements.txt"), F.lit("package.json"))) \
        .otherwise(F.array(F.lit("requirements.txt")))
    return o.select(F.col("o_orderkey").alias("key"), F.explode(arr).alias("path"))


# ------------------------------------------------------------------ dependency renderings


def _order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def _project(key) -> F.Column:
    return F.concat(F.lit("order-"), key.cast("string"))


def manifest_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines(project, path, line_no, line)`` of requirement files rendered
    from orders joined with their line items."""
    x = _order_items(spark, sf_dir)
    pk, sk, ln = (F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    k = (F.col("l_linenumber") % 6).cast("int")
    line = (
        F.when(F.col("l_partkey") % 17 == 0, F.lit("# pinned by ops"))
        .when(F.col("l_partkey") % 13 == 5, F.concat(F.lit("\tpart-"), pk, F.lit(">="), ln, F.lit(".0,<"), sk, F.lit(".5")))
        .when(F.col("l_partkey") % 13 == 6, F.concat(F.lit("part-"), pk, F.lit("==="), ln, F.lit(".0")))
        .when(F.col("l_partkey") % 13 == 7, F.concat(F.lit("part-"), pk, F.lit(" @ https://example.org/p-"), pk, F.lit(".whl")))
        .when(F.col("l_partkey") % 13 == 8, F.concat(F.lit("part-"), pk, F.lit(" >= 1 or so")))
        .when(F.col("l_partkey") % 13 == 9, F.concat(F.lit("part-"), pk, F.lit("=="), ln, F.lit(".*")))
        .when(F.col("l_partkey") % 13 == 10, F.concat(F.lit("part-"), pk, F.lit(" (=="), ln, F.lit(".5.0rc1)")))
        .when(k == 0, F.concat(F.lit("part_"), pk, F.lit("=="), sk, F.lit("."), ln))
        .when(k == 1, F.concat(F.lit("Part-"), pk, F.lit(" >= "), sk, F.lit("."), ln,
                               F.lit(' ; python_version >= "3.8"')))
        .when(k == 2, F.concat(F.lit("part."), pk, F.lit("  # no pin")))
        .when(k == 3, F.lit("-r base.txt"))
        .when(k == 4, F.concat(F.lit("part-"), pk, F.lit("[extra]~="), sk, F.lit("."), ln, F.lit("  # compatible")))
        .otherwise(F.concat(F.lit("PyYAML=="), ln, F.lit(".0")))
    )
    path = F.when(F.col("o_orderpriority").startswith("1"), F.lit("requirements-dev.txt")) \
        .otherwise(F.lit("requirements.txt"))
    return x.select(_project(F.col("o_orderkey")).alias("project"), path.alias("path"),
                    F.col("l_linenumber").cast("int").alias("line_no"), line.alias("line"))


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(project, path, content)``: a package.json for each order, its items
    as dependencies (line 3 as a development one); some are no JSON."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    pk, sk, ln = (F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    spec = (F.when(F.col("l_linenumber") == 1, F.concat(F.lit("^"), sk, F.lit(".0.0")))
            .when(F.col("l_linenumber") == 2, F.lit("*"))
            .when(F.col("l_linenumber") == 3, F.concat(sk, F.lit(".1.0-beta")))
            .when(F.col("l_linenumber") == 4, F.lit("git+https://example.org/x.git"))
            .when(F.col("l_linenumber") == 5, F.concat(F.lit(">= "), sk, F.lit(".2")))
            .otherwise(F.lit("latest")))
    item = F.concat(F.lit('"@p/Part-'), pk, F.lit("-"), ln, F.lit('": "'), spec, F.lit('"'))
    dev = F.col("l_linenumber") == 3
    both = [F.array_join(F.array_sort(F.collect_list(F.when(c, item))), ", ").alias(n) for n, c in (("a", ~dev), ("b", dev))]
    g = li.groupBy("l_orderkey").agg(*both)
    content = F.when(F.col("l_orderkey") % 50 == 0, F.lit("[1, 2]")).otherwise(
        F.concat(F.lit('{"dependencies": {'), "a", F.lit('}, "devDependencies": {'), "b", F.lit("}}")))
    return g.select(_project(F.col("l_orderkey")).alias("project"), F.lit("web/package.json").alias("path"), content.alias("content"))


def code_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines(project, path, line_no, line)`` of source files with imports
    rendered from line items: returned-flag 'N' items import their part,
    line numbers pick standard-library, relative, local, JavaScript and
    aliased imports, and line 1 adds an import to the previous order."""
    x = _order_items(spark, sf_dir)
    pk = F.col("l_partkey").cast("string")
    ln = F.col("l_linenumber")
    own = _project(F.col("o_orderkey"))

    def item(project, path, line):
        return F.struct(project.alias("project"), F.lit(path).alias("path"), line.alias("line"))

    # At most two lines per item: its own import when flagged 'N', and the
    # line picked by its line number (the cases are exclusive, so only the
    # matching branch is built).
    flagged = F.when(F.col("l_returnflag") == "N", item(own, "main.py", F.concat(F.lit("import part_"), pk)))
    by_number = (
        F.when(ln == 1, item(_project(F.col("o_orderkey") - 1), "lib/helpers.py",
                             F.concat(F.lit("from part_"), pk, F.lit(".sub import thing"))))
        .when(ln == 2, item(own, "main.py", F.lit("import os, sys as system  # read, write")))
        .when(ln == 3, item(own, "main.py", F.lit("from . import sibling")))
        .when(ln == 4, item(own, "main.py", F.lit("from util import helper")))
        .when(ln == 5, item(own, "web/index.js", F.concat(F.lit("const x = require('@scope/part-"), pk,
                                                          F.lit("/sub')"))))
        .when(ln == 6, item(own, "web/index.js", F.lit("import y from 'lodash'")))
        .when(ln == 7, item(own, "main.py", F.lit("import yaml; import re")))
    )
    out = x.select(ln.cast("int").alias("line_no"), F.explode(F.array(flagged, by_number)).alias("s"))
    return out.filter(F.col("s").isNotNull()).select("s.project", "s.path", "line_no", "s.line")


def code_files(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """``files(project, path)`` of the rendered source tree: the files that
    have lines (``lines``: those of ``code_file_lines``, if written before), plus
    ``util.py`` in finished orders."""
    from_lines = (code_file_lines(spark, sf_dir) if lines is None else lines).select("project", "path")
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    util = o.select(_project(F.col("o_orderkey")).alias("project"), F.lit("util.py").alias("path"))
    return from_lines.unionByName(util).distinct()


# Caller tables for the dependency checks.
ALIASES = [("yaml", "PyYAML"), ("dotenv", "python-dotenv"), ("sklearn", "scikit-learn")]
STDLIB = ["os", "sys", "json", "re", "typing", "pathlib", "collections"]


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``latest(pkg, version)`` from ``part``: ``part-<key>`` at ``<size>.5``."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("pkg"),
                    F.concat(F.col("p_size").cast("string"), F.lit(".5")).alias("version"))


def part_code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines(path, line_no, line)``: one Python file per brand, one line per
    part (line number = part key), the statement picked by size."""
    p = table(spark, sf_dir, "part")
    k = (F.col("p_size") % 6).cast("int")
    pk = F.col("p_partkey")
    s = F.col("p_size").cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit("import m"), s))
        .when(k == 1, F.concat(F.lit("def f"), pk.cast("string"), F.lit("(x):")))
        .when(k == 2, F.concat(F.lit("    return f"), (pk - 1).cast("string"), F.lit("(x) + v"),
                               (pk - 2).cast("string")))
        .when(k == 3, F.concat(F.lit("v"), pk.cast("string"), F.lit(" = "), s))
        .when(k == 4, F.concat(F.lit("class C"), pk.cast("string"), F.lit(":")))
        .otherwise(F.concat(F.lit("from pkg"), s, F.lit(" import name"), pk.cast("string"), F.lit(" as alias"),
                            pk.cast("string")))
    )
    path = F.concat(F.lit("brand"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(".py"))
    return p.select(path.alias("path"), pk.cast("int").alias("line_no"), line.alias("line"))


def part_script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines(project, path, line_no, line)``: one Python file per brand with
    comments, docstrings, strings that open and close over many lines, f-strings
    and continued lines around its definitions and uses."""
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    own, prev, back = (x.cast("string") for x in (pk, pk - 1, pk - 2))
    s = F.col("p_size").cast("string")

    def text(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    kinds = [
        text("import m", own),
        text("def f", own, "(x):"),
        text("    return f", prev, "(x) + v", back),
        text("v", own, " = ", s),
        text("class C", own, ":"),
        text("from pkg", s, " import name", own, " as alias", own),
        text("# f", prev, " is old, 'see v", back),
        text('    """ doc of f', prev, ' """'),
        text('text = """starts with v', prev),
        text("ends v", back, '""" + f', prev, "(1)"),
        text("w", own, " = 'it\\'s # no comment' + v", prev),
        text("y", own, " = 1 + \\"),
        text("s", own, " = r'part one \\"),
        text('print(f"{v', prev, "} is # v", back, '")'),
        text("x = '''a''' ; import os", own, " # v", prev),
    ]
    line = F.element_at(F.array(*kinds), (F.col("p_size") % len(kinds) + 1).cast("int"))
    path = F.concat(F.lit("brand"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(".py"))
    number = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return p.select(F.lit("parts").alias("project"), path.alias("path"), number.alias("line_no"), line.alias("line"))


def range_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines(project, path, line_no, line)``: requirement files in which several
    lines bound the same two packages of an order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    a = F.col("l_suppkey") % 3 + 1
    b = F.floor(F.col("l_partkey") / 10) % 4
    v = F.concat(a.cast("string"), F.lit("."), b.cast("string"))
    clauses = ["==", ">=", "<", "<=", ">", "!=", "==", "~=", "!=", ">="]
    ends = [v, v, v, F.concat(v, F.lit("rc1")), v, v, F.concat(a.cast("string"), F.lit(".*")), v,
            F.concat(a.cast("string"), F.lit(".*")), F.concat(v, F.lit(",<"), (a + 1).cast("string"), F.lit(".0"))]
    spec = picked(F.col("l_partkey") % 10, [F.concat(F.lit(c), e) for c, e in zip(clauses, ends)])
    line = F.concat(F.lit("lib-"), (F.col("l_linenumber") % 2).cast("string"), spec)
    return li.select(_project(F.col("l_orderkey")).alias("project"), F.lit("requirements.txt").alias("path"),
                     F.col("l_linenumber").cast("int").alias("line_no"), line.alias("line"))


def include_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines(project, path, line_no, line)``: requirement files of orders that
    include each other: chains, cycles, constraints, missing files and addresses."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    ln, pk = F.col("l_linenumber"), F.col("l_partkey").cast("string")

    def f(n):
        return F.concat(F.lit("f"), (ln + n).cast("string"), F.lit(".txt"))

    kinds = [
        F.concat(F.lit("-r "), f(1)), F.concat(F.lit("-r ./"), f(2)), F.lit("-c ../constraints/c.txt  # shared"),
        F.lit("-r ../requirements.txt"), F.concat(F.lit("--requirement=../deps/"), f(1)), F.lit("-r https://example.org/x.txt"),
        F.lit("-r ../../up.txt"), F.concat(F.lit("-c "), f(3)),
    ]
    include = picked(F.col("l_partkey") % len(kinds), kinds)
    pin = F.concat(F.lit("part-"), pk, F.lit("=="), ln.cast("string"), F.lit(".0"))

    def rows(df, project, path, lines):
        x = df.select(_project(project).alias("project"), path.alias("path"), F.posexplode(F.array(*lines)).alias("n", "line"))
        return x.select("project", "path", (F.col("n") + 1).alias("line_no"), "line")

    root = rows(o, F.col("o_orderkey"), F.lit("requirements.txt"), [F.lit("-r deps/f1.txt"), F.lit("root-pkg>=1")])
    shared = rows(o, F.col("o_orderkey"), F.lit("constraints/c.txt"), [F.lit("shared-pkg<2"), F.lit("-r ../deps/f2.txt")])
    deps_files = rows(li, F.col("l_orderkey"), F.concat(F.lit("deps/f"), ln.cast("string"), F.lit(".txt")), [include, pin])
    return root.unionByName(shared).unionByName(deps_files)
