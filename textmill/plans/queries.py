"""Registered queries: one per operator of the inventory, on the driver tables.

Every query takes ``(spark, sf_dir)``, reads whole tables and returns a
DataFrame whose column names match the SQL in ``plans/oracle.py``. Text
results are returned as ``md5`` so both engines compare cheaply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as ans
from ..operators import chunking, corpus, deps, hygiene, includes, infer, lexical, lines, prompts, ranges, repeats, rewrite
from ..operators import line_delta as deltas
from ..operators import requests as req
from ..operators import version_ranges
from ..operators import versions as vers
from ..session import materialize, scratch_path
from ..streaming import requests as req_stream
from . import stubs
from .tables import (
    ALIASES, STDLIB, analysis_answers, answers_from_events, code_file_lines, code_files, corpus_versions,
    doc_lines, doc_path, edited_tree, edits, files_from_documents, include_file_lines, latest_versions, line_delta, manifest_file_lines, package_files,
    part_code_lines, part_script_lines, project_files_from_orders, range_file_lines, render_requests, requests_from_conversations,
    routed_requests, selections, stream_source, table, tool_specs,
)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def md5(col) -> F.Column:
    return F.md5(F.col(col) if isinstance(col, str) else col)


def big(col) -> F.Column:
    return (F.col(col) if isinstance(col, str) else col).cast("long")


# ---------------------------------------------------------------- chunking


@query
def chunk_chars(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ch = chunking.chunk_chars(docs, "text", 8000, 200)
    return ch.select(
        "doc_id", "chunk_no", big("start").alias("start"),
        big(F.char_length("chunk")).alias("chunk_chars"), md5("chunk").alias("chunk_md5"),
    )


@query
def chunk_counts(spark, sf_dir):
    """The first slice: chunks per source (partial aggregation before the shuffle)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    ch = chunking.chunk_chars(docs, "text", 8000, 200)
    return ch.groupBy("source").agg(
        F.count_distinct("doc_id").alias("n_docs"),
        F.count("*").alias("n_chunks"),
        F.sum(F.char_length("chunk")).cast("long").alias("chunk_chars"),
    )


@query
def chunk_lines_no_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ch = chunking.chunk_lines(docs, "text", 500, 0)
    return ch.select(
        "doc_id", "chunk_no", "start_line",
        big(F.char_length("chunk")).alias("chunk_chars"), md5("chunk").alias("chunk_md5"),
    )


@query
def chunk_lines_overlap(spark, sf_dir):
    """Default overlap (20 lines carried) at 500 characters: rows-only check,
    invariants in tests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ch = chunking.chunk_lines(docs, "text", 500, 200)
    return ch.select(
        "doc_id", "chunk_no", "start_line",
        big(F.char_length("chunk")).alias("chunk_chars"), md5("chunk").alias("chunk_md5"),
    )


# ---------------------------------------------------------------- lines, strings


@query
def split_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.split_lines(docs, "text")
    return out.select("doc_id", big("line_no").alias("line_no"), "line")


@query
def join_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = lines.join_lines(lines.split_lines(docs, "text"), ["doc_id"])
    return joined.select("doc_id", "n_lines", md5("text").alias("text_md5"))


def _wrapped_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = F.col("text")
    k = F.col("turn") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit("```python\n"), t, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("```\n"), t, F.lit("\n```  ")))
        .when(k == 2, F.concat(F.lit("  "), t, F.lit("\n")))
        .when(k == 3, F.concat(F.lit("```"), t))
        .otherwise(F.concat(F.lit("```"), t, F.lit("```")))
    )
    return c.select("conv_id", "turn", raw.alias("raw"))


@query
def fences(spark, sf_dir):
    w = _wrapped_conversations(spark, sf_dir)
    cleaned = T.strip_code_fences("raw")
    return w.select("conv_id", "turn", md5(cleaned).alias("cleaned_md5"),
                    big(F.char_length(cleaned)).alias("cleaned_chars"))


@query
def echo(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nxt = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    c = c.select("conv_id", "turn", "text", nxt.alias("nxt"))
    k = F.col("turn") % 4
    answer = (
        F.when(k == 0, F.concat("text", F.lit("\n"), "nxt"))
        .when(k == 1, F.col("text"))
        .when(k == 2, F.col("nxt"))
        .otherwise(F.concat("text", F.lit(" "), "text", F.lit(" ok")))
    )
    out = T.drop_echo(answer, F.col("text"))
    return c.select("conv_id", "turn", md5(out).alias("answer_md5"))


@query
def suffix_safe_name(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    upath = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    ext = F.element_at(F.array(F.lit(".html"), F.lit(""), F.lit(".tar.gz")), (F.col("page_id") % 3 + 1).cast("int"))
    p = p.select("page_id", "url", F.concat(upath, ext).alias("p"))
    return p.select(
        "page_id",
        T.path_suffix("p").alias("suffix"),
        T.swap_suffix("p", ".md").alias("swapped"),
        T.safe_name("url").alias("safe_url"),
    )


# ---------------------------------------------------------------- corpus


# The caller's extension table used by the language queries.
EXTENSIONS = [(".py", "python"), (".js", "javascript"), (".go", "go")]


def _extensions(spark):
    return spark.createDataFrame(EXTENSIONS, "suffix string, language string")


@query
def exclude_paths(spark, sf_dir):
    f = files_from_documents(spark, sf_dir)
    return corpus.exclude_paths(f, corpus.LISTING_EXCLUDES).select("project", "path")


@query
def corpus_cap(spark, sf_dir):
    """Every file with what becomes of it under a caller's limits."""
    f = files_from_documents(spark, sf_dir)
    out = corpus.corpus_status(f, max_files=8, max_bytes=16_000)
    return out.select("project", "path", "length", "status")


@query
def collect_corpus(spark, sf_dir):
    out = corpus.collect_corpus(files_from_documents(spark, sf_dir))
    return out.select("project", "path", "length", md5("content").alias("content_md5"))


@query
def head_text(spark, sf_dir):
    f = corpus.exclude_paths(files_from_documents(spark, sf_dir), corpus.LISTING_EXCLUDES)
    out = corpus.head_text(f)
    return out.select("project", "path", md5("head").alias("head_md5"),
                      big(F.char_length("head")).alias("head_chars"))


@query
def tag_language(spark, sf_dir):
    f = files_from_documents(spark, sf_dir)
    return corpus.tag_language(f, _extensions(spark)).select("project", "path", "language")


@query
def corpus_profile(spark, sf_dir):
    f = corpus.tag_language(files_from_documents(spark, sf_dir), _extensions(spark))
    return corpus.corpus_profile(f)


@query
def files_block(spark, sf_dir):
    f = corpus.tag_language(files_from_documents(spark, sf_dir), _extensions(spark))
    out = corpus.files_block(f)
    return out.select("project", "pack", "n_files", big(F.char_length("block")).alias("block_chars"),
                      md5("block").alias("block_md5"))


@query
def build_snapshot(spark, sf_dir):
    f = corpus.collect_corpus(files_from_documents(spark, sf_dir))
    snap = corpus.build_snapshot(f, "python", "go")
    flat = snap.select("root", "pack", "summary", F.posexplode("files").alias("pos", "f"))
    return flat.select("root", "pack", "summary", big("pos").alias("pos"), F.col("f.path").alias("path"),
                       F.col("f.language").alias("language"), md5("f.content").alias("content_md5"))


# ---------------------------------------------------------------- ranges, versions, blocks


@query
def extract_ranges(spark, sf_dir):
    out = ranges.extract_ranges(doc_lines(spark, sf_dir), selections(spark, sf_dir))
    return out.select("sel_id", "path", big("start_line").alias("start_line"), big("end_line").alias("end_line"),
                      md5("snippet").alias("snippet_md5"), "n_snippet_lines", "error")


@query
def apply_edits(spark, sf_dir):
    new_lines, _ = ranges.apply_edits(doc_lines(spark, sf_dir), edits(spark, sf_dir))
    joined = lines.join_lines(new_lines, ["path"])
    return joined.select("path", "n_lines", md5("text").alias("text_md5"))


@query
def edit_status(spark, sf_dir):
    _, status = ranges.apply_edits(doc_lines(spark, sf_dir), edits(spark, sf_dir))
    return status.select("edit_id", "path", "error")


@query
def edited_files(spark, sf_dir):
    """Lines of every file after its edits; empty files and whole deletions too."""
    files, changes = edited_tree(spark, sf_dir)
    return ranges.edited_files(doc_lines(spark, sf_dir), changes, files)


@query
def edit_tree_status(spark, sf_dir):
    files, changes = edited_tree(spark, sf_dir)
    new_lines, status = ranges.apply_edits(doc_lines(spark, sf_dir), changes, files=files)
    n = new_lines.groupBy("path").agg(F.count("*").alias("n_lines"), F.max("line_no").cast("long").alias("last_line"))
    return status.select("edit_id", "path", "error").join(n, "path", "left")


@query
def duplicate_blocks(spark, sf_dir):
    return hygiene.duplicate_blocks(doc_lines(spark, sf_dir), k=2)


@query
def duplicate_long_blocks(spark, sf_dir):
    """Runs longer than the bucket that lines are grouped by."""
    return hygiene.duplicate_blocks(doc_lines(spark, sf_dir), k=5, bucket=3)


@query
def repeated_runs(spark, sf_dir):
    return repeats.repeated_runs(doc_lines(spark, sf_dir), k=2)


@query
def run_places(spark, sf_dir):
    return repeats.run_places(doc_lines(spark, sf_dir), k=4)


@query
def snapshot_diff(spark, sf_dir):
    return vers.snapshot_diff(corpus_versions(spark, sf_dir))


@query
def changed_only(spark, sf_dir):
    v = vers.changed_only(corpus_versions(spark, sf_dir))
    return v.select("path", vers.status_col().alias("status"), md5("old").alias("old_md5"),
                    md5("new").alias("new_md5"))


@query
def restore_side(spark, sf_dir):
    delta = line_delta(spark, sf_dir)
    s1 = vers.restore_side(delta, 1).withColumn("side", F.lit(1).cast("long"))
    s2 = vers.restore_side(delta, 2).withColumn("side", F.lit(2).cast("long"))
    out = s1.unionByName(s2)
    return out.select("path", "side", "n_lines", md5("text").alias("text_md5"))


# ---------------------------------------------------------------- requests, answers


@query
def session_requests(spark, sf_dir):
    r = req.session_requests(requests_from_conversations(spark, sf_dir))
    return r.select("session", "turn", md5("text").alias("text_md5"))


@query
def route_requests(spark, sf_dir):
    return req.route_requests(routed_requests(spark, sf_dir)).select("conv_id", "turn", "tool", "start_line", "end_line")


@query
def normalize_requests(spark, sf_dir):
    return req.normalize_requests(tool_specs(spark, sf_dir)).drop("body")


@query
def parse_answers(spark, sf_dir):
    p = ans.parse_answers(answers_from_events(spark, sf_dir))
    return p.select("key", "kind", "error", ans.answer_notes(p).alias("notes"))


@query
def converted_files(spark, sf_dir):
    p = ans.parse_answers(answers_from_events(spark, sf_dir))
    f = ans.converted_files(p)
    return f.select("key", "pos", "path", md5("content").alias("content_md5"))


@query
def answer_summary(spark, sf_dir):
    """Good and bad answers, one row each."""
    good = analysis_answers(spark, sf_dir).select(F.concat(F.lit("o"), F.col("key").cast("string")).alias("key"), "answer")
    other = answers_from_events(spark, sf_dir).select(F.concat(F.lit("e"), F.col("key").cast("string")).alias("key"), "answer")
    out = ans.answer_summary(ans.parse_answers(good.unionByName(other)))
    return out.select("key", "summary", "n_issues", "error")


@query
def resolve_scope(spark, sf_dir):
    """Conversion requests that name files, folders and neither."""
    files = files_from_documents(spark, sf_dir)
    i = F.col("doc_id")
    folder = F.split("path", "/")[0]
    path = (F.when(i % 5 == 0, F.col("path")).when(i % 5 == 1, F.concat(F.lit("./"), folder, F.lit("/"))).when(i % 5 == 2, F.lit("."))
            .when(i % 5 == 3, F.concat(F.lit("gone/"), F.col("path"))).otherwise(F.col("path")))
    scope = F.element_at(F.array(F.lit("auto"), F.lit("file"), F.lit("project")), (i % 3 + 1).cast("int"))
    requests = files.select("doc_id", path.alias("path"), scope.alias("scope"))
    return req.resolve_scope(requests, files.select("path"))


@query
def issues_table(spark, sf_dir):
    return ans.issues_table(ans.parse_answers(analysis_answers(spark, sf_dir)))


@query
def issue_report(spark, sf_dir):
    it = ans.issues_table(ans.parse_answers(analysis_answers(spark, sf_dir)))
    rep = ans.issue_report(it, project_files_from_orders(spark, sf_dir))
    return rep.select("key", "file", "n_issues", "status", md5("report").alias("report_md5"))


@query
def issue_counts(spark, sf_dir):
    return ans.issue_counts(ans.issues_table(ans.parse_answers(analysis_answers(spark, sf_dir))))


# ---------------------------------------------------------------- dependencies, hygiene


def _reqs(spark, sf_dir):
    return deps.parse_manifests(manifest_file_lines(spark, sf_dir))


def _code(spark, sf_dir):
    """Lines of code, read several times: rendered once."""
    return materialize(code_file_lines(spark, sf_dir), "code-lines")


def _imports(spark, sf_dir, code=None):
    return deps.extract_imports(code_file_lines(spark, sf_dir) if code is None else code)


def _alias(spark):
    return spark.createDataFrame(ALIASES, "module string, pkg string")


def _stdlib(spark):
    return spark.createDataFrame([(m,) for m in STDLIB], "module string")


@query
def parse_manifests(spark, sf_dir):
    return _reqs(spark, sf_dir).select("project", "file", big("line_no").alias("line_no"), "clause", "pkg", "op",
                                       "version", "marker", "kind")


@query
def package_json(spark, sf_dir):
    return deps.parse_package_json(package_files(spark, sf_dir)).drop("line_no", "clause")


@query
def extract_imports(spark, sf_dir):
    return _imports(spark, sf_dir).select("project", "path", big("line_no").alias("line_no"), "module")


@query
def unused_deps(spark, sf_dir):
    out = deps.unused_deps(_reqs(spark, sf_dir), _imports(spark, sf_dir, _code(spark, sf_dir)), _alias(spark))
    return out.select("project", "file", big("line_no").alias("line_no"), "pkg")


@query
def missing_deps(spark, sf_dir):
    code = _code(spark, sf_dir)
    mods = deps.project_modules(code_files(spark, sf_dir, code))
    return deps.missing_deps(_reqs(spark, sf_dir), _imports(spark, sf_dir, code), _alias(spark), _stdlib(spark), mods)


@query
def version_conflicts(spark, sf_dir):
    return deps.version_conflicts(_reqs(spark, sf_dir))


@query
def delta_sides(spark, sf_dir):
    """The delta of two versions, and both sides restored from it. The delta comes
    dealt by path, so counts and sides read its one shuffle."""
    delta = deltas.line_delta(corpus_versions(spark, sf_dir))
    tag = F.substring("line", 1, 2)
    n = delta.groupBy("path").agg(F.count(F.when(tag != "+ ", 1)).alias("n_old"), F.count(F.when(tag != "- ", 1)).alias("n_new"))
    one, two = (vers.restore_side(delta, s).select("path", md5("text").alias(name)) for s, name in ((1, "old_md5"), (2, "new_md5")))
    return n.join(one.join(two, "path", "full_outer"), "path", "left")


@query
def unsatisfiable_ranges(spark, sf_dir):
    return version_ranges.unsatisfiable(deps.parse_manifests(range_file_lines(spark, sf_dir)))


@query
def manifest_includes(spark, sf_dir):
    files = includes.included_files(include_file_lines(spark, sf_dir))
    return files.select("project", "file", "kind", big("depth").alias("depth"))


@query
def include_errors(spark, sf_dir):
    errors = includes.include_errors(include_file_lines(spark, sf_dir))
    return errors.select("project", "file", big("line_no").alias("line_no"), "target", "error")


@query
def manifest_closure(spark, sf_dir):
    rows = includes.parse_closure(include_file_lines(spark, sf_dir))
    return rows.select("project", "file", big("line_no").alias("line_no"), "pkg", "op", "version", "kind")


@query
def outdated_deps(spark, sf_dir):
    out = deps.outdated_deps(_reqs(spark, sf_dir), latest_versions(spark, sf_dir))
    return out.select("project", "file", big("line_no").alias("line_no"), "pkg", "version", "latest")


@query
def deps_issues(spark, sf_dir):
    """The four dependency checks as one issue table."""
    # each is read by several checks: parsed once
    code = _code(spark, sf_dir)
    reqs, imps = materialize(_reqs(spark, sf_dir), "reqs"), materialize(_imports(spark, sf_dir, code), "imports")
    alias = _alias(spark)
    mods = deps.project_modules(code_files(spark, sf_dir, code))
    return deps.deps_issues(
        deps.unused_deps(reqs, imps, alias),
        deps.missing_deps(reqs, imps, alias, _stdlib(spark), mods),
        deps.version_conflicts(reqs),
        deps.outdated_deps(reqs, latest_versions(spark, sf_dir)),
    ).drop("pos")


@query
def unused_definitions(spark, sf_dir):
    out = hygiene.unused_definitions(part_code_lines(spark, sf_dir))
    return out.select("path", big("line_no").alias("line_no"), "kind", "name")


@query
def code_lines(spark, sf_dir):
    out = lexical.code_lines(part_script_lines(spark, sf_dir), ("project", "path"))
    return out.select("path", big("line_no").alias("line_no"), big("state").alias("state"), "code")


@query
def unused_in_code(spark, sf_dir):
    out = hygiene.unused_definitions(part_script_lines(spark, sf_dir))
    return out.select("path", big("line_no").alias("line_no"), "kind", "name")


@query
def imports_in_code(spark, sf_dir):
    out = deps.extract_imports(part_script_lines(spark, sf_dir))
    return out.select("path", big("line_no").alias("line_no"), "module")


# ---------------------------------------------------------------- prompts, inference, rewrites


STUB = stubs.replace_stub("the", "THE")


def _doc_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("project"), doc_path().alias("path"), F.col("text").alias("code"), "doc_id")


@query
def render_prompts(spark, sf_dir):
    p = prompts.render_prompts(_doc_files(spark, sf_dir), "dead_code")
    return p.select("path", md5("system_prompt").alias("system_md5"), md5("user_prompt").alias("user_md5"),
                    big(F.char_length("user_prompt")).alias("user_chars"))


@query
def batch_infer(spark, sf_dir):
    p = prompts.render_prompts(_doc_files(spark, sf_dir), "dead_code")
    a = infer.batch_infer(p, STUB)
    return a.select("path", md5(T.strip_code_fences("answer")).alias("answer_md5"), "error")


@query
def answer_store(spark, sf_dir):
    """Two rounds over one store: the second asks for what the first did not."""
    p = prompts.render_prompts(_doc_files(spark, sf_dir), "dead_code")
    store = scratch_path(spark, "answer-store")
    infer.batch_infer(p.where(F.col("doc_id") % 2 == 0), STUB, store=store)
    a = infer.batch_infer(p, STUB, store=store, store_batch=5000)
    return a.select("path", md5(T.strip_code_fences("answer")).alias("answer_md5"), "error")


def _approvals(spark, sf_dir, files):
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("approved"))
    return files.select("project", "path", "doc_id").join(lab, "doc_id").drop("doc_id")


@query
def rewrite_corpus(spark, sf_dir):
    f = _doc_files(spark, sf_dir).withColumnRenamed("code", "content")
    out = rewrite.rewrite_corpus(f.drop("doc_id"), "dead_code", STUB, _approvals(spark, sf_dir, f))
    return out.select("project", "path", "status", md5("new").alias("new_md5"))


@query
def write_approved(spark, sf_dir):
    v = corpus_versions(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(doc_path().alias("path"), (F.col("quality") == 1).alias("approved"))
    out = rewrite.write_approved(v, lab, dry_run=True, keys=("path",))
    return out.select("path", "status")


@query
def write_rounds(spark, sf_dir):
    """Two rounds of approvals written and read back: the second adds a version."""
    v = corpus_versions(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(doc_path().alias("path"), "quality", "toxic")
    out = scratch_path(spark, "write-rounds")
    for name, rule in (("1", F.col("quality") == 1), ("2", F.col("toxic") == 1)):
        approvals = lab.select("path", rule.alias("approved"))
        twice = approvals.unionByName(approvals)  # a repeated approval changes nothing
        rewrite.write_approved(v, twice, out, dry_run=False, keys=("path",), version=name)
    got = rewrite.read_written(spark, out, keys=("path",))
    return got.select("path", "version", md5("content").alias("content_md5"))


@query
def partial_rewrite_apply(spark, sf_dir):
    """The selections rewritten and applied: the lines afterwards."""
    _, new_lines = rewrite.partial_rewrite(doc_lines(spark, sf_dir), selections(spark, sf_dir), STUB, dry_run=False)
    joined = lines.join_lines(new_lines, ["path"])
    return joined.select("path", "n_lines", md5("text").alias("text_md5"))


@query
def partial_rewrite(spark, sf_dir):
    res, _ = rewrite.partial_rewrite(doc_lines(spark, sf_dir), selections(spark, sf_dir), STUB)
    return res.select("sel_id", "path", big("start_line").alias("start_line"), big("end_line").alias("end_line"),
                      md5("original_snippet").alias("original_md5"),
                      md5("refactored_snippet").alias("refactored_md5"), "applied", "error")


@query
def place_outputs(spark, sf_dir):
    conv = ans.converted_files(ans.parse_answers(answers_from_events(spark, sf_dir)))
    e = table(spark, sf_dir, "events")
    orig = e.select(
        F.col("event_id").alias("key"),
        F.concat(F.lit("src/e"), F.col("event_id").cast("string"), F.lit(".py")).alias("orig_path"),
        F.concat(F.lit("proj"), F.col("user_id").cast("string")).alias("root"),
        (F.col("event_id") % 2 == 0).alias("single"),
    )
    return rewrite.place_outputs(conv, orig, "Type Script")


@query
def convert_projects(spark, sf_dir):
    """Whole projects converted to Go by a deterministic stand-in model."""
    f = corpus.collect_corpus(files_from_documents(spark, sf_dir)).select("project", "path", "content")
    f = f.withColumn("language", F.lit("unknown"))
    out, _ = rewrite.convert_projects(f, "python", "go", stubs.convert_stub(".go"))
    return out.select("project", "pack", "pos", "path", "target_path", "action", md5("content").alias("content_md5"),
                      "error")


# ---------------------------------------------------------------- streaming


@query
def request_stream_dead(spark, sf_dir):
    """The other sink of the stream: blank requests and those after an exit."""
    schema = table(spark, sf_dir, "conversations").schema
    out = req_stream.request_stream(spark, stream_source(sf_dir, "conversations"), schema, render_requests)
    dead = req_stream.read_sink(spark, out, "dead")
    return dead.select("session", "turn", "status")


@query
def request_stream(spark, sf_dir):
    """The session rules on a stream of conversation files: same rows as
    ``session_requests``."""
    schema = table(spark, sf_dir, "conversations").schema
    out = req_stream.request_stream(spark, stream_source(sf_dir, "conversations"), schema, render_requests)
    good = req_stream.read_sink(spark, out, "good")
    return good.select("session", "turn", md5("text").alias("text_md5"))
