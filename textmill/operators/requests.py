"""Requests: session order and exit, routing by rules, typed tool specs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

# Words that end a session.
EXIT_WORDS = ["exit", "quit"]
# The six tools and the six rewrite kinds.
TOOLS = ["analyze", "refactor_dead_code", "refactor_simplify", "refactor_partial", "convert_language", "deps_analyze"]
KINDS = ["style", "bugfix", "performance", "readability", "cleanup", "custom"]

# Routing rules (ours), tried in this order on the lower-cased text.
LINE_RANGE = r"(\d+)\s*[~-]\s*(\d+)"
ROUTES = [
    ("refactor_dead_code", r"dead[ _-]?code"),
    ("convert_language", r"convert|translate|migrate"),
    ("deps_analyze", r"dependenc|package|requirement|version"),
    ("refactor_simplify", r"simplif|clean|refactor"),
    ("analyze", r"analy[sz]|explain|review"),
]


def is_exit(text) -> F.Column:
    return F.lower(py_strip(text)).isin(EXIT_WORDS)


def session_requests(df: DataFrame, session: str = "session", turn: str = "turn", text: str = "text") -> DataFrame:
    """Requests in turn order with blank ones and everything from the first
    exit/quit on dropped.

    The first exit per session is a partial aggregation (one row per
    session), joined back on the session key; a session of any size never
    has to sit in one window partition."""
    first_exit = df.filter(is_exit(F.col(text))).groupBy(session).agg(F.min(turn).alias("_exit_turn"))
    out = df.join(first_exit, session, "left")
    keep = (F.col("_exit_turn").isNull() | (F.col(turn) < F.col("_exit_turn"))) & (py_strip(F.col(text)) != "")
    return out.filter(keep).drop("_exit_turn")


def route_requests(df: DataFrame, text: str = "text") -> DataFrame:
    """``tool`` by words in the text; a line range ``a~b`` / ``a-b`` wins as a
    partial rewrite and fills ``start_line``/``end_line``. No match: NULL."""
    low = F.lower(F.col(text))
    has_range = low.rlike(LINE_RANGE)
    tool = F.when(has_range, F.lit("refactor_partial"))
    for name, pat in ROUTES:
        tool = tool.when(low.rlike(pat), F.lit(name))
    start = F.when(has_range, F.regexp_extract(low, LINE_RANGE, 1).try_cast("bigint"))
    end = F.when(has_range, F.regexp_extract(low, LINE_RANGE, 2).try_cast("bigint"))
    return df.withColumn("tool", tool).withColumn("start_line", start).withColumn("end_line", end)


def _vtype(v, path):
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def normalize_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Typed columns with defaults from a JSON tool spec, plus ``error``.

    Defaults: path '.', summary true, start_line 1, end_line = start_line,
    kind 'custom', instruction and global_instruction '', scope 'auto',
    target_stack_desc from tgt_lang. Errors, first one wins: not a JSON
    object; unknown tool; summary not a JSON boolean; start_line or end_line
    not an integer; conversion without src_lang and tgt_lang.
    """
    v = F.try_parse_json(F.col(body))
    d = df.withColumn("_v", v)
    v = F.col("_v")

    def s(path):
        return F.try_variant_get(v, path, "string")

    def present(path):
        return _vtype(v, path).isNotNull() & (_vtype(v, path) != "VOID")

    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    tool = s("$.tool")
    start_raw = F.try_variant_get(v, "$.start_line", "bigint")
    end_raw = F.try_variant_get(v, "$.end_line", "bigint")
    start = F.coalesce(start_raw, F.lit(1).cast("long"))
    tgt = s("$.tgt_lang")
    error = (
        F.when(~is_obj, F.lit("not a JSON object"))
        .when(tool.isNull() | ~tool.isin(TOOLS), F.lit("unknown tool"))
        .when(present("$.summary") & (_vtype(v, "$.summary") != "BOOLEAN"), F.lit("summary must be a boolean"))
        .when(present("$.start_line") & start_raw.isNull(), F.lit("start_line is not an integer"))
        .when(present("$.end_line") & end_raw.isNull(), F.lit("end_line is not an integer"))
        .when((tool == "convert_language") & (F.coalesce(s("$.src_lang"), F.lit("")).eqNullSafe("")
                                              | F.coalesce(tgt, F.lit("")).eqNullSafe("")),
              F.lit("src_lang and tgt_lang are required"))
    )
    kind = F.coalesce(s("$.kind"), F.lit("custom"))
    cols = [c for c in df.columns]
    out = d.select(
        *cols,
        F.when(is_obj, tool).alias("tool"),
        F.when(is_obj, F.coalesce(s("$.path"), F.lit("."))).alias("path"),
        F.when(is_obj, F.when(_vtype(v, "$.summary") == "BOOLEAN", F.try_variant_get(v, "$.summary", "boolean"))
               .otherwise(F.lit(True))).alias("summary"),
        F.when(is_obj, start).alias("start_line"),
        F.when(is_obj, F.coalesce(end_raw, start)).alias("end_line"),
        F.when(is_obj, kind).alias("kind"),
        F.when(is_obj, kind.isin(KINDS)).alias("valid_kind"),
        F.when(is_obj, F.coalesce(s("$.instruction"), F.lit(""))).alias("instruction"),
        F.when(is_obj, F.coalesce(s("$.global_instruction"), F.lit(""))).alias("global_instruction"),
        F.when(is_obj, F.coalesce(s("$.scope"), F.lit("auto"))).alias("scope"),
        F.when(is_obj, s("$.src_lang")).alias("src_lang"),
        F.when(is_obj, tgt).alias("tgt_lang"),
        F.when(is_obj, F.coalesce(
            F.when(s("$.target_stack_desc") != "", s("$.target_stack_desc")),
            F.concat(F.lit("An idiomatic "), tgt, F.lit(" project using its standard library.")),
        )).alias("target_stack_desc"),
        error.alias("error"),
    )
    return out


def resolve_scope(requests: DataFrame, files: DataFrame) -> DataFrame:
    """What a conversion request means by its path: adds ``target`` 'file' or
    'project', ``n_files`` and ``error``, given ``files(path)``.

    A path that is a file, or a folder of files ('.' is the folder of all); with
    scope 'auto' what it is decides, 'file' needs a file and 'project' a folder
    (for a file, its own folder). A folder's files are counted over the parent
    folders of every file, an aggregation with map-side partial sums."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    folders = files.select(F.explode(ups).alias("_folder")).groupBy("_folder").agg(F.count("*").alias("_n"))
    named = files.select(F.col("path").alias("_file")).distinct()
    clean = F.regexp_replace(F.regexp_replace("path", r"^\./(?=.)", ""), r"(?<=.)/+$", "")
    r = requests.withColumn("_path", F.when(clean == "", F.lit(".")).otherwise(clean))
    r = r.join(named, F.col("_path") == F.col("_file"), "left")
    parent = F.when(F.instr("_path", "/") > 0, F.regexp_replace("_path", "/[^/]*$", "")).otherwise(F.lit("."))
    is_file = F.col("_file").isNotNull()
    r = r.withColumn("_at", F.when(is_file & (F.col("scope") == "project"), parent).otherwise(F.col("_path")))
    r = r.join(folders, F.col("_at") == F.col("_folder"), "left")
    is_folder = F.col("_folder").isNotNull()
    target = (F.when(F.col("scope") == "file", F.when(is_file, "file")).when(F.col("scope") == "project", F.when(is_folder, "project"))
              .otherwise(F.when(is_file, "file").when(is_folder, "project")))
    error = F.when(target.isNull(), F.when(is_file | is_folder, F.concat(F.lit("not a "), F.col("scope"))).otherwise(F.lit("no such path")))
    return r.select(*requests.columns, target.alias("target"),
                    F.when(target == "file", 1).when(target == "project", F.col("_n")).otherwise(0).cast("long").alias("n_files"),
                    error.alias("scope_error"))
