"""Lexical state over lines: what of each line is code, in files of any length.

Whether a line starts inside a string depends on all lines before it. Only lines with
a quotation mark or a backslash can change the state (an empty or other line merely
ends what a backslash continued), so each of these is turned into a map of a small
automaton, from the state it starts in to the state it leaves. Maps compose, and
composition is associative, so it is taken by pieces: 256 lines make a piece, 256
pieces a block, the blocks of a file are folded in a row of their own; then the
states go down again. A file of a million lines is 3,907 groups of bounded size at
most, and only numbers and six-letter maps are shuffled for it. What results are
runs of lines that start inside a string; texts meet them in one range join.

States: 0 code, 1 inside a string of three apostrophes, 2 of three quotation marks,
3 and 4 inside a string of one apostrophe or quotation mark that a backslash
continues, 5 code that a backslash continues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast, materialize
from .ranges import file_lengths, ordered_scan, range_join

PIECE = 256
#: Lines that can change the state.
MARKED = r"['\"\\]"
STATES = range(6)
MARKS = {1: "'''", 2: '"""', 3: "'", 4: '"'}


def _body(mark: str, own: str) -> str:
    """What stands in a string before its closing mark; ``own`` is '+' where the
    engine knows possessive repeats (they need no stack on long lines)."""
    q = mark[0]
    one = rf"(?:[^{q}\\]{'+' + own}|\\.)"
    return rf"(?:{q}{{0,2}}{own}{one})*{own}" if len(mark) == 3 else f"{one}*{own}"


def patterns(own: str = "+") -> dict:
    """The patterns of the scan: ``token`` (a comment or string, closed or up to the
    line's end, after f-strings in group 1), ``closed[state]`` (a whole string of that
    mark), ``closing[state]`` (the rest of one) and ``continues`` (a backslash at the
    end that is not itself escaped)."""
    body = {s: _body(m, own) for s, m in MARKS.items()}
    few = {s: f"{m[0]}{{0,2}}" if len(m) == 3 else "" for s, m in MARKS.items()}
    string = "(?:" + "|".join(rf"{MARKS[s]}{body[s]}(?:{MARKS[s]}|{few[s]}\\?\z)" for s in (2, 1, 4, 3)) + ")"
    return {
        "token": rf"(?s)(\b(?:[fF][rR]?|[rR][fF]){string})|#.*|(?:\b[rRbBuU]{{1,2}})?{string}",
        "closed": {s: rf"(?s)\A{m}{body[s]}{m}\z" for s, m in MARKS.items()},
        "closing": {s: rf"(?s)\A{body[s]}{m}" for s, m in MARKS.items()},
        "continues": rf"(?s)\A(?:[^\\]{'+' + own}|\\.)*{own}\\\z",
    }


P = patterns()


def code_part(line: F.Column, state: int) -> F.Column:
    """The part of a line that starts in ``state`` from where it is code on; null if none is."""
    if state not in MARKS:
        return line
    return F.when(line.rlike(P["closing"][state]), F.regexp_replace(line, P["closing"][state], ""))


def state_after(rest: F.Column, last: F.Column) -> F.Column:
    """The state that code ``rest`` leaves, given its last comment or string without prefix."""
    out = F.when(last.isNull() | last.startswith("#"), F.lit(None))
    for s in (2, 1, 4, 3):  # long marks first
        still = ~last.rlike(P["closed"][s])
        stays = F.lit(s) if s < 3 else F.when(last.rlike(P["continues"]), F.lit(s)).otherwise(F.lit(0))
        here = last.startswith(MARKS[s]) if s < 3 else last.startswith(MARKS[s]) & ~last.startswith(MARKS[s] * 3)
        out = out.when(here & still, stays)
    comment = F.coalesce(last.startswith("#"), F.lit(False))
    return F.coalesce(out, F.when(rest.endswith("\\") & ~comment, F.lit(5)).otherwise(F.lit(0)))


def line_map(line: F.Column) -> F.Column:
    """Six digits: the state after the line for each state before it."""
    starts = F.array(*[F.struct(F.lit(s).alias("s"), code_part(line, s).alias("rest")) for s in (0, 1, 2, 3, 4)])
    token = F.lit(P["token"])
    lexed = F.transform(starts, lambda x: F.struct(
        x["s"].alias("s"), x["rest"].alias("rest"),
        F.regexp_replace(F.try_element_at(F.regexp_extract_all(x["rest"], token, F.lit(0)), F.lit(-1)), r"\A[A-Za-z]+", "").alias("last")))
    # not closed: a long string goes on, a short one only behind a backslash
    goes_on = line.rlike(P["continues"])
    unclosed = lambda x: F.when((x["s"] < 3) | goes_on, x["s"]).otherwise(F.lit(0))
    ends = F.transform(lexed, lambda x: F.when(x["rest"].isNull(), unclosed(x)).otherwise(state_after(x["rest"], x["last"])))
    text = F.array_join(F.transform(ends, lambda e: e.cast("string")), "")
    return F.concat(text, F.substring(text, 1, 1))


def entered(now: F.Column, last: F.Column, part: F.Column) -> F.Column:
    """The state in which a part starts, given that behind the part before it: lines
    between the two end what a backslash continued."""
    return F.when((now >= 3) & (last < part["first"] - 1), F.lit(0)).otherwise(now)


def behind(part: F.Column, state: F.Column) -> F.Column:
    return F.substr(part["map"], state + 1, F.lit(1)).cast("int")


def composed(parts: F.Column) -> F.Column:
    """The map of parts in a row."""
    def through(s: int) -> F.Column:
        start = F.struct(F.lit(s).alias("now"), F.lit(None).cast("long").alias("last"))
        return F.aggregate(parts, start, lambda a, p: F.struct(
            behind(p, entered(a["now"], a["last"], p)).alias("now"), p["last"].alias("last")), lambda a: a["now"].cast("string"))

    return F.concat(*[through(s) for s in STATES])


def before_each(parts: F.Column, start: F.Column) -> F.Column:
    """``at, before, after``: the state before and behind each of the parts; of parts
    with one number, which stand in any order, all start in the state of the first."""
    start = F.struct(start.alias("now"), F.lit(None).cast("long").alias("last"),
                     F.array().cast("array<struct<at:bigint,before:int,after:int>>").alias("out"))

    def step(a, p):
        state = entered(a["now"], a["last"], p)
        return F.struct(
            behind(p, state).alias("now"), p["last"].alias("last"),
            F.concat(a["out"], F.array(F.struct(p["at"].alias("at"), state.alias("before"), behind(p, state).alias("after")))).alias("out"))

    return F.aggregate(parts, start, step, lambda a: a["out"])


def line_runs(lines: DataFrame, file: str, at: str, line: str) -> DataFrame:
    """``file, first_line, last_line, state``: runs of lines that start in a state
    other than 0, ``last_line`` being null for a string that is never closed.
    ``file`` and ``at`` must not be null."""
    div = lambda c, n: F.floor(F.col(c) / n).cast("long")
    part = ["at", "map", "first", "last"]

    def gather(df: DataFrame, up: str, *keys: str) -> DataFrame:
        """One row for each group of parts: the parts in order and what they are together."""
        g = df.groupBy(file, *keys).agg(F.array_sort(F.collect_list(F.struct(*part))).alias(up), F.min("first").alias("first"), F.max("last").alias("last"))
        return g.withColumn("map", composed(F.col(up)))

    # numbers are not null by construction: no inferred filters, so both uses of a level are one exchange
    n = F.coalesce(F.col(at).cast("long"), F.lit(0).cast("long"))
    marks = lines.where(F.col(line).rlike(MARKED)).select(file, n.alias("at"), line_map(F.col(line)).alias("map"), n.alias("first"), n.alias("last"))
    pieces = gather(marks.withColumn("piece", div("at", PIECE)), "lines", "piece")
    blocks = pieces.withColumn("at", F.col("piece")).select(file, *part).withColumn("block", div("at", PIECE))
    blocks = gather(blocks, "pieces", "block")
    whole = gather(blocks.withColumn("at", F.col("block")).select(file, *part), "blocks")

    def down(level: DataFrame, parts: str, start: F.Column, key: str) -> DataFrame:
        return level.select(file, F.inline(before_each(F.col(parts), start)).alias(key, "before", "after"))

    at_block = down(whole, "blocks", F.lit(0), "block").drop("after")
    at_piece = down(blocks.join(at_block, [file, "block"]), "pieces", F.col("before"), "piece").drop("after")
    at_line = down(pieces.join(at_piece, [file, "piece"]), "lines", F.col("before"), "at")
    steps = at_line.groupBy(file, "at").agg(F.max("after").alias("after"))
    steps = ordered_scan(steps, file, "at", ["at"], next_col="at")
    last = F.when(F.col("after") >= 3, F.col("at") + 1).otherwise(F.col("_next"))
    return steps.where("after > 0").select(file, (F.col("at") + 1).alias("first_line"), last.alias("last_line"), F.col("after").alias("state"))


def code_lines(lines: DataFrame, keys: tuple = ("path",), at: str = "line_no", line: str = "line", only: str | None = None) -> DataFrame:
    """``lines`` with ``state`` (the state each line of Python starts in) and ``code``:
    the line without comments and strings, each a blank; '' for a line inside a
    string. An f-string stays as it is, since names in its braces are code, but
    not one that spans lines. With ``only``, only lines that contain it come out.

    ``keys`` name a file (null is a file of its own), ``at`` numbers its lines; a
    missing number is an empty line, lines of one number all start in one state. A
    null line is an empty one, a null number is 0. Empty input gives no rows."""
    src = lines.select(
        F.struct(*[F.col(f"`{k}`") for k in keys]).alias("path"),
        F.coalesce(F.col(f"`{at}`").cast("long"), F.lit(0).cast("long")).alias("line_no"),
        F.coalesce(F.col(f"`{line}`"), F.lit("")).alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in lines.columns]).alias("_row"))
    runs = materialize(line_runs(src, "path", "line_no", "_text"), "string-runs")
    wanted = src if only is None else src.where(F.col("_text").contains(only))
    # only files in which a line starts inside a string meet the runs
    zero = F.lit(0).alias("state")
    if runs.isEmpty():
        out = wanted.select("*", zero)
    else:
        files = bounded_broadcast(runs.select("path").distinct())
        open_runs = runs.where("last_line is null").drop("last_line")
        of_open = src.join(bounded_broadcast(open_runs.select("path").distinct()), "path", "left_semi")
        open_runs = open_runs.join(file_lengths(of_open), "path")
        open_runs = open_runs.select("path", "first_line", F.col("n_file_lines").alias("last_line"), "state").where("first_line <= last_line")
        runs = runs.where("last_line is not null").unionByName(open_runs)
        inside = range_join(wanted.join(files, "path", "left_semi"), runs, "first_line", "last_line", "left")
        inside = inside.select(*wanted.columns, F.coalesce("state", F.lit(0)).alias("state"))
        out = inside.unionByName(wanted.join(files, "path", "left_anti").select("*", zero))
    rest = F.lit(None).cast("string")
    for s in STATES:
        rest = F.when(F.col("state") == s, code_part(F.col("_text"), s)).otherwise(rest)
    # without a mark or '#' there is no token
    code = F.when(F.col("_text").rlike(r"['\"#]"), F.regexp_replace(rest, P["token"], "$1 ")).otherwise(rest)
    code = F.coalesce(code, F.lit(""))
    # out of a generator, so that what reads the code does not repeat the patterns
    return out.select("_row.*", F.inline(F.array(F.struct("state", code.alias("code")))))
