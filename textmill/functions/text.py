"""Column functions for text: whitespace, line breaks, fences, echo, names.

Everything here returns a ``Column`` built from JVM-side expressions, so it
stays inside whole-stage code generation and costs nothing to compose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of Python's ``str.splitlines`` and the
# whitespace of ``str.strip`` (Unicode White_Space plus U+001C..U+001F).
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LINE_CLASS = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
NOT_LINE_CLASS = r"[^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# A line with its terminator, or a last line without one.
LINE_WITH_END = rf"{NOT_LINE_CLASS}*(?:\r\n|{LINE_CLASS})|{NOT_LINE_CLASS}+"
WS = r"[\s\x1c-\x1f]"
FENCE = "```"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: drop leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), rf"(?U)^{WS}+|{WS}+\z", "")


# Line breaks other than '\n'; text without any of them takes the fast path.
OTHER_BREAK = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def split_lines_array(col, keepends: bool = False) -> Column:
    """``str.splitlines(keepends)`` as an array; '' gives [], NULL gives NULL.

    Text whose only line break is '\n' (one character-class scan decides) is
    split on that single character, which Java does without a regex engine;
    other text goes through the full line-boundary pattern."""
    c = _c(col)
    empty = F.array().cast("array<string>")
    parts = F.split(c, "\n", -1)
    n = F.size(parts)
    if keepends:
        with_ends = F.transform(parts, lambda x, i: F.when(i < n - 1, F.concat(x, F.lit("\n"))).otherwise(x))
        slow = F.regexp_extract_all(c, F.lit(f"({LINE_WITH_END})"), 1)
    else:
        with_ends = parts
        slow_parts = F.split(c, LINE_BREAK, -1)
        slow = F.when(F.element_at(slow_parts, -1) == "", F.slice(slow_parts, 1, F.size(slow_parts) - 1)) \
            .otherwise(slow_parts)
    fast = F.when(F.element_at(parts, -1) == "", F.slice(with_ends, 1, n - 1)).otherwise(with_ends)
    return F.when(c == "", empty).when(c.rlike(OTHER_BREAK), slow).otherwise(fast)


def strip_code_fences(col) -> Column:
    """Trimmed text; a fenced block of over one line loses its first and
    last line and is trimmed again."""
    c = py_strip(col)
    lines = F.split(c, LINE_BREAK)
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    fenced = c.startswith(FENCE) & c.endswith(FENCE) & (F.size(lines) > 1)
    return F.when(fenced, py_strip(inner)).otherwise(c)


def drop_echo(new, original) -> Column:
    """If the answer repeats the original, keep what follows its last copy.

    Both sides are trimmed. A blank original returns the trimmed answer
    (the reference fails that row instead).
    """
    n = py_strip(new)
    o = py_strip(original)
    tail = py_strip(F.split_part(n, o, F.lit(-1)))
    return (
        F.when(o == "", n)
        .when(n == o, n)
        .when(n.contains(o) & (tail != ""), tail)
        .otherwise(n)
    )


def file_name(path) -> Column:
    return F.regexp_extract(_c(path), r"[^/]*$", 0)


def path_suffix(path) -> Column:
    """``PurePath.suffix``: last dot of the name, not leading, not trailing."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def swap_suffix(path, suffix) -> Column:
    """``PurePath.with_suffix``: replace the last suffix, or append one."""
    p = _c(path)
    old = path_suffix(p)
    base = F.when(old == "", p).otherwise(
        F.substring(p, F.lit(1), F.char_length(p) - F.char_length(old)))
    return F.concat(base, F.lit(suffix) if isinstance(suffix, str) else suffix)


def safe_name(col) -> Column:
    """Every character other than a letter, digit, '-' or '_' becomes '_'."""
    return F.regexp_replace(_c(col), r"[^\p{L}\p{N}_-]", "_")


def blank(col) -> Column:
    return py_strip(col) == ""
