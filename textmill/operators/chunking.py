"""Chunking text into overlapping windows (by characters, by whole lines).

Both operators are narrow: a document already sits in one row, so chunks are
generated in place with higher-order functions and ``explode``. No shuffle,
no Python; the result keeps the input partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines_array

# The reference's default window and overlap, in characters.
DEFAULT_MAX_CHARS = 8000
DEFAULT_OVERLAP = 200


def _check(max_chars: int, overlap: int) -> None:
    if max_chars <= 0:
        raise ValueError(f"a window needs at least one character, not {max_chars}")
    if overlap < 0:
        raise ValueError(f"windows cannot overlap by {overlap} characters")


def chunk_count(length: Column, max_chars: int, overlap: int) -> Column:
    """Number of windows: one for short text, else until a window reaches the end."""
    step = max_chars - overlap
    n_more = F.floor((length - F.lit(max_chars) + F.lit(step - 1)) / F.lit(step)).cast("long")
    return F.when(length <= max_chars, F.lit(1).cast("long")).otherwise(n_more + 1)


def chunk_chars(
    df: DataFrame,
    text: str = "text",
    max_chars: int = DEFAULT_MAX_CHARS,
    overlap: int = DEFAULT_OVERLAP,
    keep_text: bool = False,
) -> DataFrame:
    """Windows of ``max_chars`` characters, each starting ``overlap`` before
    the previous end. Adds ``chunk_no`` (from 0), ``start`` (0-based
    character offset) and ``chunk``. Short or empty text is one chunk; NULL
    text gives no rows.

    ``overlap >= max_chars`` would never advance, so it is rejected.
    """
    _check(max_chars, overlap)
    if overlap >= max_chars:
        raise ValueError("overlap must be < max_chars")
    step = max_chars - overlap
    n = chunk_count(F.char_length(F.col(text)), max_chars, overlap)
    cols = [c for c in df.columns if keep_text or c != text]
    # one pass cuts the text into blocks of one step; a window is a block and the
    # start of those after it
    ahead = -(-max_chars // step)
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    exploded = df.select(*df.columns, n.alias("_n"), blocks.alias("_blocks")).select(
        *cols,
        "_blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("chunk_no"),
    )
    return exploded.select(
        *cols,
        "chunk_no",
        (F.col("chunk_no") * step).alias("start"),
        F.substring(F.array_join(F.slice("_blocks", F.col("chunk_no").cast("int") + 1, F.lit(ahead)), ""), 1, max_chars).alias("chunk"),
    )


def chunk_lines(
    df: DataFrame,
    text: str = "text",
    max_chars: int = DEFAULT_MAX_CHARS,
    overlap: int = DEFAULT_OVERLAP,
    keep_text: bool = False,
) -> DataFrame:
    """Greedy packing of whole lines (terminators kept) into chunks of at most
    ``max_chars``; a longer line stands alone. ``overlap // 10`` lines are
    carried into the next chunk: the longest suffix of at most that many
    lines that still fits together with the next line (possibly none).
    Adds ``chunk_no`` (from 0), ``start_line`` (1-based, the true line) and
    ``chunk``. Empty or NULL text gives no rows.

    One ``aggregate`` pass over the line lengths carries
    ``(closed (start, end) pairs, current start, current length)``; the pair
    list is appended to only when a chunk closes.
    """
    _check(max_chars, overlap)
    carry = overlap // 10
    cols = [c for c in df.columns if keep_text or c != text]
    base = df.select(*cols, split_lines_array(F.col(text), keepends=True).alias("_lines"))
    base = base.withColumn("_lens", F.transform("_lines", lambda s: F.char_length(s)))

    def lens_at(idx):
        return F.element_at(F.col("_lens"), idx + 1)

    def step(acc, i):
        ln = lens_at(i)
        fits = (acc["cur_len"] + ln <= max_chars) | (acc["cur_start"] == i)
        if carry > 0:
            avail = F.least(F.lit(carry), i - acc["cur_start"])
            # walk back from line i-1 while the kept lines plus line i fit
            kept = F.aggregate(
                F.sequence(F.lit(1), F.greatest(avail, F.lit(1))),
                F.struct(F.lit(0).alias("j"), F.lit(0).alias("s"), F.lit(False).alias("stop")),
                lambda st, t: F.when(
                    (~st["stop"]) & (t <= avail) & (st["s"] + lens_at(i - t) + ln <= max_chars),
                    F.struct(t.alias("j"), (st["s"] + lens_at(i - t)).alias("s"),
                             F.lit(False).alias("stop")),
                ).otherwise(F.struct(st["j"].alias("j"), st["s"].alias("s"), F.lit(True).alias("stop"))),
            )
            new_start = i - kept["j"]
            new_len = kept["s"] + ln
        else:
            new_start = i
            new_len = ln
        closed = F.struct(acc["cur_start"].alias("s"), i.alias("e"))
        return F.when(
            fits,
            F.struct(acc["pairs"].alias("pairs"), acc["cur_start"].alias("cur_start"),
                     (acc["cur_len"] + ln).alias("cur_len")),
        ).otherwise(
            F.struct(F.concat(acc["pairs"], F.array(closed)).alias("pairs"),
                     new_start.alias("cur_start"), new_len.alias("cur_len"))
        )

    init = F.struct(
        F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("pairs"),
        F.lit(0).alias("cur_start"),
        F.lit(0).alias("cur_len"),
    )
    n_lines = F.size("_lines")
    fin = F.aggregate(F.sequence(F.lit(0), n_lines - 1), init, step)
    last = F.struct(fin["cur_start"].alias("s"), n_lines.alias("e"))
    pairs = F.when(n_lines > 0, F.concat(fin["pairs"], F.array(last)))
    out = base.select(*cols, "_lines", F.posexplode(pairs).alias("chunk_no", "_p"))
    return out.select(
        *cols,
        F.col("chunk_no").cast("long").alias("chunk_no"),
        (F.col("_p.s") + 1).cast("long").alias("start_line"),
        F.array_join(F.slice("_lines", F.col("_p.s") + 1, F.col("_p.e") - F.col("_p.s")), "")
        .alias("chunk"),
    )
