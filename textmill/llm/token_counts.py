"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than one chunk is cut into overlapping chunks that are rows of
their own, so that one huge document spreads over many tasks. Each chunk is
encoded with offsets. Neighbouring chunks are spliced at a common stable
boundary of their overlap: a place where both encodings have the same token
before it and the same token after it.

Why that is a proof: merging always takes the best adjacent pair, and the
order of merges inside a stretch depends on nothing outside it until a merge
crosses its border. A sequence of tokens is therefore the encoding of its text
exactly if each adjacent pair is the encoding of its own text. At a common
boundary every adjacent pair of the spliced sequence stands in one of the two
encodings, so the spliced sequence is the encoding of the whole.

Where no boundary of an overlap agrees, the text goes through another round
with chunks and overlap four times as long; at the latest one chunk holds it.

Texts of one chunk are encoded segment by segment: no piece of the vocabulary
has a word-start mark behind another character (checked when the model is
loaded, else whole texts are encoded), so no merge crosses a place where a
mark follows another character, and equal segments are encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialize

MARK = "▁"
SEGMENT = re.compile(" *[^ ]+| +")
#: Entries of a worker's segment cache; beyond it the cache starts anew.
CACHE = 400_000
EDGE = "n long, first_keys array<long>, first_pos array<int>, last_keys array<long>, last_pos array<int>"


class Model:
    """A SentencePiece model with what splicing needs to know of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        byte = [int(p[3:-1], 16) if self.sp.is_byte(i) else -1 for i, p in enumerate(pieces)]
        # characters a token covers; bytes that continue a character cover none
        self.width = np.array([len(p) if b < 0 else int(not 0x80 <= b < 0xC0) for p, b in zip(pieces, byte)], np.int64)
        self.cuts = MARK in pieces and all(MARK not in p.lstrip(MARK) for p in pieces)
        # offsets and segments need a normaliser that only turns spaces into marks
        probe = "a  B\té½ \n"
        self.plain = "".join(self.sp.encode("x" + probe.replace("\t", "").replace("\n", ""), out_type=str)) == MARK + (
            "x" + probe.replace("\t", "").replace("\n", "")
        ).replace(" ", MARK)
        self.cache: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not (self.cuts and self.plain):
            return len(self.sp.encode(text, num_threads=1))
        cache, total, missed = self.cache, 0, []
        for s in SEGMENT.findall(" " + text.replace(MARK, " ")):
            n = cache.get(s)
            if n is None:
                missed.append(s)
            else:
                total += n
        if missed:
            if len(cache) > CACHE:
                cache.clear()
            for s, ids in zip(missed, self.sp.encode([s[1:] for s in missed], num_threads=1)):
                # the encoder puts one mark before each text, but none before an empty one
                cache[s] = n = len(ids) if len(s) > 1 else 1
                total += n
        return total

    def edges(self, window: str, step: int, overlap: int) -> tuple:
        """Token count and the boundaries in the first ``overlap`` characters and
        behind ``step``: keys of (offset, token before, token after), positions."""
        ids = np.array(self.sp.encode(window, num_threads=1), np.int64)
        if not len(ids):
            return 0, [], [], [], []
        width = self.width[ids]
        start = np.cumsum(width) - width - 1  # the mark put before the window stands at -1
        ok = np.flatnonzero((width[1:] > 0) & (start[:-1] >= 0)) + 1
        first = ok[start[ok] < overlap]
        last = ok[start[ok] >= step]
        pair = (ids[:-1] << 20) | ids[1:]

        def keys(at, base):
            return ((start[at] - base) << 40) | pair[at - 1]

        return len(ids), keys(first, 0), first, keys(last, step), last


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_column(path: str):
    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(path)
        for batch in texts:
            yield pd.Series([m.count(t) for t in batch], dtype="int64")

    return count


def edge_column(path: str, step: int, overlap: int):
    @F.pandas_udf(EDGE)
    def edges(windows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model(path)
        names = ["n", "first_keys", "first_pos", "last_keys", "last_pos"]
        for batch in windows:
            yield pd.DataFrame([m.edges(w, step, overlap) for w in batch], columns=names)

    return edges


def spliced(texts: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """``(sha, n_tokens)`` of ``texts(sha, text)``; ``n_tokens`` is null where a
    pair of neighbours has no common boundary."""
    step_ = F.lit(step)
    last = F.greatest(F.lit(0), F.ceil((F.char_length("text") - overlap - step) / step_).cast("int"))
    cut = texts.select("sha", "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    cut = cut.select("sha", "last", "k", F.substring("text", F.col("k") * step + 1, F.lit(step + overlap)).alias("w"))
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cut = cut.repartition(parts, "sha", "k")  # the chunks of one text go to many tasks
    enc = materialize(
        cut.select("sha", "last", "k", edge_column(path, step, overlap)("w").alias("e")), "token-chunks"
    )
    left = enc.select("sha", "last", "k", "e.n", "e.last_keys", "e.last_pos")
    right = enc.select(
        F.col("sha").alias("r_sha"), (F.col("k") - 1).alias("r_k"), F.col("e.first_keys").alias("first_keys"), F.col("e.first_pos").alias("first_pos")
    )
    seam = left.join(right, (F.col("sha") == F.col("r_sha")) & (F.col("k") == F.col("r_k")), "left")
    common = F.array_intersect("last_keys", "first_keys")
    # the boundary in the middle of those that agree
    key = F.when(F.size(common) > 0, F.get(common, F.floor(F.size(common) / 2).cast("int")))
    at = seam.withColumn("key", key)
    net = F.get("last_pos", (F.array_position("last_keys", F.col("key")) - 1).cast("int")) - F.get(
        "first_pos", (F.array_position("first_keys", F.col("key")) - 1).cast("int")
    )
    part = F.when(F.col("k") == F.col("last"), F.col("n")).otherwise(net)
    per = at.select("sha", part.cast("long").alias("part")).groupBy("sha")
    return per.agg(F.when(F.count("part") == F.count("*"), F.sum("part")).alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str | None = None,
    step: int = 16_384,
    overlap: int = 256,
    limit: int = 4096,
) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_tokens, over_limit``.

    A null text counts as empty and has no tokens. Rows may repeat; equal huge
    texts are encoded once. Other columns are not read; an empty table gives
    no rows. ``step`` and ``overlap`` are in characters; overlap < step."""
    path = model_path or default_model()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    huge = F.char_length("text") > step + overlap
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    short = rows.where(~huge).select("id", n_bytes, count_column(path)("text").alias("n_tokens"))
    long_rows = rows.where(huge).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    left = long_rows.select("sha", "text").dropDuplicates(["sha"])
    done, width, wide = None, step, overlap
    while True:
        counted = materialize(spliced(left, path, width, wide), "token-spliced")
        ok = counted.where("n_tokens is not null")
        done = ok if done is None else done.unionByName(ok)
        open_ = counted.where("n_tokens is null").select("sha")
        if open_.isEmpty():
            break
        left = long_rows.join(open_, "sha").select("sha", "text").dropDuplicates(["sha"])
        width, wide = 4 * width, 4 * wide
    long_counts = long_rows.select("id", "sha", n_bytes).join(done, "sha").select("id", "n_bytes", "n_tokens")
    out = short.unionByName(long_counts)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
