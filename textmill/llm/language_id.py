"""Language identification by compression.

Each language has a raw-content dictionary of its own training text. A text is
compressed with every dictionary; the language whose dictionary gives the
fewest bytes wins. Long texts are compressed in blocks, each against the
dictionary alone, so that a text's own repetition does not drown the
dictionaries and every part of it counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import fold

LETTER = re.compile(r"[^\W\d_]")
#: Bytes of text compressed at once.
BLOCK = 2048
#: Score: size differences count in units of 1/SHARPNESS of the best size.
SHARPNESS = 60.0
UNKNOWN = "und"


def training_blocks(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, block_chars: int, dict_bytes: int
) -> DataFrame:
    """``(lang, block)``: at most ``dict_bytes / block_chars`` blocks a language,
    drawn by hash from all parts of at most ``sample_docs`` labelled documents."""
    ident, lang = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`")
    order = F.xxhash64(ident)
    # names of their own, whatever other columns there are
    teach = docs.where((fold(ident) != 0) & lang.isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        ident.alias("id"), lang.alias("lang"), F.col(f"`{text_col}`").alias("text"), order.alias("key"))
    drawn = teach.select("lang", "id", "key")
    first = Window.partitionBy("lang").orderBy("key", "id")
    drawn = drawn.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_docs)
    # at most sample_docs rows a language
    ids = F.broadcast(drawn.select(F.col("id").alias("s_id"), F.col("lang").alias("s_lang")).distinct())
    texts = teach.join(ids, (F.col("id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang"))).select("lang", "id", "text")
    at = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / block_chars).cast("int"))
    blocks = texts.where(F.char_length("text") > 0).select("lang", "id", "text", F.explode(at).alias("k"))
    blocks = blocks.select(
        "lang",
        F.xxhash64("id", "k").alias("key"),
        F.substring("text", F.col("k") * block_chars + 1, F.lit(block_chars)).alias("block"),
    )
    pick = Window.partitionBy("lang").orderBy("key", "block")
    blocks = blocks.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= max(1, dict_bytes // block_chars))
    return blocks.select("lang", "r", "block")


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 600,
    block_chars: int = 512,
    dict_bytes: int = 131_072,
) -> dict[str, bytes]:
    """A raw-content dictionary, lower-cased, for each language of the rows outside
    fold 0; the language with most rows comes first.

    What reaches the driver is ``dict_bytes`` characters a language at most; a
    language is a label value, so their number does not grow with the rows."""
    rows = training_blocks(docs, id_col, text_col, lang_col, sample_docs, block_chars, dict_bytes).collect()
    parts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["r"])):
        parts.setdefault(r["lang"], []).append(r["block"])
    taught = docs.where((fold(F.col(f"`{id_col}`")) != 0) & F.col(f"`{lang_col}`").isNotNull())
    counts = {r[0]: r[1] for r in taught.groupBy(F.col(f"`{lang_col}`")).count().collect()}
    order = sorted(parts, key=lambda lang: (-counts[lang], lang))
    return {lang: "\n".join(parts[lang]).lower().encode()[-dict_bytes:] for lang in order}


class Compressors:
    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...], level: int):
        import zstandard

        self.langs = [lang for lang, _ in dictionaries]
        params = zstandard.ZstdCompressionParameters.from_level(
            level, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.all = []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.all.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.all]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Best language, its score, and the margin to the second, by size."""
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        score = 1.0 / sum(math.exp(-SHARPNESS * (s - best) / best) for s in sizes)
        second = sizes[order[1]] if len(sizes) > 1 else 2 * best
        return self.langs[order[0]], score, (second - best) / second


@lru_cache(maxsize=2)
def compressors(dictionaries: tuple, level: int) -> Compressors:
    return Compressors(dictionaries, level)


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    level: int = 9,
    min_margin: float = 0.005,
) -> DataFrame:
    """One row per input row: ``id, lang_best, score, margin, lang``.

    ``lang`` is the best language, or null where the margin to the second is
    below ``min_margin`` (rejected). A text that is null or has no letter is
    ``und`` with score 0, and so is any text if no language was learned. Equal
    sizes go to the language that was learned from more rows. Only id and text are read."""
    spark = docs.sparkSession
    # bounded: dict_bytes a language
    shared = spark.sparkContext.broadcast(tuple(dictionaries.items()))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    extra = {"lang_best": F.lit(""), "score": F.lit(0.0), "margin": F.lit(0.0)}
    schema = rows.drop("_text").withColumns(extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = compressors(shared.value, level)
        for batch in batches:
            got = [c.predict(t.as_py()) for t in batch.column(1)]
            lang, score, margin = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
                names=[id_col, "lang_best", "score", "margin"],
            )

    out = rows.mapInArrow(run, schema)
    sure = (F.col("margin") >= min_margin) & (F.col("lang_best") != UNKNOWN)
    return out.withColumn("lang", F.when(sure, F.col("lang_best")))
