"""Document fingerprints by consistent weighted sampling.

A document is a bag of words weighted by their counts. For each of ``k``
samples a word t has its own random r, c ~ Gamma(2, 1) and b ~ U(0, 1), all
from hashes of the word and the sample's number. With weight w,
n = floor(ln w / r + b) and ln a = ln c - r (n - b + 1); the smallest a of the
document is its sample. Two documents have the same sample with the probability
sum(min(w, w')) / sum(max(w, w')), their generalised Jaccard similarity. ln a is
a function of (t, n) alone, so equal minima stand for equal samples and the
minima themselves are the signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import materialize

#: Separators of words, as one splitting pattern.
SPACES = r"[\x20\x09-\x0D]+"
TWO32 = 4294967296.0


def _uniform(bits: Column) -> Column:
    """A number in (0, 1) from 32 bits."""
    return (bits.cast("double") + 0.5) / TWO32


def _gamma_log(h: Column) -> Column:
    """Gamma(2, 1) from the two halves of a 64-bit hash: -ln(u v)."""
    high = F.shiftrightunsigned(h, 32)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    return -F.log(_uniform(high) * _uniform(low))


def log_sample(term: Column, log_weight: Column, number: int) -> Column:
    """ln a of a hashed term for one sample."""
    r = _gamma_log(F.xxhash64(term, F.lit(3 * number)))
    c = _gamma_log(F.xxhash64(term, F.lit(3 * number + 1)))
    b = _uniform(F.shiftrightunsigned(F.xxhash64(term, F.lit(3 * number + 2)), 32))
    n = F.floor(log_weight / r + b)
    return F.log(c) - r * (n - b + 1.0)


def signatures(texts: DataFrame, keys: list[str], text_col: str, k: int) -> DataFrame:
    """``keys, signature`` (array of double) of the texts that have words. If the
    rows of ``texts`` are already placed by (some of) ``keys``, nothing is shuffled."""
    words = texts.select(*keys, F.explode(F.split(text_col, SPACES)).alias("word")).where("word != ''")
    bags = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    bags = bags.withColumn("lw", F.log(F.col("n").cast("double")))
    low = bags.groupBy(*keys).agg(*[F.min(log_sample(F.col("term"), F.col("lw"), i)).alias(f"s{i}") for i in range(k)])
    return low.select(*keys, F.array(*[f"s{i}" for i in range(k)]).alias("signature"))


def as_text(signature: Column) -> Column:
    """Eight hexadecimal digits a sample; empty for a text without words."""
    digits = F.transform(signature, lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: str, b: str, k: int) -> Column:
    """Share of equal samples of two fingerprints; two empty ones are alike."""
    at = F.sequence(F.lit(0), F.lit(k - 1))
    part = lambda col, i: F.substring(col, i * 8 + 1, F.lit(8))
    same = F.size(F.filter(at, lambda i: part(F.col(a), i) == part(F.col(b), i)))
    return (
        F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double"))
        .otherwise(same.cast("double") / float(k))
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, rk, h, text, n``: the row's key is two 64-bit hashes, of id and text
    and of the text, so that null ids join like others."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ident = F.col(f"`{id_col}`")
    return docs.select(
        ident.alias("id"),
        F.xxhash64(ident.cast("string"), text).alias("rk"),
        F.xxhash64(text).alias("h"),
        text.alias("text"),
        F.char_length(text).alias("n"),
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """One row for each ``(rk, h)`` of ``rows(id, rk, h, n)``, with the next one in
    descending id order (null last, then h; after the last the first):
    ``next_rk, next_h``; the one that this is next of: ``prev_rk, prev_h,
    prev_n``; and ``copies``, how often it stands in ``rows``.

    Rows are range-partitioned once and written with their partition's number;
    each window covers one such range, and the ends are joined through one row
    a partition."""
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    order = [F.desc_nulls_last("id"), F.asc("h"), F.asc("rk")]
    once = rows.groupBy("rk", "h").agg(F.max("id").alias("id"), F.max("n").alias("n"), F.count("*").alias("copies"))
    placed = once.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "cws-order")
    one = F.struct("rk", "h", "n")
    inside = Window.partitionBy("part").orderBy(*order)
    w = placed.withColumn("nx", F.lead(one).over(inside)).withColumn("pv", F.lag(one).over(inside))
    ends = w.groupBy("part").agg(
        F.first(F.when(F.col("pv").isNull(), one), ignorenulls=True).alias("head"),
        F.first(F.when(F.col("nx").isNull(), one), ignorenulls=True).alias("tail"),
    )  # at most one row a partition
    parts_order = Window.orderBy("part")
    every = parts_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        F.col("part").alias("e_part"),
        F.coalesce(F.lead("head").over(parts_order), F.first("head").over(every)).alias("after"),
        F.coalesce(F.lag("tail").over(parts_order), F.last("tail").over(every)).alias("before"),
    )
    full = w.join(F.broadcast(ends), F.col("part") == F.col("e_part"))
    nx, pv = F.coalesce("nx", "after"), F.coalesce("pv", "before")
    return full.select(
        "id",
        "rk",
        "h",
        "n",
        "copies",
        nx["rk"].alias("next_rk"),
        nx["h"].alias("next_h"),
        pv["rk"].alias("prev_rk"),
        pv["h"].alias("prev_h"),
        pv["n"].alias("prev_n"),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 32) -> DataFrame:
    """``id, fingerprint`` of every distinct pair of id and text; a null text is
    empty, and the fingerprint of a text without words is the empty string."""
    rows = keyed(docs, id_col, text_col)
    ids = rows.groupBy("rk", "h").agg(F.max("id").alias("id"))
    sig = signatures(rows.dropDuplicates(["rk", "h"]), ["rk", "h"], "text", k)
    out = ids.join(sig, ["rk", "h"], "left")
    return out.select(F.col("id").alias(id_col), as_text(F.col("signature")).alias("fingerprint"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 32) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document, by descending id (null last,
    then a hash of the text); after the last comes the first, so a lone document
    is its own next. Rows that repeat id and text are one document in that
    order, and each gets the result. Null texts are empty. Other columns are
    not read; an empty table gives no rows."""
    rows = keyed(docs, id_col, text_col)
    near = materialize(neighbours(rows.select("id", "rk", "h", "n")), "cws-next")
    # the uses of texts and gifts below read one shuffle of each; rows that repeat
    # are equal in every column, so max() keeps one
    texts = rows.select("rk", "h", "text").join(near, ["rk", "h"])
    texts = texts.groupBy("rk", "h").agg(*[F.max(c).alias(c) for c in texts.columns if c not in ("rk", "h")])
    gift = F.expr("substring(text, 1, cast(prev_n div 3 as int))")
    gifts = texts.select(F.col("prev_rk").alias("rk"), F.col("prev_h").alias("h"), gift.alias("gift"))
    both = texts.join(gifts, ["rk", "h"])
    edited = F.expr("concat(substring(text, 1, cast(n - n div 3 as int)), gift)")
    side = lambda number, col: F.struct(F.lit(number).alias("side"), col.alias("text"))
    sides = both.select("rk", "h", F.explode(F.array(side(0, F.col("text")), side(1, edited))).alias("s"))
    sig = signatures(sides.select("rk", "h", "s.side", "s.text"), ["rk", "h", "side"], "text", k)
    prints = sig.groupBy("rk", "h").agg(
        as_text(F.max(F.when(F.col("side") == 0, F.col("signature")))).alias("fingerprint"),
        as_text(F.max(F.when(F.col("side") == 1, F.col("signature")))).alias("edited_fingerprint"),
    )
    sha = F.sha2(edited.cast("binary"), 256).alias("edited_sha256")
    facts = both.select("id", "rk", "h", F.col("n").cast("long").alias("n_chars"), "copies", "next_rk", "next_h", sha)
    prints = materialize(facts.join(prints, ["rk", "h"], "left"), "cws-prints")
    nxt = prints.select(
        F.col("rk").alias("next_rk"), F.col("h").alias("next_h"), F.col("fingerprint").alias("next_fingerprint")
    )
    out = prints.join(nxt, ["next_rk", "next_h"], "left")
    out = out.fillna("", ["fingerprint", "edited_fingerprint", "next_fingerprint"])
    out = out.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", k).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", k).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    )
    return out.drop("_copy")
