"""A training corpus from ``documents``, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``:

1. quality classifier: rejected documents go;
2. exact dedup: of equal texts the one with the largest id stays;
3. n-gram Jaccard join on five-word shingles at 0.8: of each group of linked
   documents one row stays, that with the smallest id (null last; of rows with
   one id, by a hash of the text; of rows that repeat both, any one);
4. mixing sources to target weights: one row for each time a document is taken;
   where a source's target ends inside a document, only its first words;
5. byte-level BPE: token ids, and whether they decode to the text.

Each stage takes an empty table to an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality
from textmill.llm.common import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier keeps; a null text is judged as an empty one."""
    machine = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.good_documents(docs, machine)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, null being empty; with the largest id, null ids last."""
    return exact_dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies. Rows without words are groups of their own;
    repeated rows and rows of one id are told apart by hashes of the text."""
    # a row's key, in the order in which rows are kept: rows of one id and without an
    # id are told apart by two hashes of the text
    text = F.coalesce("text", F.lit(""))
    ident = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    key = F.struct(*ident, F.xxhash64(text).alias("h"), F.xxhash64(F.lit("near"), text).alias("g"))
    keyed = docs.withColumn("_key", key)
    groups = jaccard_join.jaccard_components(keyed, id_col="_key", words=5, percent=80)
    groups = materialize(groups.select("_key", "component_id", "n_shingles"), "near-groups")
    drop = groups.where("_key <> component_id").select(F.col("_key").alias("_drop"))
    rest = keyed.join(drop, F.col("_key") == F.col("_drop"), "left_anti")
    again = groups.where("_key = component_id and n_shingles > 0").groupBy(F.col("_key").alias("_again")).count()
    again = materialize(again.where("count > 1").select("_again"), "near-again")
    if again.isEmpty():
        return rest.drop("_key")
    single = rest.join(again, F.col("_key") == F.col("_again"), "left_anti")
    repeated = rest.join(again, F.col("_key") == F.col("_again"), "left_semi").dropDuplicates(["_key"])
    return single.unionByName(repeated).drop("_key")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken; rows without words never are. A null
    source is one, null and repeated ids are rows like others."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row; a null or empty text has none."""
    return byte_bpe.encode_texts(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The trained classifier and the merges of the tokenizer are not SQL; tests compare
#: the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i + 1}")
    return docs
