"""Batch inference: one answer per (system, user) prompt from a caller's
batch function, run as an Arrow ``mapInPandas`` stage.

``predict_factory()`` is called once per partition (it stands for a client
that is expensive to make) and returns ``predict(systems, users) -> answers``.
Identical prompts are answered once: prompts are keyed by SHA-256, made
distinct (a partial aggregation, so a prompt repeated a million times costs
one call) and the answers joined back. A NULL answer or a raised error
becomes ``error`` on that row only.

Answers of a real model are not repeatable: if an executor is lost, Spark
recomputes the lost partitions and would ask the model again. So unless the
factory declares ``deterministic = True`` (as stand-ins in tests do), answers are
materialised: computed once and written to the shared checkpoint folder, and
every later stage reads that table.

With a ``store``, answers outlive the run: a table of answers by prompt hash, which
is asked first and to which new answers are added batch by batch. A run that ended
half-way leaves what it has paid for, and the next one asks for the rest only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import scratch_path

Predict = Callable[[Sequence[str], Sequence[str]], Sequence[str | None]]


def _runner(predict_factory: Callable[[], Predict]):
    def run(batches):
        predict = predict_factory()
        for pdf in batches:
            answers, errors = _answer_batch(predict, pdf["s"].tolist(), pdf["u"].tolist())
            yield pd.DataFrame({"_pkey": pdf["_pkey"], "answer": answers, "error": errors})

    return run


ANSWER_TYPE = StructType([StructField("answer", StringType()), StructField("error", StringType())])


def _answer_batch(predict, systems, users):
    """Answers and errors for one batch; NULL prompts are not sent."""
    idx = [i for i, (s, u) in enumerate(zip(systems, users)) if s is not None and u is not None]
    answers, errors = [None] * len(users), [None] * len(users)
    if not idx:
        return answers, errors
    s_in, u_in = [systems[i] for i in idx], [users[i] for i in idx]
    try:
        got = list(predict(s_in, u_in))
        if len(got) != len(idx):
            raise ValueError("predict returned a wrong number of answers")
        pairs = [(a, None if a is not None else "empty answer") for a in got]
    except Exception:  # isolate the failing rows
        pairs = []
        for s, u in zip(s_in, u_in):
            try:
                a = list(predict([s], [u]))[0]
                pairs.append((a, None if a is not None else "empty answer"))
            except Exception as e:  # noqa: BLE001 - reported per row
                pairs.append((None, f"model error: {e}"))
    for i, (a, e) in zip(idx, pairs):
        answers[i], errors[i] = a, e
    return answers, errors


def _row_udf(predict_factory):
    @F.pandas_udf(ANSWER_TYPE)
    def answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        predict = predict_factory()
        for s, u in batches:
            a, e = _answer_batch(predict, s.tolist(), u.tolist())
            yield pd.DataFrame({"answer": a, "error": e})

    return answer


def batch_infer(
    df: DataFrame,
    predict_factory: Callable[[], Predict],
    system: str = "system_prompt",
    user: str = "user_prompt",
    materialize: bool | None = None,
    json: bool = False,
    dedupe: bool = True,
    store: str | None = None,
    store_batch: int = 100_000,
) -> DataFrame:
    """Add ``answer`` and ``error`` to every row of ``df``. Rows whose system
    or user prompt is NULL are not sent and keep both NULL.

    ``json=True`` asks for JSON answers: ``answer_json`` (VARIANT) is added
    and an answer that is not a JSON object becomes an ``error``.

    ``dedupe=False`` is for prompts known to be unique (they carry a path):
    an iterator pandas UDF over the two prompt columns, factory once per
    partition, no shuffle and no join back.

    ``store`` names a shared folder of answers (see ``ask_missing``); prompts are
    then made distinct, and only those without an answer there are asked, in
    batches of about ``store_batch``."""
    if store is not None and not dedupe:
        raise ValueError("a store holds distinct prompts: dedupe must be on")
    if materialize is None:
        materialize = not getattr(predict_factory, "deterministic", False)
    if not dedupe:
        r = _row_udf(predict_factory)(F.col(system), F.col(user))
        # calls run where the rows are: as many tasks as the input has
        out = df.withColumn("_r", r).select(*df.columns, F.col("_r.answer").alias("answer"),
                                            F.col("_r.error").alias("error"))
        if materialize:
            spark = df.sparkSession
            path = scratch_path(spark, "answers")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        return _json_check(out) if json else out
    has_prompt = F.col(system).isNotNull() & F.col(user).isNotNull()
    key = F.sha2(F.concat_ws("\u0000", F.col(system), F.col(user)), 256)
    keyed = df.withColumn("_pkey", F.when(has_prompt, key))
    prompts = keyed.filter(F.col("_pkey").isNotNull()).groupBy("_pkey").agg(
        F.first(system).alias("s"), F.first(user).alias("u"))
    if store is not None:
        answered = ask_missing(prompts, predict_factory, store, store_batch)
    else:
        answered = prompts.mapInPandas(_runner(predict_factory), "_pkey string, answer string, error string")
    if materialize and store is None:
        spark = df.sparkSession
        path = scratch_path(spark, "answers")
        answered.write.parquet(path)
        answered = spark.read.parquet(path)
    # Rows without a prompt get a unique key that matches nothing, so they
    # spread over the join instead of meeting in the NULL key's partition.
    keyed = keyed.withColumn("_pkey", F.coalesce("_pkey", F.concat(
        F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    out = keyed.join(answered, "_pkey", "left").drop("_pkey")
    return _json_check(out) if json else out


STORE = "_pkey string, answer string, error string, run string"


def stored(spark, store: str) -> DataFrame:
    """All rows of a store; none if there is no such folder yet."""
    try:
        return spark.read.schema(STORE).parquet(store)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE)


def ask_missing(prompts: DataFrame, predict_factory: Callable[[], Predict], store: str, batch: int) -> DataFrame:
    """``_pkey, answer, error`` of distinct ``prompts(_pkey, s, u)`` after asking for
    those that the store has no answer to.

    The missing prompts are written once and dealt to batches by their hash; each
    batch is one distributed write that is added to the store when it is done.
    Failures are stored too, but asked again by the next run; of several rows for a
    prompt an answer counts first, then the latest failure."""
    spark = prompts.sparkSession
    known = stored(spark, store).where("answer is not null").select("_pkey").distinct()
    missing = prompts.join(known, "_pkey", "left_anti")
    path = scratch_path(spark, "prompts")
    missing.write.parquet(path)
    missing = spark.read.schema(prompts.schema).parquet(path)
    n = -(-missing.count() // batch)
    run = f"{time.time_ns():020d}"
    for i in range(n):
        part = missing.where(F.pmod(F.xxhash64("_pkey"), F.lit(n)) == i)
        out = part.mapInPandas(_runner(predict_factory), "_pkey string, answer string, error string")
        out.withColumn("run", F.lit(run)).write.mode("append").parquet(store)
    mine = stored(spark, store).join(prompts.select("_pkey"), "_pkey", "left_semi")
    last = F.max_by(F.struct("answer", "error"), F.struct(F.col("answer").isNotNull(), "run"))
    return mine.groupBy("_pkey").agg(last.alias("r")).select("_pkey", "r.answer", "r.error")


def _json_check(out: DataFrame) -> DataFrame:
    v = F.try_parse_json("answer")
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return out.withColumn("answer_json", F.when(is_obj, v)).withColumn(
        "error", F.when(F.col("answer").isNotNull() & ~is_obj, F.lit("answer is not a JSON object"))
        .otherwise(F.col("error")))
