"""Request stream: arriving request files, per-session exits, two sinks.

``readStream`` over parquet files of requests (at most ``maxFilesPerTrigger``
files per micro-batch). ``foreachBatch`` appends to two tables: ``seen``, the
requests as they came, and ``exits``, the first exit turn of each session in the
batch (a partial aggregation). Which requests come after the end of their session
is decided by the least exit turn over all batches. A minimum does not depend on
order, so an exit that arrives late still closes requests that arrived before it:
any split and any order of the same files gives the same rows, those of
``session_requests``. A batch costs what it brings, never the history.

The sinks ``good`` and ``dead`` (blank requests and requests from the exit on) are
views over the two tables: a join of the requests with one row a session, so a
session with very many requests is split like any skewed join; no Python and no
state store. Every folder of a batch is overwritten when the batch is replayed.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import py_strip
from ..session import scratch_path

# Folders of the two tables.
SEEN, EXITS = "seen", "exits"
# Words that end a session.
EXIT_WORDS = ["exit", "quit"]


def classify(rows: DataFrame, exits: DataFrame) -> DataFrame:
    """``status`` of requests ``(session, turn, text)``: 'after exit', 'blank' or
    'ok', given ``exits(session, exit_turn)`` with one row a session."""
    after = F.col("exit_turn").isNotNull() & (F.col("turn") >= F.col("exit_turn"))
    blank = py_strip(F.coalesce("text", F.lit(""))) == ""
    status = F.when(after, F.lit("after exit")).when(blank, F.lit("blank")).otherwise(F.lit("ok"))
    return rows.join(exits, "session", "left").withColumn("status", status).drop("exit_turn")


def first_exits(rows: DataFrame) -> DataFrame:
    """``session, exit_turn``: the first turn of each session that is an exit word."""
    ends = F.lower(py_strip("text")).isin(EXIT_WORDS)
    return rows.filter(ends).groupBy("session").agg(F.min("turn").alias("exit_turn"))


def request_stream(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    render: Callable[[DataFrame], DataFrame],
    file_glob: str | None = None,
    out_dir: str | None = None,
    checkpoint: str | None = None,
    max_files_per_trigger: int = 100,
) -> str:
    """Run the stream over everything available (``trigger(availableNow)``)
    in ``source``, a folder (of it the files matching ``file_glob``) or a pattern
    of files and folders, and return the output folder; read its two sinks with
    ``read_sink(spark, out, "good")`` and ``read_sink(spark, out, "dead")``. They
    are there, and empty, if nothing arrives.

    ``render`` turns the raw rows into ``requests(session, turn, text)``.
    Checkpoint and output default to fresh folders under the session's
    ``spark.checkpoint.dir``."""
    out_dir = out_dir or scratch_path(spark, "request-stream-out")
    checkpoint = checkpoint or scratch_path(spark, "request-stream-ckpt")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    raw = reader.parquet(source)
    reqs = render(raw).select("session", "turn", "text")

    def sink(batch: DataFrame, batch_id: int):
        session = batch.sparkSession
        here = os.path.join(out_dir, SEEN, f"batch={batch_id}")
        batch.write.mode("overwrite").parquet(here)
        rows = session.read.schema(batch.schema).parquet(here)
        first_exits(rows).write.mode("overwrite").parquet(os.path.join(out_dir, EXITS, f"batch={batch_id}"))

    # a batch of no rows: both tables are there if no file ever arrives
    sink(spark.createDataFrame([], reqs.schema), -1)
    q = (reqs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir


def read_sink(spark: SparkSession, out_dir: str, sink: str) -> DataFrame:
    """Rows of one sink ('good' or 'dead') over all micro-batches so far."""
    seen, exits = (spark.read.parquet(os.path.join(out_dir, n)) for n in (SEEN, EXITS))
    ends = exits.groupBy("session").agg(F.min("exit_turn").alias("exit_turn"))
    rows = classify(seen.drop("batch"), ends)
    if sink == "good":
        return rows.where("status = 'ok'").select("session", "turn", "text")
    return rows.where("status <> 'ok'").select("session", "turn", "text", "status")
