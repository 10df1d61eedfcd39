"""Incremental ingest of answer files with Structured Streaming."""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.operators.sampling import latest_answers
from spanloom.sources.corpus import _exists
from spanloom.sources.export import overwrite

ANSWER_DDL = "text_id BIGINT, batch STRING, seq BIGINT, raw STRING, error STRING"


def latest(answers: DataFrame) -> DataFrame:
    """Per text the last readable answer, or the last one where none is readable."""
    return latest_answers(answers, "text_id", F.col("raw").isNotNull(), ["seq", "batch"])


def open_batches(answers: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of batches that were not read to the end before; rows without a batch stay."""
    return answers.join(done.select("batch").distinct(), "batch", "left_anti").select(*answers.columns)


def batch_counts(answers: DataFrame) -> DataFrame:
    """Per batch: answers and unreadable ones."""
    return answers.groupBy("batch").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("raw").isNull()).alias("unreadable"))


def taken(answers: DataFrame, done: DataFrame | None = None):
    """(log rows, counts) of one micro-batch: what both the stream and a table at rest run."""
    news = open_batches(answers, done) if done is not None else answers
    return latest(news), batch_counts(news)


def unanswered(spark: SparkSession, answers: DataFrame, table: str, run: str, epoch: int) -> DataFrame:
    """Rows of texts for which the log ``table`` holds no readable answer yet.

    Only the column of ids that were answered is read. What this epoch of this run wrote itself, or later ones before a
    checkpoint was set back, does not count: a replay must give the same rows again."""
    if not _exists(spark, f"{table}_answered"):
        return answers
    log = spark.read.parquet(f"{table}_answered")
    own = (F.col("run") == run) & (F.col("epoch") >= epoch)
    return answers.join(log.filter(~own).select("text_id").distinct(), "text_id", "left_anti").select(*answers.columns)


def follow(stream: DataFrame, table: str, checkpoint: str, done: DataFrame | None = None, parse=None, skip_answered: bool = False):
    """Append the answers of ``stream`` (``ANSWER_DDL``) to the log ``table``; returns after what is there.

    ``done`` names batches that were read to the end before; their rows are skipped. With ``skip_answered`` so are rows of
    texts that a micro-batch before, of this stream or another on the same log, gave a readable answer. Each
    micro-batch is first reduced to one row per text and then writes a folder of its own run
    and epoch. The run stands for the checkpoint, so a second stream or a new checkpoint
    never meets folders that are there already, while a replayed batch overwrites its own:
    the log holds every answer once. Counts per batch go to ``<table>_counts`` the same way, ids with a readable answer
    to ``<table>_answered``. ``parse``, {name: function of the log rows}, writes parsed tables ``<table>_<name>``
    beside them, such as quotes or labels with what was dropped and why.
    """
    spark = stream.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def take(batch: DataFrame, epoch: int) -> None:
        news = unanswered(spark, batch, table, run, epoch) if skip_answered else batch
        rows, counts = taken(news, done)
        at = f"run={run}/epoch={epoch}"
        rows.write.mode("overwrite").parquet(f"{table}/{at}")
        counts.write.mode("overwrite").parquet(f"{table}_counts/{at}")
        kept = spark.read.schema(rows.schema).parquet(f"{table}/{at}")
        kept.filter("raw is not null").select("text_id").write.mode("overwrite").parquet(f"{table}_answered/{at}")
        for name, fn in (parse or {}).items():
            fn(kept).write.mode("overwrite").parquet(f"{table}_{name}/{at}")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_stream(spark: SparkSession, directory: str, table: str, checkpoint: str, max_files: int = 100, done: DataFrame | None = None, parse=None, skip_answered: bool = False):
    """``follow`` the answer files, JSON lines, of a directory as they arrive."""
    stream = spark.readStream.schema(ANSWER_DDL).option("maxFilesPerTrigger", max_files).json(directory)
    return follow(stream, table, checkpoint, done, parse, skip_answered)


def answers_now(spark: SparkSession, table: str) -> DataFrame:
    """The answer table: the log reduced to one row per text."""
    return latest(spark.read.parquet(table).drop("run", "epoch"))


def counts_now(spark: SparkSession, table: str) -> DataFrame:
    """Answers and unreadable ones per batch over the whole log."""
    return spark.read.parquet(f"{table}_counts").groupBy("batch").agg(F.sum("answers").alias("answers"), F.sum("unreadable").alias("unreadable"))


def compact(spark: SparkSession, table: str, root: str, version: str) -> str:
    """A copy of the log with one row per text, written beside it and switched in at the end."""
    return overwrite(answers_now(spark, table), root, version)
