"""The session the library is meant to run in."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="spanloom", master=None, conf=None) -> SparkSession:
    """A session with adaptive execution on and UTC time; the library runs in a stock session as well."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # no call-site capture per expression: plans here have thousands of them
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
    }
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so that a lost executor
    does not send the job back to the text scan.

    The folder is the one set on the context or named in ``spark.checkpoint.dir``. There
    is no default: executors cannot share a folder of one machine.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not named:
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


#: Rows of whole texts in one Arrow batch.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts pass to Python in Arrow batches; a batch of the stock number of rows could hold gigabytes. A smaller
    bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one named in ``spark.checkpoint.dir``, which all executors share. Only a local session that
    names none, a test, gets one of its own machine."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return f"{named.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
