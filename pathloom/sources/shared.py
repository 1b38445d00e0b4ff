"""Tables in the folder that all executors share, to cut lineage durably."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own settings: a query's shuffle files go when the query ends; rows of an Arrow batch.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is
    unset and driver and tasks are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/pathloom-shared"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Queries planned inside take these settings of the session."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation, and what later
    stages see can't change. The shuffles behind the table are freed at once;
    the table goes when the application ends. Python in the plan gets batches
    of `batch_rows` rows at most, where the rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # A plan's execution is made once: a new DataFrame takes the setting up.
    with settings(spark, **{CLEANUP: "true"}, **({BATCH: str(batch_rows)} if batch_rows else {})):
        df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by stored() that no later plan reads."""
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
