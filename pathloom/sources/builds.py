"""Background builds of tables that can be cancelled, and builds that go on where they stopped.

A build runs in a thread of the driver under a tag of Spark's, which cancels its
jobs; all work is Spark's. A status table beside the data says what became of it,
and readers see finished builds only.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = "name string, build string, status string, message string, at double"


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = _hadoop(spark, path)
    return system.exists(hadoop)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop, system = _hadoop(spark, path)
    system.delete(hadoop, True)


class Builds:
    """Builds of named tables under one folder, which all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.running: dict[str, tuple[str, threading.Thread]] = {}
        self.cancelled: set[str] = set()

    def note(self, name: str, build: str, status: str, message: str = "") -> None:
        row = self.spark.createDataFrame([(name, build, status, message[:500], time.time())], STATUS)
        row.coalesce(1).write.mode("append").json(f"{self.root}/status")

    def start(self, name: str, make: Callable[[], DataFrame]) -> str:
        """Begin to write make()'s rows as the table `name`; returns the build. One build of a name runs at a time."""
        if name in self.running and self.running[name][1].is_alive():
            raise ValueError(f"{name} is being built")
        build = uuid.uuid4().hex
        path = f"{self.root}/data/{name}/{build}"
        self.note(name, build, "running")

        def work() -> None:
            context = self.spark.sparkContext
            context.addJobTag(build)
            context.setInterruptOnCancel(True)
            try:
                make().write.parquet(path)
            except Exception as e:  # what stopped the build goes to its status
                _delete(self.spark, path)
                context.removeJobTag(build)
                stopped = name in self.cancelled or "cancelled" in str(e).lower()
                self.note(name, build, "cancelled" if stopped else "failed", str(e))
            else:
                context.removeJobTag(build)
                self.note(name, build, "done")

        self.cancelled.discard(name)
        thread = threading.Thread(target=work, daemon=True)
        self.running[name] = (build, thread)
        thread.start()
        return build

    def cancel(self, name: str) -> None:
        """Stop a running build's jobs; its rows go."""
        build, thread = self.running[name]
        if thread.is_alive():
            self.cancelled.add(name)
            self.spark.sparkContext.cancelJobsWithTag(build)

    def wait(self, name: str, seconds: float | None = None) -> bool:
        thread = self.running[name][1]
        thread.join(seconds)
        return not thread.is_alive()

    def status(self) -> DataFrame:
        """The last status of each build."""
        rows = self.spark.read.schema(STATUS).json(f"{self.root}/status")
        return rows.groupBy("name", "build").agg(F.max_by(F.struct("status", "message", "at"), F.struct("at", F.col("status") != "running")).alias("s")).select("name", "build", "s.*")

    def table(self, name: str) -> DataFrame | None:
        """The rows of the newest finished build, None without one."""
        done = self.status().filter((F.col("name") == name) & (F.col("status") == "done")).orderBy(F.desc("at")).limit(1).collect()
        return self.spark.read.parquet(f"{self.root}/data/{name}/{done[0]['build']}") if done else None


def resumed(source: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], root: str, parts: int = 8, most: int | None = None) -> DataFrame:
    """make(source), built in parts by a hash of `key`, of which finished ones are not built again.

    A part is finished once Spark has committed its folder; one that was broken
    off is written anew. With `most`, at most so many parts are built in this
    call, and the rows of the finished ones come back.
    """
    spark = source.sparkSession
    left = [k for k in range(parts) if not _exists(spark, f"{root}/part={k}/_SUCCESS")]
    for k in left[:most]:
        own = source.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
        make(own).write.mode("overwrite").parquet(f"{root}/part={k}")
    done = [f"{root}/part={k}" for k in range(parts) if _exists(spark, f"{root}/part={k}/_SUCCESS")]
    return spark.read.option("basePath", root).parquet(*done).drop("part") if done else make(source.limit(0))


def unfinished(source: DataFrame, done: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Rows of source whose key has fewer than `least` rows in done: what a recovery has still to do."""
    whole = done.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(key)
    return source.join(whole, key, "left_anti")


def recovered(frames: DataFrame, results: DataFrame, run: str, least: int = 100) -> DataFrame:
    """Runs whose result is missing but whose frames were written: (run, frames, first, last, state).

    `complete` with `least` frames and none missing between the first and the
    last, `partial` with `least` frames, else `lost`.
    """
    seen = frames.join(results.select(run).distinct(), run, "left_anti").groupBy(run).agg(F.count_distinct("frame").alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    whole = F.col("last") - F.col("first") + 1 == F.col("frames")
    return seen.withColumn("state", F.when(F.col("frames") < least, "lost").when(whole, "complete").otherwise("partial"))
