"""Streams over growing folders: new files once, running maxima, stage timers with and without end, JSON lines.

A source is a folder; checkpoints and tables lie in the shared folder, so a
restarted query goes on where it stopped. `replayed` runs a stream over what is
there now and reads the result, for recovery and for tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_dir

EVENT = "event string, data map<string,string>"


def tail(spark: SparkSession, path: str, schema: str, fmt: str = "json", files: int | None = None) -> DataFrame:
    """Rows of a folder's files, each file once, at most `files` of them in a batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """(event, data) of JSON lines; lines that are no events are left out."""
    lines = spark.readStream.text(path).select(F.from_json("value", EVENT).alias("e"))
    return lines.select("e.event", "e.data").filter("event is not null")


def progress(events: DataFrame, by: str, value: str) -> DataFrame:
    """Largest value of each key so far: a counter that never falls."""
    return events.groupBy(by).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("updates"))


def stage_seconds(events: DataFrame, by: str = "run", stage: str = "stage", t: str = "t") -> DataFrame:
    """(run, stage, seconds, visits) of stages left so far; a key's state starts anew at the stage `reset`.

    Each batch updates the totals of its keys; rows of a batch are taken in the
    order of time, and one not later than the last adds nothing.
    """
    kind = "run string, stage string, seconds double, visits long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since, totals = state.get if state.exists else (None, 0.0, [])
        held = {s: [sec, n] for s, sec, n in totals}
        rows = pd.concat(list(batches)).sort_values([t, stage], kind="stable")
        for name, at in zip(rows[stage], rows[t], strict=True):
            if name == "reset":
                now, since, held = None, at, {}
                continue
            if now is not None and name != now:
                one = held.setdefault(now, [0.0, 0])
                one[0] += max(0.0, at - since)
                one[1] += 1
            if name != now:
                now, since = name, at
        totals = [(k, sec, n) for k, (sec, n) in sorted(held.items())]
        state.update((now, float(since), totals))
        yield pd.DataFrame([(str(key[0]), *x) for x in totals], columns=["run", "stage", "seconds", "visits"])

    held = "now string, since double, totals array<struct<stage:string,seconds:double,visits:bigint>>"
    return events.groupBy(by).applyInPandasWithState(step, kind, held, "Update", GroupStateTimeout.NoTimeout)


def stage_seconds_until(events: DataFrame, gap: str, lateness: str, by: str = "run", stage: str = "stage", t: str = "t") -> DataFrame:
    """(run, stage, seconds, visits) of runs that are over: no row for `gap` of event time after the last.

    t is a timestamp. Rows later than the watermark of `lateness` are left out; a
    row without stage and seconds counts them (visits) when they come. Those in
    time are held and put in order when their run ends, and its state is removed
    then. The last stage of a run has no end and no seconds.
    """
    kind = "run string, stage string, seconds double, visits long"
    wait = int(events.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL '{gap.split()[0]}' {gap.split()[1].rstrip('s').upper()})").first()[0])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            rows = sorted(zip(*state.get, strict=True))
            state.remove()
            held: dict[str, list] = {}
            now, since = rows[0][1], rows[0][0]
            for at, name in rows[1:]:
                if name != now:
                    one = held.setdefault(now, [0, 0])
                    one[0] += at - since
                    one[1] += 1
                    now, since = name, at
            yield pd.DataFrame([(str(key[0]), k, ms / 1000, n) for k, (ms, n) in sorted(held.items())], columns=["run", "stage", "seconds", "visits"])
            return
        rows = pd.concat(list(batches))
        millis = (rows[t].dt.tz_convert("UTC").dt.tz_localize(None) if rows[t].dt.tz is not None else rows[t]).astype("datetime64[ms]").astype("int64")
        edge = state.getCurrentWatermarkMs()
        good = millis >= edge
        if (~good).any():
            yield pd.DataFrame({"run": [str(key[0])], "stage": [None], "seconds": [float("nan")], "visits": [int((~good).sum())]}).astype({"stage": "object"})
        if good.any():
            old = state.get if state.exists else ([], [])
            times, names = list(old[0]) + millis[good].tolist(), list(old[1]) + rows[stage][good].tolist()
            state.update((times, names))
            state.setTimeoutTimestamp(max(max(times) + wait, edge + 1))
        elif state.exists:
            state.setTimeoutTimestamp(max(max(state.get[0]) + wait, edge + 1))

    marked = events.withWatermark(t, lateness)
    return marked.groupBy(by).applyInPandasWithState(step, kind, "times array<bigint>, names array<string>", "Append", GroupStateTimeout.EventTimeTimeout)


def held_rows(query) -> int:
    """Keys in a streaming query's state, from its last progress."""
    seen = [op for p in query.recentProgress for op in p["stateOperators"]]
    return seen[-1]["numRowsTotal"] if seen else 0


def replayed(stream: DataFrame, name: str, mode: str = "append", latest: list[str] | None = None, batch: Callable | None = None) -> DataFrame:
    """Run a stream over all that its source holds now, and read its table.

    Each batch goes to a folder of its own, written over if it is run again, so a
    restart repeats nothing. With `latest`, the last batch's row of each of
    these keys counts; with mode complete, the last batch.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(df: DataFrame, number: int) -> None:
        (batch(df) if batch else df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/table/part={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{root}/table").parquet(f"{root}/table").drop("part")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    if latest:
        last = rows.groupBy(*latest).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*latest, "batch")]), "batch").alias("row"))
        return last.select(*latest, "row.*")
    return rows.drop("batch")
