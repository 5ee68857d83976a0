"""The job log as a stream: what was resumable ticks is micro-batches, with Spark's checkpoints as the cursor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def status_counts(events: DataFrame, *, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """start, event_type and n by tumbling window; events later than the watermark allows are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def takeovers(events: DataFrame, *, lease_seconds: int = 120) -> DataFrame:
    """job, position and takeovers: how often in a row a job's lease of ``lease_seconds`` lapsed at one position.

    events: job long, position string, ts timestamp, in the order of their micro-batches. State is one row a job.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, seen, count = state.get if state.exists else (None, None, 0)
        for position, ts in sorted(((p, t) for f in frames for p, t in zip(f["position"], f["ts"])), key=lambda x: x[1]):
            now = ts.timestamp()
            lapsed = seen is not None and now - seen > lease_seconds
            count = (count + lapsed if position == mark else 0)
            mark, seen = position, now
        state.update((mark, seen, count))
        yield pd.DataFrame({"job": [key[0]], "position": [mark], "takeovers": [int(count)]})

    return events.groupBy("job").applyInPandasWithState(update, "job long, position string, takeovers int", "mark string, seen double, count int", "update", GroupStateTimeout.NoTimeout)


def lapses(events: DataFrame, *, lease_seconds: int = 120, late: str = "0 seconds", most: int = 3) -> DataFrame:
    """job, position, at, takeovers and given_up for each lease of ``lease_seconds`` that lapsed, told when it lapses: when the stream's time passes it, whether or not the job is heard of again.

    events: job long, position string, ts timestamp. Each event renews its job's lease. Takeovers count the
    lapses in a row at one position; from the ``most``-th on the job is given up. A timer on event time, behind the watermark of ``late``, ends
    a lease; events of one job within a micro-batch are taken in order, and a lapse between two of them counts too. State is one row a job; events later than the watermark are left out, as are null jobs and times.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, until, count = state.get if state.exists else (None, None, 0)
        told = []

        def lapse() -> None:
            nonlocal count, until
            count += 1
            told.append((key[0], mark, pd.Timestamp(until, unit="ms"), count, count >= most))
            until = None

        if state.hasTimedOut:
            lapse()
        else:
            for position, ts in sorted(((p, t) for f in frames for p, t in zip(f["position"], f["ts"])), key=lambda x: (x[1], str(x[0]))):
                now = int(ts.timestamp() * 1000)
                if until is not None and now > until:
                    lapse()
                if position != mark:
                    mark, count = position, 0
                until = max(now + lease_seconds * 1000, until or 0)
        state.update((mark, until, count))
        if until is not None:
            # A timer can't lie before the watermark; one that would is due at once.
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(told, columns=["job", "position", "at", "takeovers", "given_up"])

    known = events.where("job is not null and ts is not null").withWatermark("ts", late)
    return known.groupBy("job").applyInPandasWithState(update, "job long, position string, at timestamp, takeovers int, given_up boolean", "mark string, until long, count int", "append", GroupStateTimeout.EventTimeTimeout)


def lapses_of_log(events: DataFrame, until: Column, *, lease_seconds: int = 120, most: int = 3) -> DataFrame:
    """The same rows from a log that is over: what ``lapses`` tells once the stream's time is ``until``."""
    by_job = Window.partitionBy("job").orderBy("ts", "position")
    seen = events.where("job is not null and ts is not null").select("job", "position", "ts")
    seen = seen.withColumns({"at": F.col("ts") + F.make_dt_interval(secs=F.lit(lease_seconds)), "next": F.lead("ts").over(by_job)})
    seen = seen.withColumn("moved", ~F.coalesce(F.lag("position").over(by_job).eqNullSafe(F.col("position")), F.lit(False)))
    stay = F.sum(F.coalesce(F.col("moved").cast("int"), F.lit(0))).over(by_job.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lapsed = seen.withColumn("stay", stay).where(F.coalesce("next", until) > F.col("at"))
    count = F.row_number().over(Window.partitionBy("job", "stay").orderBy("ts", "position"))
    return lapsed.select("job", "position", "at", count.alias("takeovers"), (count >= most).alias("given_up"))


def write_once(path: str):
    """A foreachBatch sink that writes each micro-batch under its number: a replayed one overwrites itself, so rows come exactly once."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
