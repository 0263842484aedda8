"""Live status of runs: the latest event of each, how far it is, and whose it is, as a table or a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A status as a stream holds it; progress is the share of the stages up to the furthest that the run has reached.
_STATUS = "run long, owner string, stage string, at long, event_id long, n_events long, seconds double, progress double"
_STATE = "owner string, stage string, at long, event_id long, n_events long, seconds double, place int"
#: Whose runs without an owner are (fixed value).
ANONYMOUS = "anonymous"


def placed(events: DataFrame, stages: list[str]) -> DataFrame:
    """events (run, owner, stage, ts, event_id, seconds) plus place: the stage's number from 1, 0 for others."""
    found = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage")), F.lit(0))
    owner = F.when(F.coalesce("owner", F.lit("")) == "", ANONYMOUS).otherwise(F.col("owner"))
    return events.where(F.col("run").isNotNull() & F.col("ts").isNotNull()).select(
        F.col("run").cast("long").alias("run"), owner.alias("owner"), F.coalesce("stage", F.lit("")).alias("stage"), F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce("event_id", F.lit(-1)).cast("long").alias("event_id"), F.coalesce("seconds", F.lit(0.0)).cast("double").alias("seconds"), found.cast("int").alias("place"),
    )


def run_status(events: DataFrame, stages: list[str], owner: str | None = None) -> DataFrame:
    """The status of each run of a table of events; with an owner, of that owner's runs.

    The latest event decides, ties by the larger id, then the larger stage; the owner is the one it names. Runs
    without an owner are anonymous. Events without a run or time are left out.
    """
    last = F.max(F.struct("ts", "event_id", "stage", "owner"))
    per = placed(events, stages).groupBy("run").agg(last.alias("x"), F.count(F.lit(1)).alias("n_events"), F.sum("seconds").alias("seconds"), F.max("place").alias("place"))
    out = per.select("run", "x.owner", "x.stage", "x.ts", "x.event_id", "n_events", "seconds", (F.col("place") / len(stages)).alias("progress"))
    return out if owner is None else out.where(F.col("owner") == owner)


def live_status(events: DataFrame, stages: list[str], late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """The statuses that change, of a stream of events, to be written in update mode.

    State is one row per run that had an event in the last idle period, by event time; older runs are let go of. Events may come
    in any order and up to late behind the newest; an event that is older than what its run has seen counts
    but does not become its status. Events beyond the watermark are dropped. Equal events are two events.
    """
    period = int(pd.Timedelta(idle).total_seconds() * 1000)

    def follow(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        owner, stage, at, event_id, n, seconds, place = state.get if state.exists else ("", "", -(1 << 62), -(1 << 62), 0, 0.0, 0)
        for part in rows:
            if part.empty:
                continue
            top = part.sort_values(["at", "event_id", "stage", "owner"], kind="stable").iloc[-1]
            new = (int(top["at"]), int(top["event_id"]), top["stage"], top["owner"])
            if new > (at, event_id, stage, owner):
                at, event_id, stage, owner = new
            n, seconds, place = n + len(part), seconds + float(part["seconds"].sum()), max(place, int(part["place"].max()))
        state.update((owner, stage, at, event_id, n, seconds, place))
        state.setTimeoutTimestamp(max(at // 1000 + period, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run": [key[0]], "owner": [owner], "stage": [stage], "at": [at], "event_id": [event_id], "n_events": [n], "seconds": [seconds], "progress": [place / len(stages)]})

    held = placed(events, stages).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    changed = held.groupBy("run").applyInPandasWithState(follow, _STATUS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return changed.select("run", "owner", "stage", F.timestamp_micros("at").alias("ts"), "event_id", "n_events", "seconds", "progress")


def write_status(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch of updates to a folder of its own under path, so a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame, owner: str | None = None) -> DataFrame:
    """The last update of each run, of a table of what live_status gave: more events are later."""
    order = Window.partitionBy("run").orderBy(F.desc("n_events"), F.desc("ts"))
    out = updates.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return out if owner is None else out.where(F.col("owner") == owner)
