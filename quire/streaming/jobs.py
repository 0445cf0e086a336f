"""Job states and event windows, over streams and tables alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values of polling: first wait, factor, longest wait and deadline, in seconds.
FIRST, FACTOR, LONGEST, DEADLINE = 3.0, 1.5, 15.0, 600.0
STATE_OF = {"signup": "pending", "view": "running", "click": "running", "purchase": "done", "error": "failed"}
OUT = "job_id long, state string, n long, changes long"


def poll_times(deadline: float = DEADLINE) -> list[float]:
    """When a job is asked for, until the deadline."""
    out, at, wait = [], FIRST, FIRST
    while at <= deadline:
        out.append(at)
        wait = min(LONGEST, wait * FACTOR)
        at += wait
    return out


def job_events(events: DataFrame) -> DataFrame:
    """(job_id, ts, event_id, state): a job a user."""
    state = F.create_map(*[F.lit(x) for kv in STATE_OF.items() for x in kv])
    return events.select(F.col("user_id").alias("job_id"), "ts", "event_id", F.element_at(state, F.col("event_type")).alias("state"))


def job_states(events: DataFrame) -> DataFrame:
    """Of each job the last state, the number of events, and how often the state changed, of a whole table."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    marked = job_events(events).withColumn("before", F.lag("state").over(w))
    return marked.groupBy("job_id").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"), F.sum((F.col("before").isNotNull() & (F.col("before") != F.col("state"))).cast("long")).alias("changes"))


def track_jobs(stream: DataFrame, timeout_ms: int = int(DEADLINE * 1000)) -> DataFrame:
    """The same over a stream of job events, a row for each job that a batch touches; a job that is not heard of for timeout_ms ends as 'timeout'."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n, changes = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "timeout", n, changes)], columns=["job_id", "state", "n", "changes"])
            return
        last, n, changes = state.get if state.exists else ("", 0, 0)
        for now in pd.concat(list(frames)).sort_values(["ts", "event_id"])["state"]:
            changes += bool(last) and now != last
            last, n = now, n + 1
        if last in ("done", "failed"):
            state.update((last, n, changes))
        else:
            state.update((last, n, changes))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], last, n, changes)], columns=["job_id", "state", "n", "changes"])

    return stream.groupBy("job_id").applyInPandasWithState(step, OUT, "state string, n long, changes long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def event_windows(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Count and sum of values by tumbling window and type; with late, a watermark for streams."""
    given = events.withWatermark("ts", late) if late else events
    out = given.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    given = events.withWatermark("ts", late) if late else events
    out = given.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
