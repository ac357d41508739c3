"""Incremental jobs as a stream: each job's state machine lives in the state store and goes on after a restart.

Events (job_id, at, seq, kind, id) move a job through its phases.  ``found`` items
count while it is indexing, until ``indexed``; ``saved`` ones while it is
exporting, until ``exported``; ``asset`` ones until ``finished``; ``failed`` sends a
job from any phase to failed, ``resumed`` back to the phase it failed in.  What
does not belong to a phase is ignored, and counted.

A row is written at each transition, and for a checkpoint: when ``items`` counted
items, or ``ms`` of event time, have passed since the last row.  A job without
events for ``ttl_ms`` is forgotten (0: never).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "job_id string, at_ms long, seq long, phase string, reason string, found long, saved long, assets long, ignored long"
STATE = "phase string, before string, found long, saved long, assets long, ignored long, pending long, told_ms long, last_ms long, last_seq long"
START = ("indexing", "", 0, 0, 0, 0, 0, -1, -1, -1)
#: phase -> (the event that counts in it, the event that ends it, the next phase)
PHASES = {"indexing": ("found", "indexed", "exporting"), "exporting": ("saved", "exported", "assets"), "assets": ("asset", "finished", "done")}
COUNTED = {"found": "found", "saved": "saved", "asset": "assets"}


def step(state: dict, kind: str, at_ms: int, seq: int, items: int, ms: int) -> str | None:
    """Move a job by one event, in place; the reason to write a row, if there is one."""
    if state["told_ms"] < 0:
        state["told_ms"] = at_ms
    counts, ends, following = PHASES.get(state["phase"], (None, None, None))
    reason = None
    if kind == "failed" and state["phase"] not in ("failed", "done"):
        state["before"], state["phase"], reason = state["phase"], "failed", "failed"
    elif kind == "resumed" and state["phase"] == "failed":
        state["phase"], reason = state["before"], "resumed"
    elif kind == ends and ends:
        state["phase"], reason = following, kind
    elif kind == counts and counts:
        state[COUNTED[kind]] += 1
        state["pending"] += 1
        reason = "items" if state["pending"] >= items else "time" if at_ms - state["told_ms"] >= ms else None
    else:
        state["ignored"] += 1
    if reason:
        state["pending"], state["told_ms"] = 0, at_ms
    state["last_ms"], state["last_seq"] = at_ms, seq
    return reason


class Job(StatefulProcessor):
    def __init__(self, items: int, ms: int, ttl_ms: int):
        self.items, self.ms, self.ttl_ms = items, ms, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("job", STATE, self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues):
        names = [c.split()[0] for c in STATE.split(", ")]
        state = dict(zip(names, self.state.get() if self.state.exists() else START, strict=True))
        out = []
        # a micro-batch holds a job's new events in any order
        for at_ms, seq, kind in sorted((int(r.at_ms), int(r.seq), r.kind) for frame in rows for r in frame.itertuples()):
            reason = step(state, kind, at_ms, seq, self.items, self.ms)
            if reason:
                out.append((key[0], at_ms, seq, state["phase"], reason, *(state[c] for c in ("found", "saved", "assets", "ignored"))))
        self.state.update(tuple(state[n] for n in names))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, items: int = 100, ms: int = 60_000, ttl_ms: int = 0) -> DataFrame:
    """A stream of job rows from a stream of events (job_id, at, seq, kind); sets the session's state store to one that keeps such state."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), F.col("seq").cast("long").alias("seq"), F.col("kind").cast("string").alias("kind"))
    return rows.groupBy("job_id").transformWithStateInPandas(Job(items, ms, ttl_ms), OUTPUT, "Append", "none" if not ttl_ms else "ProcessingTime")


def drained(rows: DataFrame, out: str):
    """Starts a query that appends a stream of job rows to a table below ``out``, and ends when all there is was read."""
    return rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
