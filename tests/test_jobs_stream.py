"""The job state machine: restarts change nothing, rows in any order within a batch."""

import random

from palimpsest.streaming import jobs

from pyspark.sql import functions as F


def plain(events, items, ms):
    names, state, out = [c.split()[0] for c in jobs.STATE.split(", ")], {}, []
    for job, at, seq, kind in sorted(events, key=lambda e: (e[1], e[2])):
        s = state.setdefault(job, dict(zip(names, jobs.START)))
        reason = jobs.step(s, kind, at, seq, items, ms)
        if reason:
            out.append((job, at, seq, s["phase"], reason, s["found"], s["saved"], s["assets"], s["ignored"]))
    return sorted(out)


def made(n=300):
    rnd = random.Random(6)
    kinds = ["found"] * 6 + ["saved"] * 6 + ["asset"] * 4 + ["indexed", "exported", "finished", "failed", "resumed", "odd"]
    return [(f"j{rnd.randint(0, 5)}", k * 1000 + rnd.randint(0, 400), k, rnd.choice(kinds)) for k in range(n)]


def test_a_stream_in_pieces_equals_one_pass(spark, tmp_path):
    events, out = made(), f"file://{tmp_path}/out"
    frame = lambda rows: spark.createDataFrame(rows, "job_id string, at_ms long, seq long, kind string").select("job_id", F.timestamp_millis("at_ms").alias("at"), "seq", "kind")
    for piece in range(3):  # each piece is read by a query of its own, which goes on from the checkpoint
        part = events[piece * 100 : piece * 100 + 100]
        random.Random(piece).shuffle(part)
        frame(part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        rows = spark.readStream.schema("job_id string, at timestamp, seq long, kind string").parquet(f"file://{tmp_path}/in")
        jobs.drained(jobs.transitions(rows, 4, 20_000), out).awaitTermination()
    found = sorted(tuple(r) for r in spark.read.schema(jobs.OUTPUT).parquet(f"{out}/rows").collect())
    assert found == plain(events, 4, 20_000) and len({r[3] for r in found}) >= 4


def test_steps():
    names = [c.split()[0] for c in jobs.STATE.split(", ")]
    state = dict(zip(names, jobs.START))
    told = [jobs.step(state, kind, at, at, 2, 100) for at, kind in enumerate(["found", "found", "saved", "failed", "found", "resumed", "indexed", "saved"])]
    assert told == [None, "items", None, "failed", None, "resumed", "indexed", None]
    assert (state["phase"], state["found"], state["saved"], state["ignored"]) == ("exporting", 2, 1, 2)
    assert jobs.step(state, "saved", 500, 9, 99, 100) == "time"
