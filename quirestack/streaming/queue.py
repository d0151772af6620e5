"""Streams over event files: latest job states, expiry, windows with late data, per-key state."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirestack.operators.jobs import CANCELLED, DEAD, DONE, LEASE_S, MOST_TRIES, Job


def read_events(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files of a folder that match the pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts for each window and key; rows later than ``late`` behind the newest are left out, and closed windows leave the state."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp"))
    return stamped.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("events"))


STATE = "key long, state string, attempts int, last_event long"


def job_states(events: DataFrame, key: str, kind: str, number: str, most: int = 3) -> DataFrame:
    """The state of each key's job after its events in order: purchase ends it, an error retries it until ``most`` attempts, then it is dead."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, tries, last = state.get if state.exists else ("queued", 0, -1)
        rows = pd.concat(list(frames)).sort_values(number)
        for what, no in zip(rows[kind], rows[number], strict=True):
            if no <= last or name in ("done", "dead"):  # a replayed event changes nothing
                continue
            last = int(no)
            if what == "purchase":
                name = "done"
            elif what == "error":
                tries += 1
                name = "dead" if tries >= most else "retrying"
            else:
                name = "running"
        state.update((name, tries, last))
        yield pd.DataFrame({"key": [k[0]], "state": [name], "attempts": [tries], "last_event": [last]})

    return events.groupBy(key).applyInPandasWithState(run, STATE, "state string, attempts int, last_event long", "update", GroupStateTimeout.NoTimeout)


JOB_STATE = "state string, holder long, token long, tries int, until double, seen long"
#: How long after its last entry the state of a finished job is kept, to tell replayed entries, and how late an entry may come.
KEEP_MS, LATE = 7 * 24 * 3_600_000, "2 days"


def job_stream(log: DataFrame, key: str, number: str, at: str, what: str, worker: str, stamp: str, most: int = MOST_TRIES, lease: float = LEASE_S) -> DataFrame:
    """``jobs.job_log`` over a stream: one row for each entry as it comes, with the job's state after it.

    Entries of one micro-batch are taken in the order of ``number``; one that comes later than a larger number counts as
    replayed, so a batch that runs again changes nothing.  ``stamp`` is the entries' time; the state of a
    finished job leaves once the watermark is KEEP_MS past its last entry.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        job = Job(most, lease)
        if state.exists:
            job.state, job.holder, job.token, job.tries, job.until, job.seen = state.get
        rows = pd.concat(list(frames)).sort_values(number, kind="stable")
        out = []
        for n, t, w, who in zip(rows[number], rows[at], rows[what], rows[worker], strict=True):
            ok, why = job.take(int(n), float(t), w, int(who))
            out.append((k[0], int(n), job.state, job.tries, job.token, ok, why))
        state.update((job.state, job.holder, job.token, job.tries, job.until, job.seen))
        if job.state in (DONE, DEAD, CANCELLED):
            last = int(rows[stamp].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + KEEP_MS)
        yield pd.DataFrame(out, columns=["key", "number", "state", "tries", "token", "accepted", "reason"])

    made = "key long, number long, state string, tries int, token long, accepted boolean, reason string"
    return log.select(key, number, at, what, worker, stamp).withWatermark(stamp, LATE).groupBy(key).applyInPandasWithState(run, made, JOB_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and give its result.  The sink writes each micro-batch under its number, so
    that a batch that runs again replaces itself."""
    spark = stream.sparkSession
    from quirestack.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{shared}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint or f"{shared}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{shared}/out").drop("batch")
