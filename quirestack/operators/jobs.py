"""Jobs with leases: claims, renewals, retries, dead letters and the steps done, from a log that may be replayed.

The log of one job is short (its attempts are bounded), so each is folded in order by one state machine; jobs are spread
over all tasks and no task holds more than one job's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEASE_S, MOST_TRIES = 3600.0, 3
#: States of a job.
QUEUED, RUNNING, DONE, DEAD, CANCELLED = "queued", "running", "done", "dead", "cancelled"

RESULT = "state string, holder long, token long, tries int, lease_until double, seen long, accepted boolean, reason string"


class Job:
    """One job's state.  ``token`` grows with each claim, so that a holder whose lease ran out can be told from the next."""

    def __init__(self, most: int, lease: float) -> None:
        self.state, self.holder, self.token, self.tries, self.until, self.seen = QUEUED, None, 0, 0, 0.0, -1
        self.most, self.lease = most, lease

    def holds(self, worker: int, at: float) -> bool:
        return self.state == RUNNING and self.holder == worker and at < self.until

    def take(self, number: int, at: float, what: str, worker: int) -> tuple[bool, str]:
        """Whether the entry counts, and why not."""
        if number <= self.seen:
            return False, "replayed"
        self.seen = number
        if self.state in (DONE, DEAD, CANCELLED):
            return False, "finished"
        if what == "claim":
            if self.state == RUNNING and at < self.until:
                return False, "leased"
            if self.tries >= self.most:
                self.state, self.holder = DEAD, None
                return False, "no tries left"
            self.state, self.holder, self.token, self.tries, self.until = RUNNING, worker, self.token + 1, self.tries + 1, at + self.lease
            return True, ""
        if what == "cancel":
            self.state, self.holder = CANCELLED, None
            return True, ""
        if what not in ("renew", "finish", "fail"):
            return False, "unknown"
        if not self.holds(worker, at):
            return False, "no lease"
        if what == "renew":
            self.until = at + self.lease
        elif what == "finish":
            self.state, self.holder = DONE, None
        else:
            self.state, self.holder = (DEAD if self.tries >= self.most else QUEUED), None
        return True, ""


def job_log(log: DataFrame, key: str, number: str, at: str, what: str, worker: str, most: int = MOST_TRIES, lease: float = LEASE_S) -> DataFrame:
    """Each entry of ``log`` with the job's state after it, whether it was ``accepted`` and the ``reason`` if not.

    ``number`` orders the entries of a job and tells replays; ``at`` is in seconds; ``what`` is claim, renew, finish, fail
    or cancel.  The first claim starts the job; renew, finish and fail count only for the worker that holds a lease that
    has not run out; a failed job is claimed again until ``most`` tries are used up, then it is dead.  Entries with a null
    key are left out.  The state is carried over batches, so a task's memory does not depend on the size of a log.
    """
    rows = log.where(log[key].isNotNull()).select(key, number, at, what, worker)
    own = T.StructType.fromDDL(RESULT)
    schema = T.StructType([*rows.schema.fields, *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, job = None, None
        for b in batches:
            keys, *cols = (b.column(i).to_pylist() for i in range(5))
            out = []
            for k, n, t, w, who in zip(keys, *cols, strict=True):
                if job is None or k != held:
                    held, job = k, Job(most, lease)
                ok, why = job.take(n, t, w, who)
                out.append((job.state, job.holder, job.token, job.tries, job.until, job.seen, ok, why))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=schema.names)

    return rows.repartition(key).sortWithinPartitions(key, number).mapInArrow(run, schema)
