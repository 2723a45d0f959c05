"""Job records: states, history and what a restart does with interrupted runs."""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, QUEUE = 500, 32
OPEN = ("queued", "running", "cancelling")
FINAL = ("complete", "error", "cancelled")


def keep_newest(jobs: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest records by updated_at, ties by id; a bounded top-k, not a sort of all in one task."""
    return jobs.orderBy(F.desc("updated_at"), "id").limit(keep)


def sweep_interrupted(jobs: DataFrame) -> DataFrame:
    """Runs that a restart found open are errors now; their envelopes say so."""
    stopped = F.col("status").isin(*OPEN)
    return jobs.withColumn("status", F.when(stopped, "error").otherwise(F.col("status")))


def upsert(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """One record an id, the newest by updated_at; of equal times the new one."""
    both = jobs.withColumn("r", F.lit(0)).unionByName(new.withColumn("r", F.lit(1)))
    w = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("r"))
    return both.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k", "r")


class QueueFull(RuntimeError):
    """The queue holds as many jobs as it may."""


@dataclass
class JobQueue:
    """One job at a time, in order; beyond the limit submissions are refused."""

    run: Callable[[dict], dict]
    limit: int = QUEUE
    waiting: deque = field(default_factory=deque)
    records: dict[str, dict] = field(default_factory=dict)

    def submit(self, request: dict) -> str:
        if len(self.waiting) >= self.limit:
            raise QueueFull(f"{self.limit} jobs are waiting")
        job = uuid.uuid4().hex[:12]
        self.records[job] = {"id": job, "status": "queued", "request": request, "updated_at": time.time()}
        self.waiting.append(job)
        return job

    def cancel(self, job: str) -> bool:
        """A queued job is cancelled at once, a running one at its next batch; final ones stay."""
        record = self.records.get(job)
        if record is None or record["status"] in FINAL:
            return False
        record["status"] = "cancelled" if record["status"] == "queued" else "cancelling"
        record["updated_at"] = time.time()
        return True

    def step(self) -> str | None:
        """Run the next waiting job; its id, None where none waits."""
        while self.waiting:
            job = self.waiting.popleft()
            record = self.records[job]
            if record["status"] != "queued":
                continue
            record["status"] = "running"
            try:
                record["result"] = self.run(record["request"])
                record["status"] = "cancelled" if record["status"] == "cancelling" else "complete"
            except Exception as e:  # noqa: BLE001
                record["status"], record["error"] = "error", str(e)
            record["updated_at"] = time.time()
            return job
        return None

    def table(self, spark) -> DataFrame:
        from lamplight.schemas import JOBS

        rows = [(r["id"], r["status"], json.dumps(r, default=str), float(r["updated_at"])) for r in self.records.values()]
        return spark.createDataFrame(rows, JOBS)
