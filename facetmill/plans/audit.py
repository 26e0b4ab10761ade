"""What the stages of a run cost: seconds, jobs, stages, tasks and failures by Spark's status tracker, rows by observed
metrics, and the peak memory of Python workers."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COLUMNS = "run string, stage string, seconds double, jobs int, stages int, tasks int, failed_tasks int, rows long, peak_worker_mb double"


def peak_worker_mb(spark: SparkSession) -> float:
    """The largest resident memory so far of the Python workers that answer a task each."""

    def run(batches):
        import resource

        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024.0])], ["mb"])

    n = 2 * spark.sparkContext.defaultParallelism
    return spark.range(0, n, 1, n).mapInArrow(run, "mb double").agg(F.max("mb")).first()[0]


@dataclass
class Audit:
    """Collects a row for each stage of a run, failed ones included."""

    spark: SparkSession
    run: str
    memory: bool = True
    found: list[tuple] = field(default_factory=list)

    def observed(self, df: DataFrame, name: str) -> DataFrame:
        """df, whose rows are counted when an action reads them inside the stage."""
        self._observation = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self._observation, F.count(F.lit(1)).alias("rows"))

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        context, group = self.spark.sparkContext, f"{self.run}|{name}|{uuid.uuid4().hex}"
        self._observation, began = None, time.perf_counter()
        context.setJobGroup(group, f"{self.run}: {name}")
        try:
            yield
        finally:
            seconds = time.perf_counter() - began
            context.setLocalProperty("spark.jobGroup.id", None)
            tracker = context.statusTracker()
            jobs = tracker.getJobIdsForGroup(group)
            numbers = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
            infos = [info for s in numbers if (info := tracker.getStageInfo(s))]
            rows = self._observation.get.get("rows") if self._observation is not None else None
            peak = peak_worker_mb(self.spark) if self.memory else None
            self.found.append((self.run, name, seconds, len(jobs), len(infos), sum(i.numCompletedTasks for i in infos), sum(i.numFailedTasks for i in infos), rows, peak))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.found, COLUMNS)
