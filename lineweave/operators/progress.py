"""What a finished sort says about itself: balance of its parts, times of its tasks."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

from lineweave.operators.order import Slices


@dataclass(frozen=True)
class TaskTimes:
    """Of the tasks of one stage: how many, seconds of the shortest and the longest, and seconds that
    all of them together waited for bytes of the exchange."""

    tasks: int
    shortest: float
    longest: float
    waited: float


def last_stage(spark: SparkSession) -> TaskTimes | None:
    """The times of the stage that finished last, or None if Spark keeps none."""
    sc = spark.sparkContext
    try:
        store = sc._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        done = [s for s in (stages.apply(i) for i in range(stages.size())) if s.numCompleteTasks()]
        if not done:
            return None
        stage = max(done, key=lambda s: s.stageId())
        ends = sc._gateway.new_array(sc._jvm.double, 2)
        ends[0], ends[1] = 0.0, 1.0
        summary = store.taskSummary(stage.stageId(), stage.attemptId(), ends).get()
        run, wait = summary.executorRunTime(), summary.shuffleReadMetrics().fetchWaitTime()
        return TaskTimes(stage.numCompleteTasks(), run.apply(0) / 1e3, run.apply(1) / 1e3, max(wait.apply(1), 0) * stage.numCompleteTasks() / 1e3)
    except (Py4JError, TypeError):  # another version of Spark keeps them elsewhere
        return None


def merge_summary(parts: list[int], times: TaskTimes | None) -> str:
    """One sentence on the ordered parts of a sort, from their bytes."""
    slices = Slices([], parts)
    text = f"{slices.non_empty} of {len(parts)} ranges hold lines, the largest {slices.imbalance:.2f} times the smallest"
    if times is not None:
        text += f"; tasks took {times.shortest:.1f} to {times.longest:.1f} s"
    return text + "."
