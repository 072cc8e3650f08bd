"""Watching, stopping and starting over: runs by name (see ``Config.name``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import registry


def progress(spark: SparkSession, name: str) -> tuple[int, int]:
    """Finished and known tasks of the stages that a named run has in work."""
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for job in tracker.getJobIdsForGroup(name):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s:
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done, total


def cancel(spark: SparkSession, name: str) -> None:
    """Stops the jobs of a named run. Its registry is only handed over at the end, so nothing is numbered by half."""
    spark.sparkContext.cancelJobGroup(name)


def reset_run(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A registry without entries and no retired numbers: the next run numbers from 1."""
    return registry.empty(spark), registry.no_retired(spark)
