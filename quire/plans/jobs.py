"""Cancelling and following the jobs of a task by its name."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def job_scope(spark: SparkSession, name: str) -> Iterator[str]:
    """Jobs started inside belong to the group ``name``; if the block fails, those still running are cancelled."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield name
    except BaseException:
        context.cancelJobGroup(name)
        raise
    finally:
        context.setLocalProperty("spark.jobGroup.id", before)


def cancel(spark: SparkSession, name: str) -> None:
    """Cancel the running jobs of a group, from any thread."""
    spark.sparkContext.cancelJobGroup(name)


def progress(spark: SparkSession, name: str) -> tuple[int, int]:
    """(tasks done, tasks known) of a group's jobs so far; those of stages that Spark skips stay undone."""
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for job in tracker.getJobIdsForGroup(name):
        for stage in (info.stageIds if (info := tracker.getJobInfo(job)) else ()):
            if s := tracker.getStageInfo(stage):
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done, total
