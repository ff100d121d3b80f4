"""A bounded pool of Spark jobs that do not wait for each other."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

PARALLEL = 4


def together(spark: SparkSession, jobs: Sequence[Callable[[], object]], parallel: int = PARALLEL) -> list:
    """Run the jobs, so many at once, each in a scheduler pool of its own; results in the order of the jobs.

    When one fails, those that wait are dropped, the Spark jobs of those that run are cancelled, and the
    error is raised.
    """
    context, group = spark.sparkContext, f"together-{uuid.uuid4().hex}"

    def run(number: int, job: Callable[[], object]):
        context.setJobGroup(group, f"{group} {number}", True)
        context.setLocalProperty("spark.scheduler.pool", f"{group}-{number % parallel}")
        try:
            return job()
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(parallel) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(run), i, job) for i, job in enumerate(jobs)]
        done, _ = wait(waiting, return_when=FIRST_EXCEPTION)
        failed = next((f.exception() for f in waiting if f in done and f.exception()), None)
        if failed:
            for f in waiting:
                f.cancel()
            context.cancelJobGroup(group)
            raise failed
    return [f.result() for f in waiting]
