"""Several stages of one driver at once, in pools of a fair scheduler; the first failure cancels the others."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def at_once[T](spark: SparkSession, tasks: dict[str, Callable[[], T]], workers: int = 4) -> dict[str, T]:
    """The result of each task by name. Each runs in a thread with its own job tag and scheduler pool.

    If one fails, the jobs of the others are cancelled, those that haven't begun never begin, and the error is raised
    with the task's name once all have ended.
    """
    if not tasks:
        return {}
    failed: list[str] = []

    def run(name: str, task: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        spark.sparkContext.addJobTag(f"at-once-{name}")
        try:
            if failed:
                raise RuntimeError(f"{name} not run, as {failed[0]} failed")
            return task()
        except BaseException:
            failed.append(name)
            raise
        finally:
            spark.sparkContext.removeJobTag(f"at-once-{name}")
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(workers, len(tasks)))) as pool:
        futures = {name: pool.submit(inheritable_thread_target(spark)(run), name, task) for name, task in tasks.items()}
        _, open_ones = wait(futures.values(), return_when=FIRST_EXCEPTION)
        if failed:
            for name, future in futures.items():
                if not future.cancel() and not future.done():
                    spark.sparkContext.cancelJobsWithTag(f"at-once-{name}")
            while open_ones:  # a task between two jobs has none to cancel yet
                _, open_ones = wait(open_ones, timeout=0.2)
                for name, future in futures.items():
                    if not future.done():
                        spark.sparkContext.cancelJobsWithTag(f"at-once-{name}")
            first = failed[0]
            raise RuntimeError(f"{first} failed: {futures[first].exception()}") from futures[first].exception()
    return {name: future.result() for name, future in futures.items()}
