"""Intermediate tables in the folder all executors share."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from leafmill.session import release, shared_dir, written

__all__ = ("release", "shared_dir", "together", "written")


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """Results of jobs that do not need each other, run at the same time."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
