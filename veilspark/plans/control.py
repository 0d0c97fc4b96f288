"""A deadline for an action on a DataFrame: past it the jobs are cancelled, and nothing is returned."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")
SECONDS = 300.0


class DeadlineExceeded(RuntimeError):
    pass


def run_within(spark: SparkSession, action: Callable[[], T], seconds: float = SECONDS) -> T:
    """action(), whose Spark jobs form a group that ends after `seconds`. What an action writes must be committed at its end,
    as Spark's writers do, so that a cancelled one leaves no part of it."""
    sc, group, late = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def end() -> None:
        late.set()
        sc.cancelJobGroup(group)

    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    timer = threading.Timer(seconds, end)
    sc.setJobGroup(group, "with a deadline", interruptOnCancel=True)
    timer.start()
    try:
        out = action()
    except Exception as e:
        if late.is_set():
            raise DeadlineExceeded(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for k, v in before.items():
            sc.setLocalProperty(k, v)
    if late.is_set():
        raise DeadlineExceeded(f"more than {seconds} s")
    return out
