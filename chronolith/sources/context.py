"""Context from several outside sources at once: each fails alone, and all have one deadline."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import wait as wait_for

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "source string, status string, payload string, error string"


def collect(spark: SparkSession, fetchers: dict[str, Callable[[], object]], deadline: float = 90.0) -> DataFrame:
    """A row a source, in name order: status ok with its payload as JSON, error with the kind of error, or late after the deadline.
    Late fetchers are left to end by themselves. No fetchers give no rows."""
    pool = ThreadPoolExecutor(max_workers=max(1, len(fetchers)))
    began = time.monotonic()
    jobs = {name: pool.submit(f) for name, f in fetchers.items()}
    wait_for(jobs.values(), timeout=max(0.0, deadline - (time.monotonic() - began)))
    rows = []
    for name, job in sorted(jobs.items()):
        if not job.done():
            rows.append((name, "late", None, None))
        elif job.exception() is not None:
            rows.append((name, "error", None, type(job.exception()).__name__))
        else:
            rows.append((name, "ok", json.dumps(job.result(), sort_keys=True), None))
    pool.shutdown(wait=False, cancel_futures=True)
    return spark.createDataFrame(rows, SCHEMA)
