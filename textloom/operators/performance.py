"""Timings of operations, on the driver: a context, a decorator, statistics and a JSON report."""

from __future__ import annotations

import functools
import json
import statistics
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Timings:
    def __init__(self):
        self.seconds: dict[str, list[float]] = {}
        self.began = time.time()

    def record(self, name: str, seconds: float) -> None:
        self.seconds.setdefault(name, []).append(seconds)

    @contextmanager
    def operation(self, name: str):
        t = time.perf_counter()
        try:
            yield
        finally:
            self.record(name, time.perf_counter() - t)

    def timed(self, name: str | None = None) -> Callable:
        def wrap(f: Callable) -> Callable:
            @functools.wraps(f)
            def run(*args, **kwargs):
                with self.operation(name or f.__name__):
                    return f(*args, **kwargs)

            return run

        return wrap

    def stats(self) -> dict[str, dict[str, float]]:
        return {n: {"count": len(x), "total": sum(x), "average": statistics.fmean(x), "median": statistics.median(x), "min": min(x), "max": max(x), "stdev": statistics.stdev(x) if len(x) > 1 else 0.0} for n, x in self.seconds.items()}

    def report(self) -> dict:
        found = self.stats()
        return {"started": self.began, "elapsed_seconds": time.time() - self.began, "total_operations": sum(x["count"] for x in found.values()), "operations": found}

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.report(), f, indent=2, sort_keys=True)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(operation, seconds) rows, for ``metrics.operation_stats``."""
        return spark.createDataFrame([(n, x) for n, xs in self.seconds.items() for x in xs], "operation string, seconds double")

    def reset(self) -> None:
        self.seconds.clear()


def tokens_by(encode: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """Token counts by a tokenizer: ``encode`` makes its encoding function, once in each worker batch. Null counts 0."""

    @F.pandas_udf("int")
    def run(s):
        f = encode()
        return s.map(lambda t: 0 if t is None else len(f(t)))

    return run


def throughput(df: DataFrame, tokens: str, seconds: str) -> DataFrame:
    """Files, tokens and tokens a second over all rows with a time."""
    timed = F.col(seconds) > 0
    total, spent = F.sum(F.when(timed, F.col(tokens))), F.sum(F.when(timed, F.col(seconds)))
    return df.agg(F.count("*").alias("files"), F.sum(tokens).alias("tokens"), F.when(spent > 0, F.bround(total / spent, 2)).alias("tokens_per_second"))
