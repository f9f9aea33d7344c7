"""Arbitrary functions over rows, with failures as rows; batches; map and reduce."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def process_items(df: DataFrame, column: str, f: Callable, result: str = "string") -> DataFrame:
    """Adds result, success, error and processing_time of ``f`` on each value."""

    @F.pandas_udf(f"result {result}, success boolean, error string, processing_time double")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            t = time.perf_counter()
            try:
                rows.append((f(x), True, None, time.perf_counter() - t))
            except Exception as e:
                rows.append((None, False, f"{type(e).__name__}: {e}", time.perf_counter() - t))
        return pd.DataFrame(rows, columns=["result", "success", "error", "processing_time"], dtype=object).astype({"success": bool, "processing_time": float})

    return df.withColumn("_r", run(F.col(column))).select(*df.columns, "_r.*")


def process_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` on each Arrow batch."""

    def run(it: Iterator[pd.DataFrame]):
        for b in it:
            yield f(b)

    return df.mapInPandas(run, schema)


def map_reduce(df: DataFrame, column: str, f: Callable, reduce: Callable = F.sum, result: str = "double"):
    """Reduce of the mapped values; values that fail are left out."""
    return process_items(df, column, f, result).where("success").agg(reduce("result").alias("result")).first()[0]


def ordered(results: DataFrame, index: str = "original_index") -> DataFrame:
    """Successes in input order."""
    return results.where("success").orderBy(index)
