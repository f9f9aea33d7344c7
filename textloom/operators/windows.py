"""Line operators as windows over (document, place): for documents too long for array expressions.

Each shuffles once by document (and line); they agree with the array forms in ``cleaning``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, strip


def exploded(df: DataFrame, key: str, c: str) -> DataFrame:
    """(key, pos, line, s): a row for each line, s stripped."""
    return df.select(key, F.posexplode(lines(F.col(c))).alias("pos", "line")).withColumn("s", strip(F.col("line")))


def _by(key: str):
    return Window.partitionBy(key).orderBy("pos")


def occurrence(rows: DataFrame, key: str) -> DataFrame:
    """nth: the occurrence number of a line in its document."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key, "s").orderBy("pos")))


def neighbours(rows: DataFrame, key: str) -> DataFrame:
    """blank_before, blank_after; the edges count as blank."""
    near = lambda f: F.coalesce(f("s").over(_by(key)) == "", F.lit(True))
    return rows.withColumns({"blank_before": near(F.lag), "blank_after": near(F.lead)})


def blocks(rows: DataFrame, key: str) -> DataFrame:
    """block: number of the run of non-blank lines; blank lines have the one before."""
    new = ((F.col("s") != "") & F.coalesce(F.lag("s").over(_by(key)) == "", F.lit(True))).cast("int")
    return rows.withColumn("_new", new).withColumn("block", F.sum("_new").over(_by(key).rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def repeats_last(rows: DataFrame, key: str) -> DataFrame:
    """again: is a line equal to the last non-blank one before it?"""
    last = F.last(F.nullif("s", F.lit("")), ignorenulls=True).over(_by(key).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("again", F.coalesce((F.col("s") != "") & (last == F.col("s")), F.lit(False)))


def joined(rows: DataFrame, key: str, out: str) -> DataFrame:
    """The lines of each document in order, as one text again."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias(out))
