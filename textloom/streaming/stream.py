"""The same operators on streams: all of them work on one document at a time, so append mode suffices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Pipeline


def text_files(spark: SparkSession, path: str, whole: bool = True, per_trigger: int = 1000) -> DataFrame:
    """A stream of text files: (value), one row a file or a line."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path, wholetext=whole)  # as an option, the argument's default overrides it


def parquet_files(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def cleaned(stream: DataFrame, column: str, pipeline: Pipeline | None = None, out: str | None = None) -> DataFrame:
    return (pipeline or Pipeline.from_config()).apply(stream, column, out)


def to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Everything that is there now, exactly once, into files."""
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(stream: DataFrame, checkpoint: str, write) -> StreamingQuery:
    """``write(df, batch_id)`` for each batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
