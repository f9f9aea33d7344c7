"""Lengths, token estimates, reduction rates, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import S


def token_estimate(c: Column) -> Column:
    """Words and the marks . , ! ? ; : of a text."""
    return F.regexp_count(c, F.lit(r"(?U)\w+|[.,!?;:]"))


def word_estimate(c: Column) -> Column:
    """Parts of str.split()."""
    return F.regexp_count(c, F.lit(rf"(?U)[^{S}]+"))


def reduction_percent(before: Column, after: Column) -> Column:
    """round(100 - after / before * 100, 2), half to even; 0 if there was nothing."""
    return F.when(before == 0, F.lit(0.0)).otherwise(F.bround(100 - after / F.when(before == 0, None).otherwise(before) * 100, 2))


def measured(df: DataFrame, raw: str, processed: str, seconds: str | None = None, bytes_: str | None = None) -> DataFrame:
    """Add lengths, token estimates, both reduction rates and, given times, the throughput."""
    df = df.withColumns({"original_length": F.length(raw), "processed_length": F.length(processed), "original_tokens": token_estimate(F.col(raw)), "processed_tokens": token_estimate(F.col(processed))})
    df = df.withColumns({"text_length_reduction_percent": reduction_percent(F.col("original_length"), F.col("processed_length")), "token_reduction_percent": reduction_percent(F.col("original_tokens"), F.col("processed_tokens"))})
    if seconds:
        timed = F.col(seconds) > 0
        df = df.withColumn("characters_per_second", F.when(timed, F.bround(F.col("original_length") / F.col(seconds), 2)))
        if bytes_:
            df = df.withColumn("kb_per_second", F.when(timed, F.bround(F.col(bytes_) / 1024 / F.col(seconds), 2)))
    return df


def size_columns(bytes_: Column) -> dict[str, Column]:
    return {"file_size_kb": F.bround(bytes_ / 1024, 2), "file_size_mb": F.bround(bytes_ / 1048576, 2)}


def size_reduction(before: Column, after: Column) -> Column:
    """1 - after / before; 0 where either is 0."""
    return F.when((before == 0) | (after == 0), F.lit(0.0)).otherwise(1 - after / F.when(before == 0, None).otherwise(before))


def directory_summary(results: DataFrame) -> DataFrame:
    """Counts, and the pooled token reduction over successes with both counts."""
    both = F.col("success") & (F.col("original_tokens") > 0) & (F.col("processed_tokens") > 0)
    total = lambda c: F.coalesce(F.sum(F.when(both, F.col(c))), F.lit(0))
    out = results.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("success").cast("int")), F.lit(0)).alias("successful"), total("original_tokens").alias("original_tokens"), total("processed_tokens").alias("processed_tokens"))
    o, p = F.col("original_tokens"), F.col("processed_tokens")
    return out.select("total", "successful", (F.col("total") - F.col("successful")).alias("failed"), "original_tokens", "processed_tokens", F.when(o > 0, F.bround((o - p) / F.when(o > 0, o) * 100, 6)).alias("token_reduction_percent"))


def operation_stats(timings: DataFrame, name: str, seconds: str) -> DataFrame:
    """Count, total, mean, median, least, most and sample deviation of each operation."""
    s = F.col(seconds)
    return timings.groupBy(name).agg(F.count(s).alias("n"), F.sum(s).alias("total"), F.avg(s).alias("average"), F.median(s).alias("median"), F.min(s).alias("least"), F.max(s).alias("most"), F.stddev_samp(s).alias("stdev"))


def grouped_with_total(df: DataFrame, key: str, **sums: str) -> DataFrame:
    """Sums by key and a grand total row (null key)."""
    return df.rollup(key).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count("*").alias("files"))


def metrics_report(m: dict) -> str:
    """A Markdown report of one document's metrics."""
    out = ["## Processing Metrics", ""]
    if m.get("processing_time_seconds") is not None:
        out.append(f"- **Processing Time:** {m['processing_time_seconds']:.2f} seconds")
    for title, pre, unit in (("Text Length", "length", "characters"), ("Token Count", "tokens", "tokens")):
        o, p = m.get(f"original_{pre}"), m.get(f"processed_{pre}")
        if o is not None and p is not None:
            rate = m.get("token_reduction_percent" if pre == "tokens" else "text_length_reduction_percent", 0)
            out += ["", f"### {title}", f"- Original: {o:,} {unit}", f"- Processed: {p:,} {unit}", f"- Reduction: {rate:.2f}%"]
    return "\n".join(out)
