"""A session for tests and the command line; on a cluster, use the one that is there."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    n = 8 if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("textloom").config("spark.sql.shuffle.partitions", n).config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Most rows and bytes in one Arrow batch between the JVM and a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size: a default batch of 10,000 documents costs the JVM, and each Python worker, some hundred MB."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, most)


#: Tables of fewer bytes are spread over all cores if their files are fewer: such files often hold one row group, which one task reads.
SPREAD_BYTES = 256 << 20
#: Bytes of files for a task of steps that take seconds a MB.
EACH = 8 << 20


def spread(df, each: int = 0):
    """``df``, a table read from files, over as many partitions as there are cores if it is small and in few files; larger ones stay as they are split.

    With ``each``, tables of larger files are spread over partitions of that many bytes too, so that a task's
    work doesn't grow with the table: splits hold 128 MB, and a row group, however large, isn't split at all.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    files = len(df.inputFiles())
    few = size < SPREAD_BYTES and files < cores
    tasks = min(files, df._jdf.queryExecution().toRdd().getNumPartitions()) if each and not few else files  # small files share a split
    return df.repartition(max(2 * cores, -(-size // each) if each else 0)) if few or (each and size > 2 * each * tasks) else df
