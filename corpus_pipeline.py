"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; ``run`` writes each one's rows as Parquet and reads them again
as the next one's docs. All stages but the last return the columns of documents,
whatever other columns there are and whatever their names.

Defined results: null texts and null ids pass the first four stages (each stage's own
docstring says what it does with them) and null or empty texts are packed nowhere; very
long texts are judged, compared, searched and rewritten whole, and packed in pieces;
rows that repeat a doc_id become one row in the second stage; empty tables give no
sequences; without labels no document is rejected, without a benchmark nothing is cut.

By the time a stage runs, its predecessors' results are written, so their scratch
folders are removed then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, near_duplicates, packing, resample, surrogates
from textloom.llm.shared import Scratch

_open: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    while _open:
        old = _open.pop()
        if old.spark is spark:
            old.drop()
    _open.append(Scratch(spark, name))
    return _open[-1]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in the importance resample. Null and empty texts weigh 0; equal rows stay or go together; without good labels all stay."""
    return resample.select(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _scratch(spark, "stage1"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least id of each group of near copies. Null ids and null or wordless texts are no copies; of rows that repeat an id the one of the least text stays."""
    return near_duplicates.deduplicate(spark, docs, scratch=_scratch(spark, "stage2"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out. Null and empty texts stay; a document left without a word goes; repeated rows are cut alike."""
    return decontaminate.remove(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch=_scratch(spark, "stage3"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates. All rows stay; null texts and texts without entities are as they were; equal texts stay equal."""
    return surrogates.pseudonymise(spark, docs, scratch=_scratch(spark, "stage4"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences: (bin_id, slot, doc_id, piece, first_token, n_tokens). Null and empty texts have no row; ties go by id and piece."""
    return packing.pack(spark, docs, scratch=_scratch(spark, "stage5"))


STAGES = [("quality classifier", quality), ("near-duplicates", near_copies), ("benchmark decontamination", benchmarks), ("personal data", personal_data), ("best-fit packing", sequences)]

#: A n-gram ratio, signatures, an FM-index and a greedy packing: no stage is one SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = out.table(stage(spark, docs, sf_dir), f"stage{i + 1}")
        if i > 1:
            out.drop(f"{i - 1:02d}-stage{i - 1}")
    return docs
