"""From raw documents to packed training sequences: five stages, each one operator over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decontamination, language, lines, near_dup, packing
from framelake.llm._stage import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text reads like one of the languages taught by docs' own lang column; without letters, none does."""
    return language.accepted(docs, language.fit(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later occurrences of three-line windows; n_chars follows the text."""
    cut = lines.remove_repeated_lines(docs, size=3, counts=False)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the least doc_id, of each near-duplicate group at five words and 0.8; rows that share a
    doc_id are compared each by its own text. Rows without a doc_id stay."""
    row = "__framelake_row"
    docs_by_row = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    ids = docs_by_row.select("doc_id", row)
    named = docs_by_row.select(F.when(F.col("doc_id").isNotNull(), F.col(row)).alias("doc_id"), F.col("text"))
    groups = near_dup.near_duplicates(named, size=5, percent=80).filter("component_id is not null").select(F.col("doc_id").alias(row), "component_id")
    members = staged(groups.join(ids, row))
    # A component's first row leaves by its own number, not by a join on the component, which may hold a third of all rows.
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    later = members.join(first, row, "left_anti").select(row)
    return docs_by_row.join(later, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no ten-word window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences of at most 2048 tokens."""
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language models and tokenizers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
