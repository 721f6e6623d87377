"""A corpus from raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's `docs`. All but the last return the columns of documents, whatever
further columns there are and however they are named. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import jaccard_join, line_dedup, packing, quality_rules, source_mix
from tallyframe.llm.common import cut, table


def _uncarry(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"__in_{c}").alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them. Repeated rows fare alike."""
    judged = quality_rules.judge(docs, carry=docs.columns)
    return _uncarry(judged.filter("kept"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go from all of them; n_chars follows the text. Every row stays,
    as do null ids; a null text comes back as an empty one."""
    kept = line_dedup.drop_lines(docs, line_dedup.line_dedup(docs))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest id, null before all others. Texts
    without words are in no group. Rows equal in id and text are one document: they stay or go together."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the mix's order: no target weights are stated here, so none is dropped. A null source
    is a source of its own."""
    mixed = source_mix.mix(docs, carry=docs.columns)
    ordered = mixed.repartitionByRange("slot", "position", "doc_id").sortWithinPartitions("slot", "position", "doc_id")
    return _uncarry(ordered, docs.columns)


def _file_order(docs: DataFrame) -> Column | None:
    """The order of rows in a table's files, as the stage before wrote them; None of a table that isn't read from files."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return None
    name = F.col("_metadata.file_name")
    part, more = (F.coalesce(F.regexp_extract(name, p, 1).try_cast("long"), F.lit(0)) for p in (r"^part-(\d+)", r"-c(\d+)\."))
    return F.shiftleft(part, 43) + F.shiftleft(more, 33) + F.col("_metadata.row_index")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece with its place in a sequence. Sequences follow the mix: the order of rows in the files that the
    mixing stage wrote, or ids where there are no files. Null and empty texts are a piece of one token."""
    return packing.pack(docs, order=_file_order(docs))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mix", mix),
    ("bestfit_packing", pack),
]

#: SQL can't express the near-duplicate and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs)
    return docs
