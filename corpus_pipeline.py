"""A training corpus from raw documents: each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseforge.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from caseforge.llm.store import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null, empty or blank text fails the base rules and goes. Rows are judged by their own text, whatever their ids.
    """
    return quality_rules.passed(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go from all of them; ``n_chars`` follows the text.

    Every row stays, with an empty text if all its lines are common. A null text stays null. Rows that repeat an id count as documents of their own.
    """
    out = line_dedup.dropped(docs)
    return out.selectExpr(*("cast(char_length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in out.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least id (null last).

    Texts without words are one class. Rows of one class go but one, also where ids repeat or are null; other rows stay, whatever their ids.
    """
    return near_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; rows are judged by their own text, whatever their ids. Null texts hold nothing and stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, none more than twice as often.

    A text without words is never taken. A null source is a source. Each row is taken for itself; rows alike in all columns share their copies.
    """
    return mixing.mixed(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicate dedup", near_duplicates), ("benchmark decontamination", benchmark), ("source mixing", mixture)]

#: Expectation-maximisation, weighted sampling and random rounding can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
