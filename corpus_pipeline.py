"""The corpus pipeline: documents through five operators, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floorspark.llm import decontam, lines, minhash, mixing, toxicity
from floorspark.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS
from floorspark.session import stored, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples do not make toxic."""
    return toxicity.without_toxic(docs, tune(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; none left empty by it."""
    tune(spark)
    return lines.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    tune(spark)
    return minhash.without_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of their sources, and their epochs."""
    tune(spark)
    return mixing.mixed(docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
]

#: Neither nearest neighbours nor components have a form that SQL can run here;
#: the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left; each stage is written and read again."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
