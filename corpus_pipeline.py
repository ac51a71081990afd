"""Corpus pipeline: five stages from raw documents to a weighted mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every result as Parquet into the shared folder and hands the written table to
the next stage.  All stages but the last return the columns of documents.

Defined cases follow the operators: null and empty texts are rejected by the
first stage, rows with equal id and text count as one document where an
operator compares documents, extra columns pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import budget_mix, decontaminate, kn_quality, line_runs, queries, simhash_trie
from quire.llm.store import table
from quire.session import ensure_checkpoint_dir, ship_package
from quire.sources.tables import read_table


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney quality classifier keeps."""
    _ready(spark)
    return kn_quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs of 50 words or more; n_chars follows."""
    _ready(spark)
    out = line_runs.drop_repeats(docs, min_words=50)
    if "n_chars" in docs.columns:
        n = F.when(F.col("__deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    _ready(spark)
    return simhash_trie.keep_first(docs, shingle=3, max_bits=3)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    _ready(spark)
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the weighted mix, one row per copy."""
    _ready(spark)
    return budget_mix.mix(docs, queries.mix_levels(), queries.mix_weights(spark), budget_share=queries.MIX_SHARE,
                          max_epochs=queries.MIX_EPOCHS, seed=queries.MIX_SEED)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near),
          ("benchmark decontamination", benchmark), ("mixing sources to target weights", mixed)]

ORACLE_SQL = None  # perplexity, SimHash and alignment have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    _ready(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
