"""Documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom import scratch
from factloom.llm import decontam, jaccard, langid, linededup, packing
from factloom.session import ship_package, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those whose text is null, has no letter, or is of no learned language by the filters' share
    go. Each row is judged by its own text, so ids may be null or repeated. An empty table, or one without labels, gives no rows."""
    ship_package(spark)
    return langid.known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without their source's boilerplate lines, and with ``n_chars`` counted again where there is that column. A null
    text stays null; ids and other columns are not looked at."""
    kept = linededup.drop_boilerplate(docs)
    kept = kept.toDF(*[str(k) for k in range(len(kept.columns))]).select(*[F.col(str(k)).alias(c) for k, c in enumerate(docs.columns)])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id (a null one is the last); of repeated rows one; rows without
    words all stay."""
    ship_package(spark)
    return jaccard.one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage worth the name, judged by their own text; a null text stays, ids may be null or repeated."""
    ship_package(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it; a null text is empty, repeated rows and null ids are rows of their own, other
    columns are dropped."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenising is not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written in the shared folder and read by the next one; what a stage leaves there is then deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch.trail() as used:
            rows = stage(spark, docs, sf_dir)
        with scratch.trail() as own:
            docs = scratch.stored(rows, f"pipeline-{name}")
        scratch.delete(spark, before + used)
        before = own
    return docs
