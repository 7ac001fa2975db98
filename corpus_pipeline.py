"""A corpus pipeline: each stage reads what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from periodlens.llm import jaccard, language, lines, mixing, packing
from periodlens.llm.tables import saved

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents whose language can't be told."""
    return language.identify(docs).where("not rejected").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages of lines that appeared before."""
    return lines.dedup_lines(docs).select(*docs.columns)


def shingle_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return jaccard.one_of_each(docs, width=5, num=80, den=100)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources reach their shares."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its ids and its place in a sequence."""
    return packing.pack(packing.tokenise(docs, TOKENIZER, rest=True))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("shingle_join", shingle_stage),
    ("source_mix", mix_stage),
    ("best_fit_packing", packing_stage),
]

# Draws and learned models have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
