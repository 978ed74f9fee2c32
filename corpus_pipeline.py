"""The corpus pipeline: STAGES, each (name, function of (spark, docs, sf_dir)), written as Parquet and reread one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import bpe, lines, mixing, minhash, quality, store
from tidepanel.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the columns stay.

    Null and empty texts get a score like others, repeated rows the same one each, an empty table stays empty. Whole texts are scored, however long.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another line stands for go, and documents that lose their last line with them.

    Null texts and documents without words stay as they are, as do rows of a null id; of equal or linked lines the first of the smallest id stays,
    within one document as well. Rows that repeat an id are versions of one document. An empty table stays empty.
    """
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Texts without words are near nothing and stay, as do rows of a null id. Rows that repeat an id stay if any of them does. An empty table stays empty.
    """
    return minhash.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times; documents without words aren't taken.

    A null source is a source like others, the last in order. Reruns take the same documents. An empty table stays empty.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document that is left, counted and digested: a row for each row. A null text counts as empty; whole texts are coded, however long."""
    return bpe.encoded(docs, tokenizer_path())


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", source_mix), ("tokens", tokens)]
#: Boosted trees, MinHash, iterative components and BPE have no SQL form; the tests hold run() against its stages, the two dedup stages in it against brute force, and the operators of the others by themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return docs
