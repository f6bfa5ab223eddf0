"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ampliref.llm import exact_dedup, minhash, mixing, pieces, quality
from ampliref.llm.common import drop_since, materialize, table, written
from ampliref.llm.queries import tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier, learned from the labels, scores below 0.7."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.accepted(docs, model, 0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the smallest doc_id stays."""
    return exact_dedup.unique_rows(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class (five words, 0.8) the smallest doc_id stays."""
    return minhash.one_of_each(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, from not at all to three times."""
    return mixing.resampled(docs, weights=(5, 2, 1))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to."""
    return pieces.encode_decode(docs, tokenizer("piece_bpe_32k.model"), with_ids=True).select("doc_id", "n_tokens", "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can't express the classifier or the encoder; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on its way, and its input, is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    begin = written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        drop_since(spark, begin, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
