"""Coverage and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliref.operators.query import Values, one_of


def _passed(final: DataFrame) -> DataFrame:
    return final.where(F.col("qc_flag") == "pass")


def marker_coverage(final: DataFrame, rank: str = "species") -> DataFrame:
    """Per taxon and marker: sequences and distinct sources."""
    if rank not in ("species", "genus", "family", "order"):
        raise ValueError("Unsupported rank: " + rank)
    return _passed(final).groupBy(F.col(f"`{rank}`").alias("taxon"), "seq_type").agg(F.count(F.lit(1)).alias("n_sequences"), F.count_distinct("source").alias("n_sources")).orderBy("taxon", "seq_type")


def source_coverage(final: DataFrame) -> DataFrame:
    """Per source and marker: sequences and distinct species."""
    return _passed(final).groupBy("source", "seq_type").agg(F.count(F.lit(1)).alias("n_sequences"), F.count_distinct("species").alias("n_species")).orderBy("source", "seq_type")


def qc_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("qc_flag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "qc_flag")


def barcode_gap(metrics: DataFrame, species: Values = None, marker: Values = None) -> DataFrame:
    for column, values in (("species", species), ("marker", marker)):
        if (c := one_of(column, values)) is not None:
            metrics = metrics.where(c)
    return metrics


def ambiguity(records: DataFrame, action: Values = None) -> DataFrame:
    c = one_of("action", action)
    return records if c is None else records.where(c)


def database_summary(final: DataFrame) -> DataFrame:
    """One row: sequences, species entries, composite and single ones, genera, families, markers, sources."""
    composite = F.col("species").contains("|")
    return final.agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.count_distinct("species").alias("n_species"),
        F.count_distinct(F.when(composite, F.col("species"))).alias("n_composite"),
        F.count_distinct(F.when(~composite, F.col("species"))).alias("n_single"),
        F.count_distinct("genus").alias("n_genera"),
        F.count_distinct("family").alias("n_families"),
        F.count_distinct("seq_type").alias("n_markers"),
        F.count_distinct("source").alias("n_sources"),
    )


def marker_summary(final: DataFrame) -> DataFrame:
    """Sequences per marker, most first."""
    return final.groupBy("seq_type").agg(F.count(F.lit(1)).alias("n_sequences")).orderBy(F.col("n_sequences").desc(), "seq_type")


def gap_crosstab(metrics: DataFrame) -> DataFrame:
    """Species with and without a barcode gap, per marker."""
    return metrics.groupBy("marker").agg(F.count_if(F.col("gap_exists")).alias("gap"), F.count_if(~F.col("gap_exists")).alias("no_gap"))


def source_proportion(final: DataFrame) -> DataFrame:
    """Per source, the share that each quality flag has of its sequences."""
    counted = final.groupBy("source", "qc_flag").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
