"""Streams of sequence variants: exact assignment as they arrive, against a static reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliref.functions.sequences import clean_sequence


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(asv_id, sequence) of the FASTA files that appear in a folder, as a stream."""
    text = spark.readStream.option("lineSep", ">").text(path).where(F.trim("value") != "")
    end = F.instr("value", "\n")
    body = F.when(end > 0, F.col("value").substr(end + 1, F.length("value"))).otherwise("")
    return text.select(F.regexp_extract("value", r"^\s*(\S*)", 1).alias("asv_id"), clean_sequence(body).alias("sequence")).where("asv_id != ''")


def assign_stream(asvs: DataFrame, refs: DataFrame) -> DataFrame:
    """Joined species of each arriving ASV: the reference is reduced to one row per sequence first, so the stream needs no state."""
    known = refs.groupBy(clean_sequence(F.col("sequence")).alias("_ref")).agg(F.array_join(F.array_sort(F.collect_set("species")), "|").alias("species"), F.count_distinct("species").alias("n_best_species"))
    status = F.when(F.col("n_best_species").isNull(), "no_match").when(F.col("n_best_species") == 1, "unique").otherwise("check_full_tie")
    return asvs.join(known, clean_sequence(asvs["sequence"]) == known["_ref"], "left").select("asv_id", "species", F.coalesce("n_best_species", F.lit(0)).alias("n_best_species"), status.alias("assignment_status"))
