"""FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliref.functions.sequences import clean_sequence


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(asv_id, sequence, ord): identifiers up to the first white space, cleaned sequences, and the order of records.

    Records are split where Spark splits text, so large files are read in parallel. Empty lines and lines before the
    first header are left out; a header without lines has an empty sequence; a file without a record is an error.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = text.select(F.regexp_replace("value", "\r", "").alias("v"), place.alias("place"))
    # what stands before the first header has no >; its own record starts with it
    first = F.col("v").startswith(">")
    rows = rows.withColumn("v", F.when(first, F.substring("v", 2, 2_000_000_000)).when((F.col("place.file_block_start") == 0) & (F.col("place.col3") % (1 << 33) == 0) & ~first, F.lit(None)).otherwise(F.col("v")))
    rows = rows.where("v is not null")
    out = rows.select(
        F.regexp_extract("v", r"^\s*(\S*)", 1).alias("asv_id"),
        F.when(F.instr("v", "\n") > 0, clean_sequence(F.regexp_extract("v", r"(?s)^[^\n]*\n(.*)$", 1))).otherwise("").alias("sequence"),
        F.col("place.col3").alias("ord"),
    )
    if out.isEmpty():
        raise ValueError("No FASTA records found in " + path)
    return out


def fasta_lines(df: DataFrame, header: str = "header", sequence: str = "sequence") -> DataFrame:
    """One column `value` with both lines of each record."""
    return df.select(F.concat_ws("\n", F.col(header), clean_sequence(F.coalesce(F.col(sequence), F.lit("")))).alias("value"))


def write_fasta(df: DataFrame, path: str, single_file: bool = False, header: str = "header", sequence: str = "sequence") -> str:
    """A directory of text files written in parallel; single_file: one file, streamed through the driver part by part."""
    lines = fasta_lines(df, header, sequence)
    return write_lines(lines, path, single_file)


def write_lines(lines: DataFrame, path: str, single_file: bool = False, first: str | None = None) -> str:
    if not single_file:
        lines.write.mode("overwrite").text(path)
        return path
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        if first is not None:
            f.write(first + "\n")
        for row in lines.toLocalIterator(prefetchPartitions=True):
            f.write(row["value"] + "\n")
    return path
