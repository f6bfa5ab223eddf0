"""Exports of reference sequences for assignment programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliref.functions.lineage import safe_ids, taxonomy_string
from ampliref.schemas import RANKS, match_arg, require_columns
from ampliref.sources.fasta import write_fasta, write_lines

FORMATS = ("blastn", "dada2", "qiime2", "usearch")


def _order(df: DataFrame, order_col: str | None) -> list[Column]:
    return [F.col(order_col)] if order_col else [F.monotonically_increasing_id()]


def headers(df: DataFrame, format: str, order_col: str | None = None) -> DataFrame:
    """Adds safe_id, taxonomy and header; order_col orders rows whose identifiers repeat."""
    format = match_arg(format, FORMATS)
    require_columns(df, ["sequence", *RANKS])
    style = "plain" if format in ("blastn", "dada2") else "rank_prefix"
    out = safe_ids(df.withColumn("_row", *_order(df, order_col)), [F.col("_row")]).drop("_row").withColumn("taxonomy", taxonomy_string(style))
    header = {"blastn": F.concat(F.lit(">"), "safe_id", F.lit(";"), "taxonomy"), "dada2": F.concat(F.lit(">"), "safe_id", F.lit(";tax="), "taxonomy"), "qiime2": F.concat(F.lit(">"), "safe_id"), "usearch": F.concat(F.lit(">"), "safe_id", F.lit(" tax="), "taxonomy")}[format]
    return out.withColumn("header", header)


def export_fasta(df: DataFrame, path: str, format: str = "blastn", taxonomy_path: str | None = None, single_file: bool = False, order_col: str | None = None) -> dict[str, str]:
    """Writes FASTA, for qiime2 also the table of lineages, which needs a path. No rows make an empty file."""
    format = match_arg(format, FORMATS)
    if format == "qiime2" and taxonomy_path is None:
        raise ValueError("taxonomy_file is required for QIIME2 export.")
    rows = headers(df, format, order_col)
    out = {"fasta": write_fasta(rows, path, single_file)}
    if format == "qiime2":
        lines = rows.select(F.concat_ws("\t", "safe_id", "taxonomy").alias("value"))
        if single_file:
            out["taxonomy"] = write_lines(lines, taxonomy_path, True, "Feature ID\tTaxon")
        else:
            rows.select(F.col("safe_id").alias("Feature ID"), F.col("taxonomy").alias("Taxon")).write.mode("overwrite").csv(taxonomy_path, sep="\t", header=True, quote="")
            out["taxonomy"] = taxonomy_path
    return out


def export_blastn(df: DataFrame, path: str, **kw) -> dict[str, str]:
    return export_fasta(df, path, "blastn", **kw)


def export_dada2(df: DataFrame, path: str, **kw) -> dict[str, str]:
    return export_fasta(df, path, "dada2", **kw)


def export_qiime2(df: DataFrame, path: str, taxonomy_path: str | None = None, **kw) -> dict[str, str]:
    return export_fasta(df, path, "qiime2", taxonomy_path, **kw)


def export_usearch(df: DataFrame, path: str, **kw) -> dict[str, str]:
    return export_fasta(df, path, "usearch", **kw)


def write_csv(df: DataFrame, path: str) -> str:
    """A report as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
