"""Tabular hits of alignment programs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ampliref.operators.assign import blast_metrics
from ampliref.schemas import BLAST


def read_blast_tabular(spark: SparkSession, path: str) -> DataFrame:
    """The 14 columns without a header or quoting, with coverages derived; a missing or empty local file has no rows."""
    local = Path(path.removeprefix("file://"))
    if "://" not in path.removeprefix("file://") and (not local.exists() or (local.is_file() and local.stat().st_size == 0)):
        return blast_metrics(spark.createDataFrame([], BLAST))
    return blast_metrics(spark.read.csv(path, sep="\t", schema=BLAST, quote="", comment=""))
