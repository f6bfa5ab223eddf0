"""CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampliref.operators import diagnostics
from ampliref.operators.query import Values
from ampliref.session import path_exists


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, inferred types, UTF-8."""
    if not path_exists(spark, path):
        raise FileNotFoundError("File not found: " + path)
    return spark.read.csv(path, header=True, inferSchema=True, encoding="UTF-8", quote='"', escape='"', multiLine=True, nullValue="NA")


def read_barcode_gap(spark: SparkSession, path: str, species: Values = None, marker: Values = None) -> DataFrame:
    return diagnostics.barcode_gap(read_csv(spark, path), species, marker)


def read_ambiguity(spark: SparkSession, path: str, action: Values = None) -> DataFrame:
    return diagnostics.ambiguity(read_csv(spark, path), action)
