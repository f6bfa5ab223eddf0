"""Species names and lineages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup table of up to this many names is broadcast; a larger one is joined by a shuffle.
BROADCAST_NAMES = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else df


def standardize_species(names: DataFrame, reference: DataFrame, column: str = "species", name_col: str = "alternative_clean", valid_col: str = "valid_name", order_col: str | None = None, lookup: Callable[[Column], Column] | None = None, out: str = "valid_species") -> DataFrame:
    """Adds the valid name: the first that the reference has for the lower-cased name, else what lookup says, else null.

    lookup takes and returns a Column (a pandas UDF, say); it is asked once for each distinct name that is missing.
    """
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    known = reference.where(F.col(valid_col).isNotNull()).groupBy(F.col(name_col).alias("_name")).agg(F.min_by(valid_col, order).alias("_valid"))
    found = names.join(_small(known), F.lower(F.col(column)) == F.col("_name"), "left").drop("_name")
    if lookup is not None:
        missing = found.where(F.col("_valid").isNull() & F.col(column).isNotNull()).select(F.col(column).alias("_missing")).distinct()
        asked = missing.select("_missing", lookup(F.col("_missing")).alias("_asked"))
        found = found.join(asked, F.col(column) == F.col("_missing"), "left").withColumn("_valid", F.coalesce("_valid", "_asked")).drop("_missing", "_asked")
    return found.withColumn(out, F.col("_valid")).drop("_valid")


def join_taxonomy(df: DataFrame, table: DataFrame, by: str = "species", defaults: dict[str, str] | None = None, unassigned: str = "unassigned") -> DataFrame:
    """Left join of a lineage; a clashing column of the table gets the suffix .tax and the base column wins.

    genus, family and order are made where they are missing, and filled with `unassigned`; defaults overwrite their
    columns in every row. A name that the table has more than once fans out; null names meet null names.
    """
    clash = [c for c in table.columns if c != by and c in df.columns]
    renamed = table.select(*[F.col(f"`{c}`").alias("_by" if c == by else f"{c}.tax" if c in clash else c) for c in table.columns])
    out = df.join(_small(renamed), df[by].eqNullSafe(renamed["_by"]), "left").drop("_by")
    for rank in ("genus", "family", "order"):
        value = F.col(f"`{rank}`") if rank in out.columns else F.lit(None).cast("string")
        out = out.withColumn(rank, F.coalesce(value, F.lit(unassigned)))
    for column, value in (defaults or {}).items():
        out = out.withColumn(column, F.lit(value))
    return out
