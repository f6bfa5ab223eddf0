"""Parsing sources, uniting them, and settling ambiguous sequences."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliref.functions.markers import extract_markers
from ampliref.functions.sequences import clean_sequence
from ampliref.schemas import match_arg


def standardize_columns(raw: DataFrame, column_map: dict[str, str]) -> DataFrame:
    """column_map: new name -> old name. Other columns stay; a new name that another column has replaces it."""
    missing = [old for old in column_map.values() if old not in raw.columns]
    if missing:
        raise ValueError("Missing required columns: " + ", ".join(missing))
    rest = [c for c in raw.columns if c not in column_map.values() and c not in column_map]
    return raw.select(*[F.col(f"`{old}`").alias(new) for new, old in column_map.items()], *[F.col(f"`{c}`") for c in rest])


def parse_source(raw: DataFrame, source: str, column_map: dict[str, str], marker_fn: Callable[[Column], Column] = extract_markers, description_col: str | None = None) -> DataFrame:
    """Standard columns with source, cleaned sequence, its length, and seq_type from the description where there is one.

    marker_fn takes and returns a Column; a scalar pandas UDF is one too.
    """
    described = description_col is not None and description_col in raw.columns
    if described:
        raw = raw.withColumn("_seq_type", marker_fn(F.col(f"`{description_col}`")))
    out = standardize_columns(raw, column_map).withColumn("source", F.lit(source)).withColumn("sequence", clean_sequence(F.col("sequence")))
    out = out.withColumn("length", F.length("sequence"))
    if described:
        return out.withColumn("seq_type", F.col("_seq_type")).drop("_seq_type")
    return out if "seq_type" in out.columns else out.withColumn("seq_type", F.lit("other_unknown"))


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the first in order. A minimum of rows, so partial results are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_row"))
    return first.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def combine_sources(sources: Sequence[DataFrame], species_col: str = "species", sequence_col: str = "sequence", order_col: str | None = None) -> DataFrame:
    """Union by name, missing columns null, cleaned; of rows with equal species and sequence the first source's first row stays.

    order_col: a column that orders the rows of a source; without it rows count in the order in which they are read.
    """
    parts = []
    for i, s in enumerate(sources):
        ord_ = F.col(order_col).cast("long") if order_col else F.monotonically_increasing_id()
        parts.append(s.withColumn(sequence_col, clean_sequence(F.col(sequence_col))).withColumn("_src", F.lit(i)).withColumn("_ord", ord_))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return _first(out, [species_col, sequence_col], ["_src", "_ord"]).drop("_src", "_ord")


def ambiguous_sequences(df: DataFrame, species_col: str = "species", sequence_col: str = "sequence") -> DataFrame:
    """Rows whose sequence several species have; a missing species counts as one."""
    names = F.min(species_col), F.max(species_col), F.max(F.col(species_col).isNull())
    several = df.groupBy(sequence_col).agg(names[0].alias("_lo"), names[1].alias("_hi"), names[2].alias("_null"))
    several = several.where((F.col("_lo") != F.col("_hi")) | (F.col("_null") & F.col("_lo").isNotNull())).select(F.col(sequence_col).alias("_key"))
    return df.join(several, df[sequence_col].eqNullSafe(several["_key"]), "left_semi")


def _without(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    keys = other.select(F.col(column).alias("_key")).distinct()
    return df.join(keys, df[column].eqNullSafe(keys["_key"]), "left_anti")


def resolve_ambiguous(df: DataFrame, species_col: str = "species", sequence_col: str = "sequence", resolution: DataFrame | None = None, on_unresolved: str = "stop", flag_output_path: str | None = None, order_col: str | None = None) -> DataFrame:
    """Settles sequences that several species share.

    Without a resolution table: an error, a warning, or ("drop") those sequences leave; flag_output_path gets them as
    CSV. With one: its sequences leave, rows with action "keep" come back as they stand there, rows with "combine" as
    one per sequence with the distinct values of each column joined by |, in order of order_col; of rows with equal
    species and sequence the first stays.
    """
    on_unresolved = match_arg(on_unresolved, ("stop", "warn", "drop"))
    ambiguous = ambiguous_sequences(df, species_col, sequence_col)
    if resolution is None:
        if on_unresolved == "drop" and flag_output_path is None:
            return _without(df, ambiguous, sequence_col)
        n = ambiguous.count()
        if n == 0:
            return df
        if flag_output_path is not None:
            ambiguous.write.mode("overwrite").option("header", True).csv(flag_output_path)
        message = f"{n} ambiguous sequences found (assigned to multiple species) with no resolution table supplied."
        if on_unresolved == "stop":
            raise ValueError(message)
        warnings.warn(message if on_unresolved == "warn" else message + " Dropping them.", stacklevel=2)
        return df if on_unresolved == "warn" else _without(df, ambiguous, sequence_col)
    if ambiguous.isEmpty():
        return df
    ord_ = F.col(order_col).cast("long") if order_col else F.monotonically_increasing_id()
    table = resolution.withColumn("_ord", ord_)
    keep = table.where(F.col("action") == "keep").drop("action").withColumn("_part", F.lit(1))
    rest = [c for c in resolution.columns if c not in ("action", sequence_col)]
    listed = F.array_sort(F.collect_list(F.struct("_ord", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")).alias(c) for c in rest])))
    joined = [F.array_join(F.array_distinct(F.col(f"_rows.`{c}`")), "|").alias(c) for c in rest]
    combined = table.where(F.col("action") == "combine").groupBy(sequence_col).agg(listed.alias("_rows")).select(sequence_col, *joined, F.col("_rows")[0]["_ord"].alias("_ord"), F.lit(2).alias("_part"))
    own = df.withColumn("_ord", F.col(order_col).cast("long") if order_col and order_col in df.columns else F.monotonically_increasing_id()).withColumn("_part", F.lit(0))
    out = _without(own, resolution, sequence_col)
    # combined values are strings, as joined values are
    texts = [c for c in out.columns if c in combined.columns and c not in ("_ord", "_part")]
    out = out.unionByName(keep, allowMissingColumns=True)
    for c in texts:
        out = out.withColumn(c, F.col(f"`{c}`").cast("string"))
    out = out.unionByName(combined, allowMissingColumns=True)
    return _first(out, [species_col, sequence_col], ["_part", "_ord"]).drop("_part", "_ord")
