"""Queries over the final reference table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliref.functions.sequences import clean_sequence
from ampliref.schemas import RANKS, require_columns

Values = str | Sequence[str] | None


def _list(values: Values) -> list[str] | None:
    if values is None:
        return None
    return [values] if isinstance(values, str) else list(values)


def one_of(column: str, values: Values) -> Column | None:
    """column IN values; a null row never matches; None for no condition."""
    wanted = _list(values)
    if wanted is None:
        return None
    return F.coalesce(F.col(f"`{column}`").isin(*[v for v in wanted if v is not None]), F.lit(False))


def qc_condition(qc_flag: Values, exact: bool = False, sql_like: bool = False, column: str = "qc_flag") -> Column | None:
    """Any of the flags: exact ones, "pass" as such, others as a part of the flag string. Nothing asked, no condition.

    sql_like: parts match as in SQL LIKE, ignoring case and with _ and % as wildcards.
    """
    flags = [f for f in _list(qc_flag) or [] if f is not None]
    if not flags:
        return None
    c = F.col(column)
    part = (lambda f: c.ilike(f"%{f}%")) if sql_like else c.contains
    return F.coalesce(reduce(Column.__or__, [c == f if exact or f == "pass" else part(f) for f in flags]), F.lit(False))


def conditions(species: Values = None, genus: Values = None, family: Values = None, marker: Values = None, source: Values = None, occurrence: Values = None, qc_flag: Values = None, exact: bool = False, sql_like: bool = False) -> Column:
    """All conditions that are asked for, as one predicate that scans can take in."""
    asked = [one_of(c, v) for c, v in (("species", species), ("genus", genus), ("family", family), ("seq_type", marker), ("source", source), ("occurrence", occurrence))]
    asked.append(qc_condition(qc_flag, exact, sql_like))
    return reduce(Column.__and__, [a for a in asked if a is not None], F.lit(True))


def get_sequences(final: DataFrame, species: Values = None, genus: Values = None, family: Values = None, marker: Values = None, source: Values = None, occurrence: Values = None, qc_flag: Values = "pass", exact: bool = False, sql_like: bool = False) -> DataFrame:
    return final.where(conditions(species, genus, family, marker, source, occurrence, qc_flag, exact, sql_like))


def filter_reference(df: DataFrame, marker: Values = None, source: Values = None, occurrence: Values = None, min_length: int | None = None, max_length: int | None = None, qc_flag: Values = "pass", exact: bool = False) -> DataFrame:
    """get_sequences() with inclusive bounds on the cleaned sequence's length."""
    out = df.where(conditions(marker=marker, source=source, occurrence=occurrence, qc_flag=qc_flag, exact=exact))
    size = F.length(clean_sequence(F.col("sequence")))
    if min_length is not None:
        out = out.where(size >= min_length)
    if max_length is not None:
        out = out.where(size <= max_length)
    return out


def list_taxa(final: DataFrame, rank: str = "species", occurrence: Values = None, marker: Values = None, qc_flag: Values = "pass", exact: bool = False) -> DataFrame:
    """(taxon, n_sequences) in order of the taxon."""
    if rank not in RANKS:
        raise ValueError("Unsupported rank: " + rank)
    kept = final.where(conditions(marker=marker, occurrence=occurrence, qc_flag=qc_flag, exact=exact))
    return kept.groupBy(F.col(f"`{rank}`").alias("taxon")).agg(F.count(F.lit(1)).alias("n_sequences")).orderBy("taxon")


def taxonomy(final: DataFrame, species: Values = None, qc_flag: Values = "pass", exact: bool = False) -> DataFrame:
    """The distinct lineages with occurrence and habitat."""
    require_columns(final, RANKS)
    return final.where(conditions(species=species, qc_flag=qc_flag, exact=exact)).select(*[F.col(f"`{r}`") for r in RANKS], "occurrence", "habitat").distinct()
