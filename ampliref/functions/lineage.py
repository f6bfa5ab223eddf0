"""Lineages and identifiers as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliref.schemas import PREFIXES, RANKS, match_arg, require_columns


def taxonomy_string(style: str = "plain", ranks: list[str] | None = None) -> Column:
    """The seven ranks joined by ;, missing ones unassigned; rank_prefix puts k__ to s__ before them."""
    style = match_arg(style, ("plain", "rank_prefix"))
    parts = []
    for prefix, rank in zip(PREFIXES, ranks or RANKS):
        value = F.col(f"`{rank}`")
        value = F.when(value.isNull() | (value == ""), "unassigned").otherwise(value)
        parts.append(F.concat(F.lit(f"{prefix}__"), value) if style == "rank_prefix" else value)
    return F.concat_ws(";", *parts)


def build_taxonomy_string(df: DataFrame, style: str = "plain", name: str = "taxonomy") -> DataFrame:
    require_columns(df, RANKS)
    return df.withColumn(name, taxonomy_string(style))


def _syntactic(c: Column) -> Column:
    """A valid name: other characters become dots, a leading digit, underscore or dotted digit gets an X; missing -> NA."""
    c = F.coalesce(c, F.lit("NA."))
    dotted = F.regexp_replace(c, r"[^\p{L}\p{N}._]", ".")
    return F.when(c == "", "X").when(c.rlike(r"^(?:[^\p{L}.]|\.[0-9])"), F.concat(F.lit("X"), dotted)).otherwise(dotted)


def safe_ids(df: DataFrame, order: list[Column], name: str = "safe_id") -> DataFrame:
    """Adds unique identifiers made from unique_code, else sequence_id, else seq_<row>; repeats get .1, .2, in row order.

    A suffix that would repeat another row's own name is passed over.
    """
    source = next((c for c in ("unique_code", "sequence_id") if c in df.columns), None)
    if source is None:
        from ampliref.operators.numbering import numbered

        return numbered(df, order, "_number").withColumn(name, F.concat(F.lit("seq_"), F.col("_number").cast("string"))).drop("_number")
    named = df.withColumn("_name", _syntactic(F.col(source)))
    named = named.withColumn("_nth", F.row_number().over(Window.partitionBy("_name").orderBy(*order)) - 1)
    # suffixes that names of other rows already have, of stems that repeat: the k-th repeat takes the k-th free number, which
    # is k plus how many taken numbers come before it. With t the j-th taken number, t - j numbers below it are free.
    repeated = named.where("_nth = 1").select(F.col("_name").alias("_stem"))
    pattern = r"^(.*)\.([1-9][0-9]{0,8})$"
    taken = named.where("_nth = 0").select(F.regexp_extract("_name", pattern, 1).alias("_stem"), F.regexp_extract("_name", pattern, 2).alias("_n")).where("_stem != ''")
    taken = taken.join(repeated, "_stem", "left_semi").select("_stem", F.col("_n").cast("long").alias("_n"))
    by_stem = Window.partitionBy("_stem").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = taken.withColumn("_j", F.row_number().over(Window.partitionBy("_stem").orderBy("_n"))).select("_stem", (F.col("_n") - F.col("_j")).alias("_key"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_k"))
    asked = named.where("_nth > 0").select(F.col("_name").alias("_stem"), (F.col("_nth").cast("long") - 1).alias("_key"), F.lit(1).alias("_kind"), F.col("_nth").cast("long").alias("_k"))
    # taken numbers with at most k - 1 free ones below them stand before the k-th free number
    met = free.unionByName(asked).withColumn("_skip", F.sum(F.when(F.col("_kind") == 0, 1).otherwise(0)).over(by_stem))
    shifts = met.where("_kind = 1 and _skip > 0").select(F.col("_stem").alias("_s"), F.col("_k"), "_skip")
    joined = named.join(shifts, (F.col("_name") == F.col("_s")) & (F.col("_nth") == F.col("_k")), "left")
    out = F.when(F.col("_nth") == 0, F.col("_name")).otherwise(F.concat_ws(".", "_name", (F.col("_nth") + F.coalesce("_skip", F.lit(0))).cast("string")))
    return joined.withColumn(name, out).drop("_name", "_nth", "_s", "_k", "_skip")
