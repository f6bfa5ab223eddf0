"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Blocks of BLOCK words go to sources by highest quotients, then within each source to its shards the same way, which
gives each shard an integer quota. A shard is a seeded share of a source's documents, laid end to end in a seeded order
and cut into blocks; a seeded bijection of the block numbers picks exactly the quota. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliref.llm.common import WORD, materialize

#: Words in a block. A source's taken words miss its target by about a block per shard at most.
BLOCK = 32
#: No document is taken more often than this.
MOST = 3
#: Sources up to this many are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
_PRIME = 2_147_483_647  # above any number of blocks in a shard, so it is coprime to it


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def apportion(parties: DataFrame, by: list[str], key: list[Column], weight: str, seats: str) -> DataFrame:
    """Adds `quota`: the group's `seats` shared out by the highest quotients weight / (2 k + 1); ties go by `key`.

    by: the columns of a group. Rounding weight * seats / total gives all but a few seats; the rest go to the best
    quotients that are left, or come back from the worst ones given. As shares of what is left follow the weights, a
    party can get ceil(1.5 * parties * weight / total) + 1 of them at most, so that many quotients each are enough and
    there are about as many rows as parties.
    """
    group = Window.partitionBy(*by)
    total = F.sum(weight).over(group)
    share = F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0))
    base = (
        parties.withColumn("_share", share)
        .withColumn("_base", F.floor(F.col("_share") * F.col(seats) + 0.5).cast("long"))
        .withColumn("_missing", F.col(seats) - F.sum("_base").over(group))
        .withColumn("_reach", (F.ceil(F.col("_share") * F.count(F.lit(1)).over(group) * 1.5) + 1).cast("int"))
    )
    more, step = F.col("_missing") > 0, F.explode_outer(F.when(F.col("_missing") != 0, F.sequence(F.lit(0), F.col("_reach")))).alias("_k")
    # the seat in question has number _base + k, counted from 0, or when seats come back _base - 1 - k
    tried = base.select("*", step).withColumn("_seat", F.when(more, F.col("_base") + F.col("_k")).otherwise(F.col("_base") - 1 - F.col("_k")))
    tried = tried.withColumn("_quotient", F.when(F.col("_seat") >= 0, F.col(weight) / (2 * F.col("_seat") + 1)))
    order = Window.partitionBy(*by).orderBy(F.when(more, -F.col("_quotient")).otherwise(F.col("_quotient")).asc_nulls_last(), *key, F.col("_k"))
    tried = tried.withColumn("_place", F.row_number().over(order))
    moved = F.sum(F.when(F.col("_quotient").isNotNull() & (F.col("_place") <= F.abs("_missing")), F.signum("_missing")).otherwise(0)).cast("long")
    return tried.groupBy(*parties.columns, "_base").agg(moved.alias("_moved")).withColumn("quota", F.col("_base") + F.col("_moved")).drop("_base", "_moved")


def targets(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds `target` to (source, source_size): all sizes shared by weight, no source above MOST times its size.

    The excess is shared again until none is above: with sources sorted by size over weight, a prefix is full and the
    others share what remains by weight. One row a source, so one task can hold them.
    """
    one = F.lit(0).alias("_all")
    every = Window.partitionBy("_all")
    ranked = sources.select("*", one).withColumn("_n", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
    full = (MOST * F.col("source_size")).cast("double")
    by_ratio = every.orderBy((full / F.col("_w")).asc(), F.col("_n"))
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    level = ranked.withColumn("_level", level).withColumn("_fits", F.col("_level") <= full / F.col("_w"))
    share = F.min_by(F.when(F.col("_fits"), F.col("_level")), F.when(F.col("_fits"), full / F.col("_w"))).over(every)
    return level.withColumn("target", F.least(full, F.coalesce(share * F.col("_w"), full))).drop("_all", "_n", "_w", "_level", "_fits")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    size is the number of words (0 for a null or empty text); target is its source's share of all words; taken is the
    number of the document's words in the mix, repeats counted, and at most MOST times its size. weights repeat over the
    sources in code point order, null last. The same input gives the same mix; rows that repeat an identifier are laid
    out side by side as separate documents. Other columns are ignored; an empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"))
    sized = materialize(sized, "mix-sizes")
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    aimed = targets(total, weights).withColumn("_seats", F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / BLOCK).cast("long"))
    # shards of a source: about the square root of its documents, so neither they nor what each holds grow fast
    aimed = apportion(aimed.withColumn("_one", F.lit(0)), ["_one"], [F.col("source").asc_nulls_last()], "target", "_seats").drop("_one", "_seats")
    aimed = materialize(aimed.withColumn("_shards", F.ceil(F.sqrt("_docs") / 4).cast("int")), "mix-sources")
    few = aimed.count() <= BROADCAST_SOURCES
    small = aimed.select(F.col("source").alias("_source"), "source_size", "target", F.col("quota").alias("_seats"), "_shards")
    joined = sized.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    placed = joined.withColumn("_spot", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("_shards")))
    cells = placed.groupBy("source", "_shard", "_seats").agg(F.sum("size").alias("_words")).withColumn("_words", F.col("_words").cast("double"))
    cells = apportion(cells, ["source"], [F.col("_shard")], "_words", "_seats").withColumnRenamed("_shard", "_cell").drop("_seats")
    cells = materialize(cells.withColumn("_blocks", F.ceil(F.col("_words") / BLOCK).cast("long")).drop("_words").withColumnRenamed("source", "_source"), "mix-cells")
    line = Window.partitionBy("source", "_shard").orderBy("_spot", "doc_id", "size")
    laid = placed.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_cell")), "left")
    start = F.col("_end") - F.col("size")
    # block j is picked in the last, partial turn when its seeded number is below what the whole turns leave
    turn = f"pmod(pmod(_source_seed + j, _blocks) * {_PRIME}, _blocks) < _rest"
    width = f"(least(_end, (j + 1) * {BLOCK}) - greatest(_end - size, j * {BLOCK}))"
    picked = F.expr(f"aggregate(sequence(cast((_end - size) div {BLOCK} as bigint), cast((_end - 1) div {BLOCK} as bigint)), 0L, (t, j) -> t + if({turn}, {width}, 0L))")
    quota = F.least(F.col("quota"), MOST * F.col("_blocks"))
    laid = laid.withColumn("_source_seed", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "_shard"), F.lit(1 << 30)))
    laid = laid.withColumn("_turns", F.floor(quota / F.col("_blocks")).cast("long")).withColumn("_rest", quota - F.floor(quota / F.col("_blocks")).cast("long") * F.col("_blocks"))
    taken = F.when((F.col("size") > 0) & (start >= 0), F.col("_turns") * F.col("size") + picked).otherwise(F.lit(0))
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def resampled(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 7) -> DataFrame:
    """The rows of docs as often as the mix takes them: taken / size times, a fraction rounded by a seeded draw.

    Rows with words that the mix takes stay, whole; columns are those of docs. A document without words isn't taken. Rows
    are told apart by identifier, text and source, so a null identifier or one that several texts share is no matter; of
    rows that agree in all three each gets the floor of their mean number of copies.
    """
    key = F.xxhash64(F.lit("row"), F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"), F.col("source"))
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("_row"), "text", "source")
    mixed = mix(marked, weights, seed, id_col="_row").where("taken > 0")
    times = F.col("taken") / F.col("size")
    draw = F.pmod(F.xxhash64(F.lit(seed + 3), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    times = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.sum(F.floor(times + draw)).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    times = times.select("_id", F.floor(F.col("_sum") / F.col("_rows")).cast("int").alias("_times")).where("_times > 0")
    kept = marked.select("row", "_row").join(times, F.col("_row") == F.col("_id"))
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("row.*")
