"""Exact deduplication by a content sort.

Sampled splitters range-partition (beginning of the normalised text, its hash, doc_id), so a large group of equal texts is itself split over
several partitions; an external sort puts equals next to each other; each task compares neighbours in full as it
streams. A run that touches the edge of its partition may go on in the next one, so edge runs - two a partition at
most - are summed up by digest and broadcast; every other run is already whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ampliref.llm.common import lower_ascii, materialize

#: Characters of a text's beginning by which it is placed; hashes place texts that begin alike, whole texts decide what is equal.
HEAD = 32
_RUNS = "doc_id long, text_sha256 string, local_keep long, local_size long, edge boolean, top boolean, part int"


def exact_duplicates(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. keep: "min" or "max", which identifier stays.
    Null text counts as empty. A null identifier sorts below all others. Of rows that repeat an identifier and text,
    exactly one is kept; group_size counts them all. Other columns of docs are ignored. Empty input: no rows.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    # the row that stays comes first within its run; nulls are the lowest identifiers
    order = F.col("doc_id").asc_nulls_first() if keep == "min" else F.col("doc_id").desc_nulls_last()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # splitters are drawn from short keys: texts in the order of their beginning, then of a hash, so the driver holds none whole
    keyed = norm.withColumns({"head": F.substring("text", 1, HEAD), "mark": F.xxhash64("text")})
    ranged = keyed.repartitionByRange(parts, "head", "mark", order).sortWithinPartitions("head", "mark", "text", order).select("doc_id", "text")
    runs = materialize(ranged.mapInArrow(_neighbours, _RUNS), "exact-runs")
    edges = runs.where("edge").select("text_sha256", "part", "local_keep", "local_size").distinct()
    best = F.min if keep == "min" else F.max
    lowest = F.max(F.col("local_keep").isNull())  # null is the smallest identifier
    keep_id = F.when(lowest, F.lit(None)).otherwise(best("local_keep")) if keep == "min" else best("local_keep")
    whole = edges.groupBy("text_sha256").agg(keep_id.alias("keep_id"), F.sum("local_size").alias("total"))
    # of several edge rows with the same kept identifier (repeated rows), the one in the lowest partition stays
    first = edges.groupBy("text_sha256", F.col("local_keep").alias("keep_id")).agg(F.min("part").alias("first_part"))
    summary = whole.join(first.withColumnRenamed("text_sha256", "sha2_"), (F.col("text_sha256") == F.col("sha2_")) & whole["keep_id"].eqNullSafe(first["keep_id"])).select(
        "text_sha256", whole["keep_id"].alias("all_keep"), "total", "first_part"
    )
    # two edge runs a partition at most: the bound of this broadcast is the number of partitions
    joined = runs.join(F.broadcast(summary), "text_sha256", "left")
    edge = F.col("edge")
    return joined.select(
        "doc_id",
        F.when(edge, F.col("all_keep")).otherwise(F.col("local_keep")).alias("keep_id"),
        F.when(edge, F.col("total")).otherwise(F.col("local_size")).alias("group_size"),
        F.when(edge, F.col("top") & F.col("doc_id").eqNullSafe(F.col("all_keep")) & (F.col("part") == F.col("first_part"))).otherwise(F.col("top")).alias("kept"),
        "text_sha256",
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each text with the one before it. Holds one text and the identifiers of one run."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    before: bytes | None = None
    ids: list = []
    pending: list = []  # the whole runs of this batch
    first = True

    def close(last: bool) -> None:
        nonlocal first
        if ids:
            pending.append((list(ids), hashlib.sha256(before).hexdigest(), first or last))
            first = False

    def flush() -> Iterator[pa.RecordBatch]:
        if pending:
            n = [len(x[0]) for x in pending]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for x in pending for i in x[0]], pa.int64()),
                    pa.array([x[1] for x, k in zip(pending, n) for _ in range(k)], pa.string()),
                    pa.array([x[0][0] for x, k in zip(pending, n) for _ in range(k)], pa.int64()),
                    pa.array([k for k in n for _ in range(k)], pa.int64()),
                    pa.array([x[2] for x, k in zip(pending, n) for _ in range(k)], pa.bool_()),
                    pa.array([i == 0 for k in n for i in range(k)], pa.bool_()),
                    pa.array([part] * sum(n), pa.int32()),
                ],
                names=["doc_id", "text_sha256", "local_keep", "local_size", "edge", "top", "part"],
            )
            pending.clear()

    for batch in batches:
        texts = batch.column(1).cast(pa.binary()) if not pa.types.is_large_string(batch.schema.field(1).type) else batch.column(1).cast(pa.large_binary())
        for doc_id, text in zip(batch.column(0).to_pylist(), texts):
            text = text.as_py()
            if text != before:
                close(False)
                ids.clear()
                before = text
            ids.append(doc_id)
        yield from flush()
    close(True)
    yield from flush()


def unique_rows(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of docs, all columns, that exact_duplicates() keeps: one of each group of equal texts.

    Whole rows go through the one range shuffle, and each task passes on the first row of each run, so a text crosses the
    network once. Runs at the edges of partitions, two a partition at most, are decided by digest. Null text counts as
    empty, a null identifier is the lowest; of rows that repeat identifier and text any one stays. Empty input: no rows.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text, doc_id = lower_ascii(F.coalesce(F.col("row.text"), F.lit(""))), F.col("row.doc_id").cast("long")
    order = doc_id.asc_nulls_first() if keep == "min" else doc_id.desc_nulls_last()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = rows.withColumns({"head": F.substring(text, 1, HEAD), "mark": F.xxhash64(text)})
    ranged = keyed.repartitionByRange(parts, "head", "mark", order).sortWithinPartitions("head", "mark", text, order).select("row", doc_id.alias("id"))
    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("sha", StringType()), StructField("id", LongType()), StructField("edge", BooleanType()), StructField("part", IntegerType())])
    firsts = materialize(ranged.mapInArrow(_first_of_runs, schema), "exact-firsts")
    known = F.col("id").isNotNull()
    best = F.min_by("part", F.struct(known, "id", "part")) if keep == "min" else F.max_by("part", F.struct(known, "id", -F.col("part")))
    won = firsts.where("edge").groupBy("sha").agg(best.alias("won")).withColumnRenamed("sha", "_sha")
    joined = firsts.join(F.broadcast(won), F.col("sha") == F.col("_sha"), "left")
    return joined.where(~F.col("edge") | (F.col("part") == F.col("won"))).select("row.*")


def _first_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes on the first row of each run of equal texts. A run at a partition's beginning or end is an edge."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    before: bytes | None = None
    held: pa.RecordBatch | None = None  # the last run's row, until it is known whether another run follows
    started = False  # whether the first run has been passed on

    def made(rows: pa.Array, shas: list[str], ids: pa.Array, edges: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows, pa.array(shas, pa.string()), ids, pa.array(edges, pa.bool_()), pa.array([part] * len(shas), pa.int32())], names=["row", "sha", "id", "edge", "part"])

    for batch in batches:
        rows, ids = batch.column(0), batch.column(1)
        texts, firsts, digests = rows.field("text"), [], []
        missing = rows.is_null().to_pylist() if rows.null_count else None
        for i, text in enumerate(texts):
            own = b"" if (missing and missing[i]) or not text.is_valid else text.as_py().encode("utf-8", "surrogatepass").lower()
            if own != before:
                firsts.append(i)
                digests.append(hashlib.sha256(own).hexdigest())
                before = own
        if not firsts:
            continue
        if held is not None:
            yield held.set_column(3, "edge", pa.array([not started], pa.bool_()))
            started = True
        take = pa.array(firsts[:-1], pa.int64())
        if len(take):
            yield made(rows.take(take), digests[:-1], ids.take(take), [not started] + [False] * (len(take) - 1))
            started = True
        last = pa.array(firsts[-1:], pa.int64())
        held = made(rows.take(last), digests[-1:], ids.take(last), [True])
    if held is not None:
        yield held
