"""Barcode gaps: distances within species against distances to others.

Distances are whole numbers of differing positions, so a histogram per species holds all that the metrics need. Pairs
within a species are made block by block; pairs with others are made where the focal rows are, against bounded, hash-drawn
sets of other rows; only histograms are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliref.operators.align import align_nested
from ampliref.operators.distance import differences, matrix, pair_histogram
from ampliref.schemas import require_columns
from ampliref.session import shared_path

MARKERS = ("COI", "12S", "16S", "genome")
METRIC_TYPES = {
    "max_intra": "double", "min_inter": "double", "gap_exists": "boolean", "gap_width": "double", "p_overlap": "double", "q_overlap": "double",
    "median_intra": "double", "median_inter": "double", "intra_95": "double", "inter_5": "double", "percentile_gap": "double", "robust_gap": "boolean",
    "n_congeners_in_db": "int", "min_congeneric": "double", "congeneric_gap": "double", "congeneric_p_overlap": "double", "congeneric_q_overlap": "double", "n_diagnostic_sites": "int",
}
#: Genus and marker rows that a task compares at once.
FOCAL_BLOCK = 2048


def quantile(values: np.ndarray, counts: np.ndarray, p: float) -> float:
    """Linear interpolation between order statistics (type 7) of values that occur counts times; values ascend."""
    n = counts.sum()
    if not n:
        return float("nan")
    ends = np.cumsum(counts)
    h = (n - 1) * p
    lo, hi = (values[np.searchsorted(ends, k, "right")] for k in (np.floor(h), np.ceil(h)))
    return float(lo + (h - np.floor(h)) * (hi - lo))


def _capped(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most `most` rows of each group, drawn by a hash of the identifier. Spark limits each task's rows before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64("id"), "id")
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def _pool(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """Rows of each group among which every species finds `most` others, if there are so many: no species has more than
    `most` of the first 2 * most."""
    return _capped(_capped(df, [*by, "species"], most), by, 2 * most)


def diagnostic_sites(df: DataFrame, min_freq: float = 0.9, max_other: int = 500) -> DataFrame:
    """(marker, species, n_diagnostic_sites) for (marker, species, id, aligned): positions where a base that no other species of
    the marker has stands in at least min_freq of a species' sequences. Others are at most max_other drawn rows."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[str]] = {}
            for marker, species, seq in zip(*(batch.column(c).to_pylist() for c in ("marker", "species", "aligned"))):
                groups.setdefault((marker, species), []).append(seq)
            for (marker, species), seqs in groups.items():
                m = matrix(seqs)
                at, base, n = [], [], []
                for p in range(m.shape[1]):
                    v, c = np.unique(m[:, p], return_counts=True)
                    at += [p] * len(v)
                    base += v.tolist()
                    n += c.tolist()
                yield pa.RecordBatch.from_arrays([pa.array([marker] * len(at), pa.string()), pa.array([species] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(base, pa.int32()), pa.array(n, pa.int64())], names=["marker", "species", "pos", "base", "n"])

    rows = df.select("marker", "species", "id", "aligned")
    counts = rows.mapInArrow(counted, "marker string, species string, pos int, base int, n long").groupBy("marker", "species", "pos", "base").agg(F.sum("n").alias("n"))
    sizes = rows.groupBy("marker", "species").agg(F.count(F.lit(1)).alias("size"))
    frequent = counts.join(sizes, ["marker", "species"]).where(F.col("n") >= F.lit(min_freq) * F.col("size")).select("marker", "species", "pos", "base")
    # the first max_other others of a species: those among the pool's rows that rank behind few enough of its own
    pool = _pool(rows, ["marker"], max_other)
    ranked = pool.withColumn("_all", F.row_number().over(Window.partitionBy("marker").orderBy(F.xxhash64("id"), "id")))
    others = ranked.select("marker", F.col("species").alias("other"), "aligned", "_all", F.posexplode(F.split("aligned", "")).alias("pos", "char"))
    seen = others.groupBy("marker", "other", "pos", F.ascii("char").alias("base")).agg(F.min("_all").alias("_all"))
    cut = _cutoffs(ranked, sizes, max_other)
    met = frequent.join(seen, ["marker", "pos", "base"]).where(F.col("species") != F.col("other")).join(cut, ["marker", "species"]).where(F.col("_all") <= F.col("_cut"))
    met = met.select("marker", "species", "pos", "base").distinct()
    alone = frequent.join(met, ["marker", "species", "pos", "base"], "left_anti").groupBy("marker", "species").agg(F.count_distinct("pos").cast("int").alias("n_diagnostic_sites"))
    return sizes.join(alone, ["marker", "species"], "left").select("marker", "species", F.coalesce("n_diagnostic_sites", F.lit(0)).alias("n_diagnostic_sites"))


def _cutoffs(ranked: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(marker, species, _cut): the rank up to which the pool has `most` rows of other species."""
    own = ranked.groupBy("marker", "species").agg(F.array_sort(F.collect_list("_all")).alias("_ranks"))
    walk = F.aggregate(F.coalesce("_ranks", F.expr("cast(array() as array<int>)")), F.lit(most), lambda cut, r: F.when(r <= cut, cut + 1).otherwise(cut))
    return sizes.join(own, ["marker", "species"], "left").select("marker", "species", walk.alias("_cut"))


def _against(df: DataFrame, pools: DataFrame, by: list[str], most: int, kind: str) -> DataFrame:
    """(marker, species, kind, distance, n): focal rows against the first `most` rows of other species in their group's pool."""
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / FOCAL_BLOCK).cast("int").alias("_blocks"))
    focal = df.join(sizes, by).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    spread = pools.join(sizes, by).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))

    def run(key: tuple, rows: pa.Table, pool: pa.Table) -> pa.Table:
        names, values, counts = [], [], []
        if len(rows) and len(pool):
            pool = pool.sort_by([("_hash", "ascending"), ("id", "ascending")])
            species, bases = np.array(pool["species"].to_pylist(), object), matrix(pool["aligned"].to_pylist())
            own, seqs = np.array(rows["species"].to_pylist(), object), rows["aligned"].to_pylist()
            for name in sorted(set(own)):
                take = np.flatnonzero(species != name)[:most]
                if len(take):
                    v, n = np.unique(differences(matrix([seqs[k] for k in np.flatnonzero(own == name)]), bases[take]), return_counts=True)
                    names += [name] * len(v)
                    values += v.tolist()
                    counts += n.tolist()
        marker = key[0].as_py()
        return pa.table([pa.array([marker] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([kind] * len(names), pa.string()), pa.array(values, pa.int32()), pa.array(counts, pa.int64())], names=["marker", "species", "kind", "distance", "n"])

    columns = ["species", "id", "aligned", *by]
    left = focal.select(*columns, "_block").groupBy(*by, "_block")
    # renamed to themselves, as both sides come from the same rows
    right = spread.select(*[F.col(c).alias(c) for c in columns], F.col("_block").alias("_block"), F.xxhash64("id").alias("_hash")).groupBy(*by, "_block")
    made = left.cogroup(right).applyInArrow(run, "marker string, species string, kind string, distance int, n long")
    return made.groupBy("marker", "species", "kind", "distance").agg(F.sum("n").alias("n"))


def gap_metrics(df: DataFrame, max_other: int = 2000, max_congeners: int = 500, max_diagnostic: int = 500) -> DataFrame:
    """One row per marker and species for (marker, species, genus, id, aligned), all of a marker of one width.

    Species with one sequence, or without another species in their marker, have no row.
    """
    rows = df.select("marker", "species", "genus", "id", "aligned")
    keys = ["marker", "species"]
    intra = pair_histogram(rows, keys, "id").select(*keys, F.lit("intra").alias("kind"), "distance", "n")
    inter = _against(rows, _pool(rows, ["marker"], max_other), ["marker"], max_other, "inter")
    known = rows.where(F.col("genus").isNotNull())
    congeneric = _against(known, _pool(known, ["marker", "genus"], max_congeners), ["marker", "genus"], max_congeners, "congeneric")
    both = intra.unionByName(inter).unionByName(congeneric)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n_sequences"), F.max(F.length("aligned")).alias("width"), F.min("genus").alias("genus"))
    genera = known.groupBy("marker", "genus").agg((F.count_distinct("species") - 1).cast("int").alias("n_congeners_in_db"))
    sizes = sizes.join(genera, ["marker", "genus"], "left").drop("genus").join(diagnostic_sites(rows, 0.9, max_diagnostic), keys)
    # a species' histogram has no more rows than three times the width
    listed = both.groupBy(*keys).agg(F.collect_list(F.struct("kind", "distance", "n")).alias("histogram"))
    names = ["max_intra", "min_inter", "median_intra", "median_inter", "intra_95", "inter_5", "p_overlap", "q_overlap", "min_congeneric", "congeneric_p_overlap", "congeneric_q_overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m, s, size, width, cong, diag, cells in zip(*(c.to_pylist() for c in batch.columns)):
                h = {}
                for k in ("intra", "inter", "congeneric"):
                    own = sorted((c["distance"], c["n"]) for c in cells if c["kind"] == k)
                    h[k] = np.array([d for d, _ in own], np.float64) / width, np.array([n for _, n in own], np.int64)
                if size < 2 or not len(h["inter"][0]):
                    continue
                (a, na), (b, nb), (c, nc) = h["intra"], h["inter"], h["congeneric"]
                top, low = float(a.max()), float(b.min())
                near = float(c.min()) if len(c) else None
                # from the whole numbers of differences, so that equal distances compare equal
                row = [top, low, quantile(a, na, 0.5), quantile(b, nb, 0.5), quantile(a, na, 0.95), quantile(b, nb, 0.05), float(na[a > low].sum() / na.sum()), float(nb[b < top].sum() / nb.sum())]
                row += [near, float(na[a > near].sum() / na.sum()), float(nc[c < top].sum() / nc.sum())] if len(c) else [None] * 3
                out.append((m, s, size, cong or 0, diag, *row))
            if out:
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()] + [pa.float64()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["marker", "species", "n_sequences", "n_congeners_in_db", "n_diagnostic_sites", *names])

    schema = "marker string, species string, n_sequences int, n_congeners_in_db int, n_diagnostic_sites int, " + ", ".join(f"{n} double" for n in names)
    made = sizes.join(listed, keys).select("marker", "species", "n_sequences", "width", "n_congeners_in_db", "n_diagnostic_sites", "histogram").mapInArrow(run, schema)
    n, cong, gap = F.col("n_sequences"), F.col("n_congeners_in_db"), F.col("max_intra") < F.col("min_inter")
    adequacy = F.when((n >= 20) & (cong >= 3), "high").when((n >= 10) & (cong >= 1), "moderate").otherwise("low")
    cgap = F.col("min_congeneric") - F.col("max_intra")
    pgap = F.col("inter_5") - F.col("intra_95")
    rounded = {c: F.round(c, 4) for c in ("p_overlap", "q_overlap", "congeneric_p_overlap", "congeneric_q_overlap")}
    made = made.withColumns({**rounded, "gap_exists": gap, "gap_width": F.col("min_inter") - F.col("max_intra"), "percentile_gap": pgap, "robust_gap": pgap > 0, "congeneric_gap": cgap, "sampling_adequacy": adequacy})
    made = made.withColumn("taxonomic_resolution", F.when(F.col("gap_exists"), "species").when(F.coalesce(F.col("congeneric_gap") > 0, F.lit(False)), "species (congener-supported)").otherwise("genus_or_higher"))
    made = made.withColumn("gap_may_be_undersampling_artifact", F.col("gap_exists") & (F.col("sampling_adequacy") == "low")).withColumn("error_msg", F.lit(None).cast("string"))
    return made.select("species", "marker", "n_sequences", *METRIC_TYPES, "sampling_adequacy", "taxonomic_resolution", "gap_may_be_undersampling_artifact", "error_msg")


def align_width(df: DataFrame, mode: str) -> DataFrame:
    """Sequences of a marker made one width. mode: align (each species of a marker, then its species, where widths differ),
    require (as they are, else an error row), trim (to the shortest)."""
    if mode == "trim":
        least = df.groupBy("marker").agg(F.min(F.length("aligned")).alias("_least"))
        return df.join(F.broadcast(least), "marker").withColumn("aligned", F.substring("aligned", F.lit(1), F.col("_least"))).drop("_least")
    if mode == "align":
        uneven = [r["marker"] for r in df.groupBy("marker").agg((F.min(F.length("aligned")) != F.max(F.length("aligned"))).alias("u")).where("u").collect()]  # a row a marker
        if uneven:
            wide = df.where(F.col("marker").isin(uneven)).select("marker", "species", F.struct("genus", "id").alias("row"), "aligned")
            made = align_nested(wide, "marker", "species", "row", "aligned").select("marker", "species", "id.genus", "id.id", "aligned")
            # the metrics read it many times
            path = shared_path(df.sparkSession, "aligned")
            made.write.parquet(path)
            return df.where(~F.col("marker").isin(uneven)).select(*made.columns).unionByName(df.sparkSession.read.schema(made.schema).parquet(path))
    return df


def failed_row(df: DataFrame, message: Column) -> DataFrame:
    """The row of a species whose metrics couldn't be made."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in METRIC_TYPES.items()]
    return df.select("species", "marker", "n_sequences", *empty, F.lit(None).cast("string").alias("sampling_adequacy"), F.lit(None).cast("string").alias("taxonomic_resolution"), F.lit(None).cast("boolean").alias("gap_may_be_undersampling_artifact"), message.alias("error_msg"))


def run_barcode_gap(df: DataFrame, markers: Sequence[str] = MARKERS, species_col: str = "species", genus_col: str | None = None, gene_col: str = "seq_type", sequence_col: str = "sequence", qc_flag_col: str | None = "qc_flag", id_col: str = "unique_code", min_seqs: int = 5, alignment: str = "align", max_other: int = 2000, max_congeners: int = 500, max_diagnostic: int = 500) -> DataFrame:
    """Gap metrics of all species of all markers, with assignment_risk and recommended_threshold.

    Rows that pass count, of species with at least min_seqs. The genus is genus_col, else a column genus, else the
    species' first word. Markers whose sequences differ in width are aligned; with alignment "require" they give rows with error_msg instead, and
    "trim" cuts them to the shortest.
    recommended_threshold: the 95th percentile of max_intra in the marker times 1.05, at least 0.97.
    """
    require_columns(df, [species_col, gene_col, sequence_col])
    genus = F.col(genus_col) if genus_col and genus_col in df.columns else F.col("genus") if "genus" in df.columns else F.split(species_col, r"\s+")[0]
    rows = df.where(F.col(gene_col).isin(*markers))
    if qc_flag_col and qc_flag_col in df.columns:
        rows = rows.where(F.col(qc_flag_col) == "pass")
    ident = F.col(id_col).cast("string") if id_col in df.columns else F.sha2(sequence_col, 256)
    rows = rows.select(F.col(gene_col).alias("marker"), F.col(species_col).alias("species"), genus.alias("genus"), ident.alias("id"), F.col(sequence_col).alias("aligned")).where("species is not null and aligned is not null")
    enough = rows.groupBy("marker", "species").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_seqs)
    rows = align_width(rows.join(enough.select("marker", "species"), ["marker", "species"]), alignment)
    uneven = rows.groupBy("marker").agg((F.min(F.length("aligned")) != F.max(F.length("aligned"))).alias("_uneven"))
    rows = rows.join(F.broadcast(uneven), "marker")  # a row per marker
    made = gap_metrics(rows.where("not _uneven"), max_other, max_congeners, max_diagnostic)
    wrong = rows.where("_uneven").groupBy("species", "marker").agg(F.count(F.lit(1)).cast("int").alias("n_sequences"))
    made = made.unionByName(failed_row(wrong, F.lit("sequences of this marker differ in width")))
    high = made.where("error_msg is null").groupBy("marker").agg(F.percentile("max_intra", 0.95).alias("_q"))
    gap, width = F.coalesce("gap_exists", F.lit(False)), F.col("gap_width")
    risk = F.when(F.col("error_msg").isNotNull(), "failed").when(gap & (width > 0.02), "low").when(gap, "moderate").otherwise("high")
    limit = F.when(F.col("error_msg").isNull(), F.round(F.greatest(F.col("_q") * 1.05, F.lit(0.97)), 3))
    return made.join(F.broadcast(high), "marker", "left").withColumn("assignment_risk", risk).withColumn("recommended_threshold", limit).drop("_q")
