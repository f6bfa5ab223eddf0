"""Assigning sequence variants (ASVs) to species, with ties shown, and building species matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliref.functions.sequences import clean_sequence
from ampliref.operators.align import search
from ampliref.operators.numbering import numbered
from ampliref.operators.query import Values, get_sequences
from ampliref.schemas import ASSIGNMENT, METRICS, match_arg, require_columns


def exact_hits(asvs: DataFrame, refs: DataFrame) -> DataFrame:
    """A hit for each reference whose cleaned sequence equals the ASV's. Spark broadcasts the side that its threshold allows."""
    own = asvs.select("asv_id", clean_sequence(F.col("sequence")).alias("_seq"))
    theirs = refs.select(clean_sequence(F.col("sequence")).alias("_ref"), *[F.col(c) if c in refs.columns else F.lit(None).cast("string").alias(c) for c in ("species", "genus", "family")])
    size = F.length("_seq").cast("double")
    constants = {"pident": 100.0, "qcov": 1.0, "scovs": 1.0, "ccovs": 1.0, "evalue": 0.0}
    hits = own.join(theirs, F.col("_seq") == F.col("_ref"))
    return hits.select("asv_id", "species", "genus", "family", *[F.lit(v).alias(k) for k, v in constants.items()], size.alias("bitscore"), F.lit(1.0).alias("bitscore_pb"))


def blast_metrics(hits: DataFrame) -> DataFrame:
    """Adds coverages and the bit score per base to tabular hits."""
    q, s = F.try_divide("length", "qlen"), F.try_divide("length", "slen")
    return hits.withColumn("qcov", q).withColumn("scovs", s).withColumn("ccovs", F.sqrt(F.col("qcov") * F.col("scovs"))).withColumn("bitscore_pb", F.try_divide("bitscore", "length"))


def similarity_hits(asvs: DataFrame, refs: DataFrame, min_identity: float = 99, min_coverage: float = 0.9, max_targets: int = 100) -> DataFrame:
    """Hits of a similarity search against refs (unique_code, sequence, lineage) that cover min_coverage of the query."""
    found = search(asvs.select(F.col("asv_id").alias("id"), "sequence"), refs.select(F.col("unique_code").alias("id"), "sequence"), min_identity, max_targets, min_coverage)
    meta = refs.select(F.col("unique_code").alias("subject_id"), "species", "genus", "family")
    return blast_metrics(found).join(meta, "subject_id", "left").where(F.col("qcov") >= min_coverage)


def score_assignments(hits: DataFrame, min_identity: float = 99, min_coverage: float = 0.9, tie_bitscore: float = 0) -> DataFrame:
    """One row per ASV: its best hit, and the species that can't be told from it.

    Best: by bit score, bit score per base, e-value, coverage, identity. Tied: a bit score within tie_bitscore of the
    best, all else equal. One shuffle by asv_id serves the window and the aggregate.
    """
    require_columns(hits, ["asv_id", "species", *METRICS])
    for c in ("genus", "family"):
        if c not in hits.columns:
            hits = hits.withColumn(c, F.lit(None).cast("string"))
    order = [F.col("bitscore").desc_nulls_last(), F.col("bitscore_pb").desc_nulls_last(), F.col("evalue").asc_nulls_last(), F.col("ccovs").desc_nulls_last(), F.col("pident").desc_nulls_last(), F.col("qcov").desc_nulls_last(), F.col("scovs").desc_nulls_last()]
    best = F.first(F.struct(*METRICS)).over(Window.partitionBy("asv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = hits.select("asv_id", "species", "genus", "family", *METRICS, best.alias("best"))
    same = F.col("bitscore") >= F.col("best.bitscore") - tie_bitscore
    for m in ("bitscore_pb", "evalue", "ccovs", "pident"):
        same = same & F.col(m).eqNullSafe(F.col(f"best.{m}"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    tied = rows.where(same | F.col("best.bitscore").isNull()).groupBy("asv_id").agg(
        F.first("best").alias("best"), names("species").alias("species"), names("genus").alias("genus"), names("family").alias("family"),
        F.count_distinct("species").cast("int").alias("n_best_species"), F.count(F.lit(1)).alias("_rows"), F.min("bitscore").alias("_lo"), F.max("bitscore").alias("_hi"),
    )
    n = F.col("n_best_species")
    status = F.when(n == 1, "unique").when((n > 1) & (F.col("_rows") > 1) & (F.col("_lo") == F.col("_hi")), "check_full_tie").otherwise("ambiguous")
    sure = (F.col("best.pident") >= min_identity) & (F.col("best.ccovs") >= min_coverage)
    empty = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    out = tied.withColumn("assignment_status", status)
    return out.select(
        "asv_id", empty("species"), empty("genus"), empty("family"), *[F.col(f"best.{m}").alias(m) for m in METRICS], "n_best_species", "assignment_status",
        F.when(F.col("assignment_status") != "unique", "ambiguous").when(F.coalesce(sure, F.lit(False)), "high").otherwise("low").alias("confidence"),
        F.when(n > 1, F.col("species")).alias("tie_taxa"),
    ).select(*ASSIGNMENT)


def with_missing(asvs: DataFrame, scored: DataFrame) -> DataFrame:
    """All ASVs: those without a hit get no_match. Keeps `ord` where the ASVs have it."""
    order = [c for c in ("ord",) if c in asvs.columns]
    rest = [c for c in ASSIGNMENT if c != "asv_id"]
    fill = {"n_best_species": F.lit(0), "assignment_status": F.lit("no_match"), "confidence": F.lit("none")}
    both = asvs.select("asv_id", *order).join(scored, "asv_id", "left")
    return both.select("asv_id", *[F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(c) for c in rest], *order)


def assign(asvs: DataFrame, final: DataFrame, marker: Values = None, method: str = "exact", min_identity: float = 99, min_coverage: float = 0.9, max_targets: int = 100) -> DataFrame:
    """Assigns ASVs (asv_id, sequence, [ord]) with the sequences of `final` that pass; in the ASVs' order where ord is given.

    Identifiers must be unique. method: exact, or blastn for the similarity search.
    """
    method = match_arg(method, ("blastn", "exact"))
    repeated = asvs.groupBy("asv_id").count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError("asv_id must be unique")
    refs = get_sequences(final, marker=marker)
    if method == "exact":
        hits = exact_hits(asvs, refs)  # which cleans both sides
    else:
        hits = similarity_hits(asvs, refs.withColumn("sequence", clean_sequence(F.col("sequence"))), min_identity, min_coverage, max_targets)
    out = with_missing(asvs, score_assignments(hits, min_identity, min_coverage))
    return out.orderBy("ord").drop("ord") if "ord" in asvs.columns else out


def species_matrix(assignment: DataFrame, counts: DataFrame, include_ambiguous: bool = False, unassigned: bool = False, strict: bool = False) -> DataFrame:
    """Sums each sample column of counts per species. Text that isn't a number counts as missing, and missing as 0.

    include_ambiguous: ties count too, as their joined name. unassigned: ASVs without a species are summed up as
    "unassigned". strict: a missing count makes the sum missing.
    """
    require_columns(assignment, ["asv_id", "species", "assignment_status"])
    require_columns(counts, ["asv_id"])
    samples = [c for c in counts.columns if c not in ("asv_id", "species", "assignment_status")]
    both = assignment.select("asv_id", "species", "assignment_status").join(counts.select("asv_id", *[F.col(f"`{s}`") for s in samples]), "asv_id")
    status = F.col("assignment_status")
    keep = F.col("species").isNotNull() & (F.lit(True) if include_ambiguous else status == "unique") & (status != "no_match")
    if unassigned:
        none = F.col("species").isNull() | (status == "no_match")
        both, keep = both.withColumn("species", F.when(none, "unassigned").otherwise(F.col("species"))), keep | none

    def total(s: str) -> Column:
        value = F.expr(f"try_cast(`{s}` AS double)")
        return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value)).alias(s) if strict else F.coalesce(F.sum(value), F.lit(0.0)).alias(s)

    return both.where(keep).groupBy("species").agg(*[total(s) for s in samples])


def to_long(counts: DataFrame, id_col: str = "asv_id") -> DataFrame:
    """(id, sample, reads) from one column per sample."""
    samples = [c for c in counts.columns if c != id_col]
    return counts.unpivot([id_col], samples, "sample", "reads")


def to_wide(long: DataFrame, samples: list[str], id_col: str = "asv_id") -> DataFrame:
    """One column per sample, 0 where there is none. The samples are named, so no job looks for them."""
    return long.groupBy(id_col).pivot("sample", samples).agg(F.sum("reads")).na.fill(0, samples)


def asv_ids(df: DataFrame, order: list[Column], name: str = "asv_id") -> DataFrame:
    """ASV_00001, ASV_00002, in order."""
    return numbered(df, order, "_number").withColumn(name, F.format_string("ASV_%05d", "_number")).drop("_number")


def compare(a: DataFrame, b: DataFrame, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Two assignments side by side, with ASVs that only one has."""
    left = a.select("asv_id", *[F.col(c).alias(c + suffixes[0]) for c in a.columns if c != "asv_id"])
    right = b.select("asv_id", *[F.col(c).alias(c + suffixes[1]) for c in b.columns if c != "asv_id"])
    return left.join(right, "asv_id", "full")


def override_ties(assignment: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """Replaces joined species names by the one that was decided for, and counts such rows as unique."""
    known = F.col("tie_taxa").isin(*chosen) if chosen else F.lit(False)
    name = F.col("species")
    for joined, one in chosen.items():
        name = F.when(F.col("tie_taxa") == joined, one).otherwise(name)
    return assignment.withColumn("species", name).withColumn("assignment_status", F.when(known, "unique").otherwise(F.col("assignment_status")))
