"""Quality checks of reference sequences, and the flags that they make."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliref.functions.sequences import check_codons, check_rrna, clean_sequence
from ampliref.operators.align import contaminated
from ampliref.operators.distance import terminal_branches
from ampliref.schemas import require_columns

#: Flag name -> boolean column, in the order in which flags are joined.
CHECKS = {"contaminant": "is_contaminant", "numt": "is_numt", "internal_stop": "has_stop", "frameshifted": "frameshifted", "sequence_short": "has_short", "sequence_gap": "has_gaps"}
#: Tips of a tree from which branches are judged.
LEAST_TIPS = 5
#: Characters of all NUMTs up to which they are broadcast and looked for one by one; more are found by their first SEED
#: characters. Both ways compare the same strings and find the same rows.
BROADCAST_CHARS, SEED = 1 << 20, 16


def screen_numts(df: DataFrame, numts: DataFrame | None, sequence_col: str = "sequence", out: str = "is_numt") -> DataFrame:
    """Adds whether any NUMT (column `sequence`) is a part of the sequence, letter for letter. Each distinct sequence is looked at once."""
    if numts is None:
        warnings.warn("No NUMT sequences: all rows count as clean.", stacklevel=2)
        return df.withColumn(out, F.lit(False))
    parts = numts.select(F.col("sequence").alias("_numt")).where("_numt != ''").distinct()
    distinct = df.select(F.col(sequence_col).alias("_seq")).where(F.col("_seq").isNotNull()).distinct()
    if (parts.agg(F.sum(F.length("_numt"))).first()[0] or 0) <= BROADCAST_CHARS:
        hit = distinct.join(F.broadcast(parts), F.col("_seq").contains(F.col("_numt")), "left_semi")
    else:
        # a NUMT is in a sequence only if its first characters are, whatever they are; shorter ones are whole windows
        size = F.least(F.length("_numt"), F.lit(SEED))
        keyed = parts.select("_numt", F.substring("_numt", F.lit(1), size).alias("_key"))
        sizes = sorted(r[0] for r in keyed.select(F.length("_key")).distinct().collect())  # at most SEED
        known = distinct.withColumn("_sha", F.sha2("_seq", 256))
        windows = [F.when(F.length("_seq") >= k, F.expr(f"transform(sequence(1, length(_seq) - {k - 1}), i -> substring(_seq, i, {k}))")).otherwise(F.array().cast("array<string>")) for k in sizes]
        spread = known.select("_sha", F.explode(F.array_distinct(F.concat(*windows))).alias("_key"))
        met = spread.join(keyed, "_key").select("_sha", "_numt")
        hit = met.join(known, "_sha").where(F.col("_seq").contains(F.col("_numt"))).select("_seq").distinct()
    hit = hit.withColumn("_hit", F.lit(True))
    return df.join(hit, df[sequence_col] == hit["_seq"], "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit", "_seq")


def check_genome_completeness(df: DataFrame, required: Sequence[str] = ("COI", "12S"), genome_gene: str = "complete_genome", species_col: str = "species", gene_col: str = "gene") -> DataFrame:
    """Adds genome_flag: missing_genes on genome rows of species that lack a required gene, else null.

    One number a species says which genes there are, so the aggregate is combined before the shuffle.
    """
    require_columns(df, [species_col, gene_col])
    have = [F.max(F.coalesce(F.col(gene_col) == g, F.lit(False))).alias(f"_g{i}") for i, g in enumerate(required)]
    whole = F.lit(True)
    for i in range(len(required)):
        whole = whole & F.col(f"_g{i}")
    per = df.groupBy(F.col(species_col).alias("_sp")).agg(*have or [F.lit(1).alias("_x")]).select("_sp", whole.alias("_whole"))
    # only genome rows are asked about
    out = df.join(per, df[species_col].eqNullSafe(per["_sp"]), "left")
    return out.withColumn("genome_flag", F.when((F.col(gene_col) == genome_gene) & ~F.coalesce("_whole", F.lit(False)), "missing_genes")).drop("_sp", "_whole")


def check_divergence(df: DataFrame, species_col: str = "species", gene_col: str = "gene", sequence_col: str = "sequence", id_col: str = "unique_code", min_seqs: int = 5, outlier_mult: float = 5, outlier_floor: float = 0.02) -> DataFrame:
    """Adds div_result per row: insufficient_data, high_length_variation, divergent, pass or processing_error.

    A row diverges when its terminal branch is longer than both outlier_floor and outlier_mult times the median of its
    species and gene; groups of fewer than five tips have no outliers. Branches are those of the group's distances by
    k-mers (see terminal_branches). A sequence without a k-mer has no place in a tree: tree_error.
    """
    require_columns(df, [species_col, gene_col, sequence_col, id_col])
    size = F.length(sequence_col)
    groups = df.groupBy(F.col(species_col).alias("_sp"), F.col(gene_col).alias("_ge")).agg(F.count(F.lit(1)).alias("_n"), F.max(size).alias("_hi"), F.min(size).alias("_lo"))
    status = F.when(F.col("_n") < min_seqs, "insufficient_data").when(F.coalesce(F.col("_hi") > 100 * F.col("_lo"), F.lit(True)), "high_length_variation")
    status = F.coalesce(status, F.when(F.col("_n") < LEAST_TIPS, "pass"))
    groups = groups.select("_sp", "_ge", status.alias("_status"))
    known = df.join(groups, df[species_col].eqNullSafe(groups["_sp"]) & df[gene_col].eqNullSafe(groups["_ge"]), "left").drop("_sp", "_ge")
    asked = known.where(F.col("_status").isNull()).select(F.concat_ws("\x01", F.coalesce(species_col, F.lit("")), F.coalesce(gene_col, F.lit(""))).alias("group"), F.col(id_col).alias("id"), F.col(sequence_col).alias("sequence"))
    branches = terminal_branches(asked)
    medians = branches.where(~F.isnan("branch")).groupBy("group").agg(F.percentile("branch", 0.5).alias("_median")).withColumnRenamed("group", "_group")
    judged = branches.join(medians, F.col("group") == F.col("_group"), "left")
    outlier = (F.col("branch") > F.greatest(F.col("_median") * outlier_mult, F.lit(outlier_floor))) & (F.col("branch") > outlier_floor)
    judged = judged.select(F.col("id").alias("_id"), F.when(F.isnan("branch"), "tree_error").when(outlier, "divergent").otherwise("pass").alias("_judged")).distinct()
    out = known.join(judged, known[id_col] == judged["_id"], "left")
    return out.withColumn("div_result", F.coalesce("_status", "_judged", F.lit("processing_error"))).drop("_status", "_judged", "_id")


def compile_qc_flags(df: DataFrame, checks: dict[str, str] | None = None, extra_flags: Sequence[tuple[str, Column]] = (), extra_flag_fn: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Adds qc_flag: names of the checks whose column is true, then extra flags, joined by |; "pass" if there are none.

    A missing column or value counts as false. extra_flag_fn: from the DataFrame to a string Column, '' for no flag.
    """
    parts = [F.when(F.coalesce(F.col(c).cast("boolean"), F.lit(False)), F.lit(name)) for name, c in (checks or CHECKS).items() if c in df.columns]
    parts += [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in extra_flags]
    if extra_flag_fn is not None:
        extra = extra_flag_fn(df)
        parts.append(F.when(extra != "", extra))
    joined = F.concat_ws("|", *parts) if parts else F.lit("")
    return df.withColumn("qc_flag", F.when(joined == "", "pass").otherwise(joined))


def run_qc_pipeline(df: DataFrame, contaminants: DataFrame | None = None, numts: DataFrame | None = None, species_col: str = "species", gene_col: str = "gene", sequence_col: str = "sequence", id_col: str = "unique_code", min_divergence_seqs: int = 5, coding: Sequence[str] = ("COI", "complete_genome"), rrna: Sequence[str] = ("12S", "16S"), required: Sequence[str] = ("COI", "12S"), genome_gene: str = "complete_genome", divergence: bool = True) -> DataFrame:
    """All checks in order, then the flags. contaminants: reference rows (id, sequence); None screens nothing."""
    require_columns(df, [species_col, gene_col, sequence_col, id_col])
    out = df.withColumn(sequence_col, clean_sequence(F.col(sequence_col)))
    out = contaminated(out, contaminants, sequence_col) if contaminants is not None else out.withColumn("is_contaminant", F.lit(False))
    out = screen_numts(out, numts, sequence_col) if numts is not None else out.withColumn("is_numt", F.lit(False))
    codon, integrity = check_codons(F.col(sequence_col), F.col(gene_col), coding), check_rrna(F.col(sequence_col), F.col(gene_col), rrna)
    out = out.withColumn("_codon", codon).withColumn("_rrna", integrity)
    for column, value in (("has_stop", "_codon.has_stop"), ("frameshifted", "_codon.frameshifted"), ("has_short", "_rrna.has_short"), ("has_gaps", "_rrna.has_gaps")):
        out = out.withColumn(column, F.coalesce(F.col(value), F.lit(False)))
    out = check_genome_completeness(out.drop("_codon", "_rrna"), required, genome_gene, species_col, gene_col)
    out = check_divergence(out, species_col, gene_col, sequence_col, id_col, min_divergence_seqs) if divergence else out.withColumn("div_result", F.lit(None).cast("string"))
    failed = F.col("div_result").isin("tree_error", "high_length_variation", "processing_error")
    named = F.when(F.col("div_result") == "tree_error", "tree_error").otherwise(F.concat(F.lit("tree_"), "div_result"))
    out = out.withColumn("_failed", F.when(failed, named).otherwise(""))
    extra = [("incomplete_genome", F.col("genome_flag") == "missing_genes"), ("divergent", F.col("div_result") == "divergent")]
    extra += [(f"tree_{s}", F.col("_failed") == f"tree_{s}") for s in ("error", "high_length_variation", "processing_error")]
    extra += [("manual_review_needed", F.col(gene_col) == "other")]
    return compile_qc_flags(out, extra_flags=extra).drop("_failed")
