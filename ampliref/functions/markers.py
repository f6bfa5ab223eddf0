"""Markers read from free-text descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the markers and what descriptions call them, in the order in which the first one wins.
MARKER_PATTERNS = (
    ("12S", "12s|mt-rnr1"),
    ("16S", "16s|mt-rnr2"),
    ("COI", "coi|co1|cox1|cytochrome c oxidase subunit"),
)
GENOME = "complete genome|mitochondrion, complete genome|mitogenome"
MULTI_GENE = "genes for|gene for|and|;|,.*and|partial.*complete|complete.*partial|complete.*complete|rrna.*rrna|rrna.*trna|trna.*rrna"
OTHER_GENE = "trna|transfer rna|cytb|nd[0-9]|atp[0-9]|nad[0-9]"


def extract_markers(description: Column, patterns: Sequence[tuple[str, str]] = MARKER_PATTERNS, genome: str = GENOME, multi_gene: str = MULTI_GENE, other_gene: str = OTHER_GENE, legacy_alternation: bool = False) -> Column:
    """The marker of a description with its completeness, several joined by ; or other_unknown.

    legacy_alternation: a pattern's alternatives aren't grouped before "partial" or "complete" is looked for behind them,
    so its bare first alternatives count as partial.
    """
    low = F.lower(description)

    def completeness(near: str | None = None) -> Column:
        if near is None:
            return F.when(low.contains("partial"), "partial").when(low.contains("complete"), "complete").otherwise("unknown")
        p = near if legacy_alternation else f"(?:{near})"
        return F.when(low.rlike(f"{p}.*partial|partial.*{p}"), "partial").when(low.rlike(f"{p}.*complete|complete.*{p}"), "complete").otherwise("unknown")

    each = [F.when(low.rlike(p), F.concat(F.lit(f"{name}_"), completeness(p))) for name, p in patterns]
    each.append(F.when(low.rlike(other_gene), F.concat(F.lit("other_"), completeness())))
    several = F.array_join(F.array_distinct(F.array_compact(F.array(*each))), ";")
    out = F.when(low.rlike(genome), F.lit("genome_complete")).when(low.rlike(multi_gene), F.when(several != "", several).otherwise("other_unknown"))
    for name, p in patterns:
        out = out.when(low.rlike(p), F.concat(F.lit(f"{name}_"), completeness()))
    return out.otherwise("other_unknown")


def normalize_marker(marker: Column) -> Column:
    """The short names that checks and reports use: completeness dropped, several markers -> multiple, whole genomes -> genome."""
    bare = F.regexp_replace(marker, "_(partial|complete|unknown)$", "")
    return F.when(marker.contains(";"), "multiple").when(marker.isin("genome_complete", "complete_genome", "genome"), "genome").otherwise(bare)
