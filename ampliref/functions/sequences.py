"""Sequence functions as Column expressions: they stay in whole-stage code and push down where filters do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public genetic codes' stop codons.
STOPS = {"vertebrate_mitochondrial": ("TAA", "TAG", "AGA", "AGG"), "standard": ("TAA", "TAG", "TGA")}


def clean_sequence(sequence: Column) -> Column:
    """White space removed, upper case."""
    return F.upper(F.regexp_replace(sequence, r"\s+", ""))


def reverse_complement(sequence: Column) -> Column:
    """Upper-case A, C, G, T complemented, others unchanged, reversed."""
    return F.reverse(F.translate(sequence, "ATCG", "TAGC"))


def remove_primers(sequence: Column, forward: Sequence[str | None] = (), reverse: Sequence[str | None] = ()) -> Column:
    """Strips the first forward primer that is a prefix, then the first reverse primer whose reverse complement is a suffix."""
    out = sequence
    cut = out
    for p in reversed([p for p in forward if p]):
        cut = F.when(out.startswith(p), F.substring(out, F.lit(len(p) + 1), F.length(out))).otherwise(cut)
    out = tail = cut
    table = str.maketrans("ATCG", "TAGC")
    for p in reversed([p.translate(table)[::-1] for p in reverse if p]):
        tail = F.when(out.endswith(p), F.substring(out, F.lit(1), F.length(out) - len(p))).otherwise(tail)
    return tail


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def sequence_features(sequence: Column) -> dict[str, Column]:
    """length, GC and AT content over A, C, G, T, and skews; 0 where nothing is counted."""
    names = ("length", "gc_content", "at_content", "gc_skew", "at_skew")
    return {k: feature_struct(sequence)[k] for k in names}


def feature_struct(sequence: Column) -> Column:
    """sequence_features as one struct, whose counts are made once a row."""

    def features(n: Column) -> Column:
        size, a, c, g, t = (n[i] for i in range(5))
        return F.struct(size.cast("int").alias("length"), _share(g + c, a + c + g + t).alias("gc_content"), _share(a + t, a + c + g + t).alias("at_content"), _share(g - c, g + c).alias("gc_skew"), _share(a - t, a + t).alias("at_skew"))

    # what is left without a base tells its count; matches would be kept as an array of strings. The outer lambda holds
    # the sequence, the inner one the counts
    left = lambda s, b: F.length(s) - F.length(F.replace(s, F.lit(b), F.lit("")))
    counts = F.transform(F.array(sequence), lambda s: F.array(F.length(s).cast("double"), *[left(s, b).cast("double") for b in "ACGT"]))
    return F.transform(counts, features)[0]


def check_codons(sequence: Column, gene: Column, coding: Sequence[str] = ("COI", "complete_genome"), code: str = "vertebrate_mitochondrial", strict_length: bool = True) -> Column:
    """struct(has_stop, frameshifted, best_frame): the frame with fewest stop codons, first on ties. Null for other genes and below three bases.

    has_stop: even that frame has one. frameshifted: more than two, or with strict_length a length that isn't a multiple of three.
    """
    upper = F.upper(sequence)
    size = F.length(upper)

    stop = "|".join(STOPS[code])

    def count(frame: int) -> Column:
        # each match runs over codons to the next stop codon, so there are as many matches as stops, in one pass; any
        # other character is as good as N, since no stop codon has one
        return F.regexp_count(F.substring(upper, frame + 1, 2_000_000_000), F.lit(rf"(?s)\G(?:(?!{stop}).{{3}})*+(?:{stop})"))

    def verdict(counts: Column) -> Column:
        least = F.array_min(counts)
        shifted = least > 2
        return F.struct((least > 0).alias("has_stop"), ((size % 3 != 0) | shifted if strict_length else shifted).alias("frameshifted"), F.array_position(counts, least).cast("int").alias("best_frame"))

    # a lambda over the one array of counts: its body reads them as often as it likes, and they are made once
    result = F.transform(F.array(F.array(*[count(f) for f in range(3)])), verdict)[0]
    return F.when(gene.isin(*coding) & (size >= 3), result)


def check_rrna(sequence: Column, gene: Column, rrna: Sequence[str] = ("12S", "16S"), min_length: int = 100) -> Column:
    """struct(has_short, has_gaps); null for other genes."""
    result = F.struct((F.length(sequence) < min_length).alias("has_short"), sequence.rlike("[^ACGT]").alias("has_gaps"))
    return F.when(gene.isin(*rrna), result)


def hamming(a: Column, b: Column) -> Column:
    """Positions in which two strings of equal length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
