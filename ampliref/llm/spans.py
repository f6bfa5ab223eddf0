"""Places of regular expression matches as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type of the arrays that hold spans.
SPANS = "array<struct<kind:int,start:int,end:int>>"


def find(text: Column, pattern: str, kind: int, keep=None, gate: Column | None = None) -> Column:
    """Spans (kind, start, end; code points, end exclusive) of all leftmost disjoint matches, in order.

    The matches and the pieces between them give the places, so the text is searched twice and never indexed.
    keep: from the matched string to a boolean Column, which drops matches. gate: only texts for which it holds are
    searched at all; it must hold wherever the pattern matches.
    """
    empty = F.expr(f"cast(array() as {SPANS})")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + p["g"]
        span = F.array(F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + p["n"]).alias("end")))
        out = F.concat(acc["out"], span if keep is None else F.when(keep(p["m"]), span).otherwise(empty))
        return F.struct((at + p["n"]).alias("at"), out.alias("out"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    # one search tells most texts apart that have no match
    there = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(there, spans).otherwise(empty)


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_start(spans: Column) -> Column:
    """Sorted by start, then kind, then end."""
    shuffled = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.array_sort(shuffled), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
