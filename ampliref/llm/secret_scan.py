"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must contain. Postings of
the trigrams that rules ask for, cut into buckets of documents, are intersected into candidates, and only candidates are
searched with the rule. A rule whose expression has no mandatory trigram searches every text. All of it is DataFrame code.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliref.llm.common import materialize
from ampliref.llm.spans import SPANS, by_start, count, find, joined


@dataclass(frozen=True)
class Rule:
    """name; the pattern whose trigrams a match must have; the same pattern as searched: without second looks."""

    name: str
    pattern: str
    search: str


# The public forms of credentials.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})", r"(?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"),
    Rule("access", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", r"[0-9a-f]{24,}", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
)
KINDS = [r.name for r in RULES]
#: Of an assignment, what is dropped unless the value has six characters.
_SHORT_VALUE = r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}$"
#: Documents whose postings form one bucket, so that no list of documents grows without bound.
BUCKET = 4096
_MOST_STRINGS = 64

Query = list[list[frozenset[str]]]  # all of: any of: all trigrams of one set


def trigram_query(pattern: str) -> Query:
    """What any match contains, lower-cased: a conjunction of alternatives, each a set of trigrams; empty if nothing is mandatory."""
    query: Query = []

    def flush(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            query.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))

    def strings(node) -> set[str] | None:
        """All strings that a piece of the expression matches, if there are few."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is sre.SUBPATTERN:
            return whole(arg[-1])
        if op is sre.BRANCH:
            parts = [whole(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is sre.MAX_REPEAT and arg[1] == 1:
            inner = whole(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def whole(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            if (s := strings(node)) is None or len(out) * len(s) > _MOST_STRINGS:
                return None
            out = {a + b for a, b in product(out, s)}
        return out

    run = {""}
    for node in parser.parse(pattern):
        s = strings(node)
        if s is not None and len(run) * len(s) <= _MOST_STRINGS:
            run = {a + b for a, b in product(run, s)}
            continue
        flush(run)
        run = s or {""}
    flush(run)
    return query


def trigram_postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, bucket, ids): the documents whose lower-cased text has grams[gram], in sorted lists of a bucket each."""
    low = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("low"))
    having = low.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(i)) for i, g in enumerate(grams)]))).alias("gram"))
    spread = F.xxhash64(F.expr(f"doc_id div {BUCKET}"))
    return having.groupBy("gram", spread.alias("bucket")).agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))


def candidates(postings: DataFrame, grams: list[str], queries: dict[int, Query]) -> DataFrame:
    """(doc_id, rules): intersects postings; rules is a bit mask of the rules whose query a document fulfils."""
    wide = postings.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))
    none = F.expr("cast(array() as array<bigint>)")
    ids = lambda g: F.coalesce(F.element_at("lists", F.lit(grams.index(g))), none)

    def all_of(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = F.array_intersect(out, p)
        return out

    def any_of(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = F.array_union(out, p)
        return out

    hits = [
        wide.select(F.explode(all_of([any_of([all_of([ids(g) for g in sorted(alt)]) for alt in conjunct]) for conjunct in query])).alias("doc_id"), F.lit(1 << i).cast("long").alias("rules"))
        for i, query in queries.items()
    ]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.groupBy("doc_id").agg(F.bit_or("rules").alias("rules"))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans (kind as the place of the rule in `rules`, start, end), by start, then kind.

    Null text counts as empty. Rows that repeat an identifier are candidates together and searched apart; rows without
    an identifier are searched with every rule. Other columns are ignored; an empty table gives no rows.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for conjunct in q for alt in conjunct for g in alt})
    postings = materialize(trigram_postings(text, grams), "secret-postings")
    found = materialize(candidates(postings, grams, queries), "secret-candidates").withColumnRenamed("doc_id", "_id")
    every = sum(1 << i for i in queries)
    # as small as candidates are, Spark broadcasts them below its threshold; else both sides are shuffled
    asked = text.join(found, F.col("doc_id") == F.col("_id"), "left").withColumn("rules", F.when(F.col("doc_id").isNull(), F.lit(every)).otherwise(F.coalesce("rules", F.lit(0))))
    parts = []
    for i, r in enumerate(rules):
        keep = (lambda m: m.rlike(_SHORT_VALUE)) if r.name == "assign" else None
        asked_for = F.col("rules").bitwiseAND(F.lit(1 << i)) != 0 if i in queries else None
        parts.append(find(F.col("text"), r.search, i, keep, gate=asked_for))
    return asked.select("doc_id", by_start(F.concat(*parts)).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of secrets() with RULES; the first three are the base kinds."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", *[count(spans, i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(spans, KINDS).alias("spans"),
    )
