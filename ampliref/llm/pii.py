"""Personal data: patterns for what has a form, and information-theoretic sanitisation for terms that reveal it.

Entities are spans that a pattern finds. A term of a text that holds an entity discloses it when the corpus says so. Counts
are exact and over N distinct texts, taken whole: df of the term, df of the entity's normalised form or a part of it (its
keys), and c texts that hold both. The pointwise mutual information log2(N c / (df(term) df(key))) must reach a share of
the entity's own information log2(N / df(entity)), and so many common texts must be unlikely by chance among all terms
of the corpus, or the term stands in the entity itself. Such terms are removed wherever they stand in texts that hold the
entity, or above a lower share generalised. All of it is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliref.llm.common import materialize
from ampliref.llm.spans import SPANS, count, find, joined

KINDS = ["email", "ip", "card", "phone", "term"]

# The patterns match what the plain forms beside them match, without their repeated groups and second looks, so that
# long texts cost linear time and no stack.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))"
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#   card  [0-9]([\x20-]?[0-9])+ with 16 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
#   phone \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_IN_RANGE = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

#: Chance terms that an entity's key may expect among all terms of the corpus.
CHANCE = 0.01
#: Shares of an entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95
TERM = r"\p{L}{3,}"


def luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return luhn_digits(digits)


def luhn_digits(digits: Column) -> Column:
    """From the right, every second digit doubled, with 9 taken off above 9; the sum is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.try_to_number(d, F.lit("9")).cast("int") + 1)).otherwise(F.try_to_number(d, F.lit("9")).cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def phone_length(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)


def entities(text: Column) -> Column:
    """Spans of the base kinds, by kind and then start."""
    digit = text.rlike("[0-9]")
    return F.concat(
        find(text, EMAIL, 0, gate=text.contains("@")),
        find(text, IP, 1, lambda m: m.rlike(IP_IN_RANGE), gate=digit & text.contains(".")),
        find(text, CARD, 2, luhn, gate=digit),
        find(text, PHONE, 3, phone_length, gate=text.contains("+")),
    )


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _keys(found: DataFrame) -> DataFrame:
    """(_key, entity, key): the entities of each text, normalised, each with itself and its parts as keys.

    Parts are an email's two sides, an ip's first three numbers, and a phone's or card's digits before its last four.
    """
    each = found.select("_key", "text", F.explode("base").alias("s"))
    each = each.select("_key", F.col("s.kind").alias("kind"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("m"))
    plain = F.when(F.col("kind") == 0, F.lower("m")).when(F.col("kind") == 1, F.regexp_replace("m", r"(^|\.)0+(?=[0-9])", "$1")).otherwise(F.regexp_replace("m", "[^0-9]", ""))
    each = each.select("_key", "kind", plain.alias("m")).distinct()
    named = lambda sign, part: F.concat_ws(":", F.concat(F.col("kind").cast("string"), F.lit(sign)), part)
    parts = (
        F.when(F.col("kind") == 0, F.array(named("l", F.substring_index("m", "@", 1)), named("d", F.substring_index("m", "@", -1))))
        .when(F.col("kind") == 1, F.array(named("n", F.substring_index("m", ".", 3))))
        .otherwise(F.array(named("n", F.col("m").substr(F.lit(1), F.length("m") - 4))))
    )
    entity = named("", F.col("m"))
    return each.select("_key", entity.alias("entity"), F.explode(F.concat(F.array(entity), parts)).alias("key"))


def _chance(both: Column, one: Column, other: Column, n: float) -> Column:
    """Logarithm of a bound (Chernoff) of the chance that sets of `one` and `other` out of n texts share `both` or more."""
    few, share = F.least(one, other).cast("double"), F.greatest(one, other) / F.lit(n)
    x = both / few
    rest = F.when(both < few, (1 - x) * F.ln((1 - x) / (1 - share))).otherwise(F.lit(0.0))
    return F.when(x > share, -few * (x * F.ln(x / share) + rest)).otherwise(F.lit(0.0))


def disclosures(terms: DataFrame, keys: DataFrame, n_texts: int, n_terms: int) -> DataFrame:
    """(term, entity, share): pairs whose mutual information is at least GENERALISE of the entity's information.

    terms: (_key, term, df_term). Pairs whose document frequencies alone rule out the share or the evidence aren't counted.
    """
    n, level = float(n_texts), F.lit(math.log(CHANCE / max(n_terms, 1)))
    df_key = keys.select("_key", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("df_key"))
    entities_ = keys.select("entity", "key").distinct().join(df_key.select(F.col("key").alias("entity"), F.log2(F.lit(n) / F.col("df_key")).alias("information")), "entity").where("information > 0")
    entities_ = materialize(entities_.join(df_key, "key"), "pii-entities")
    least = entities_.groupBy("key").agg(F.min("information").alias("least"), F.first("df_key").alias("df_key"))
    held = keys.select("_key", "key").distinct().join(least, "key")
    most = F.log2(F.lit(n) / F.greatest("df_term", "df_key"))
    own = F.contains("key", "term")
    possible = (most >= GENERALISE * F.col("least") - 1e-9) & (own | (_chance(F.least("df_term", "df_key"), F.col("df_term"), F.col("df_key"), n) <= level))
    together = terms.join(held, "_key").where(possible).groupBy("term", "key", "df_term").agg(F.count(F.lit(1)).alias("both"))
    scored = together.join(entities_, "key").where(own | (_chance(F.col("both"), F.col("df_term"), F.col("df_key"), n) <= level))
    mutual = F.log2(F.lit(n) * F.col("both") / (F.col("df_term").cast("double") * F.col("df_key")))
    # the last digits of a logarithm don't decide
    scored = scored.select("term", "entity", F.round(mutual / F.col("information"), 9).alias("share"))
    return scored.groupBy("term", "entity").agg(F.max("share").alias("share")).where(F.col("share") >= GENERALISE)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base (spans by kind and start), terms (spans of disclosing terms, by start), each with kind, start, end.

    Null text counts as empty. Terms are looked for in all of a text that holds an entity; one without has no spans. Copies
    of a text count once as evidence and get the same spans. Other columns are ignored; an empty table gives no rows.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = text.withColumn("base", entities(F.col("text")))
    # a text's digest stands for it; only texts with entities are kept beside it
    kept = F.when(F.size("base") > 0, F.col("text")).alias("text")
    hits = materialize(found.select("doc_id", F.unhex(F.sha2("text", 256)).alias("_key"), "base", kept), "pii-base")
    holding = hits.where("size(base) > 0")
    each = holding.select("_key", "text", "base").dropDuplicates(["_key"])
    keys = materialize(_keys(each), "pii-keys")
    words = text.select("text").distinct().select(F.explode(_terms(F.col("text"))).alias("term"))
    vocabulary = materialize(words.groupBy("term").agg(F.count(F.lit(1)).alias("df_term")), "pii-vocabulary")
    terms = materialize(each.select("_key", F.explode(_terms(F.col("text"))).alias("term")).join(vocabulary, "term"), "pii-terms")
    shares = materialize(disclosures(terms, keys, hits.select("_key").distinct().count(), vocabulary.count()), "pii-disclosures")
    holders = keys.select("_key", "entity").distinct()
    flagged = terms.join(shares, "term").join(holders, ["_key", "entity"], "left_semi").groupBy("_key", "term").agg((F.max("share") >= REMOVE).alias("gone"))
    words_of = lambda which: F.collect_list(F.when(which, F.col("term")))
    flagged = materialize(flagged.groupBy("_key").agg(words_of(F.lit(True)).alias("_words"), words_of(F.col("gone")).alias("_gone")), "pii-flagged")
    spans = find(F.col("text"), TERM, 4, lambda m: F.array_contains("_words", F.lower(m)))
    placed = holding.join(flagged, "_key").select("doc_id", "base", "text", "_gone", spans.alias("terms"))
    # a term inside an entity belongs to it
    placed = placed.withColumn("terms", F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
    inside = lambda t: F.lower(F.substring(F.col("text"), t["start"] + 1, t["end"] - t["start"]))
    placed = placed.select("doc_id", "base", "terms", F.transform("terms", lambda t: F.array_contains("_gone", inside(t))).alias("removed"))
    none = ["doc_id", "base", F.expr(f"cast(array() as {SPANS})").alias("terms"), F.expr("cast(array() as array<boolean>)").alias("removed")]
    bare = holding.join(flagged, "_key", "left_anti").select(*none)
    return placed.unionByName(bare).unionByName(hits.where("size(base) = 0").select(*none))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (identifiers unique) with `text` sanitised: entities become [KIND], generalised terms [TERM], removed ones nothing."""
    spans = personal_data(docs, id_col, text_col).withColumnRenamed("doc_id", "_id")
    cuts = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]")).alias("by"))),
        F.zip_with("terms", "removed", lambda s, r: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(r, "").otherwise("[TERM]").alias("by"))),
    ))
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = lambda acc, c: F.struct(F.when(c["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["by"])).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], c["end"]).alias("at"))
    clean = F.aggregate(cuts, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    joined_ = docs.join(spans, docs[id_col] == spans["_id"], "left")
    return joined_.withColumn("_clean", F.when(F.col("_id").isNull() | docs[text_col].isNull(), docs[text_col]).otherwise(clean)).select(*[F.col("_clean").alias(text_col) if c == text_col else docs[c] for c in docs.columns])


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of personal_data()."""
    base = F.col("base")
    return found.select(
        "doc_id", *[count(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("terms")), KINDS).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
