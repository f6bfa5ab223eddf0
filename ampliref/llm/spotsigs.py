"""Document fingerprints by SpotSigs: chains of content words that follow common words.

A common word is an anchor, and so is the beginning of a line that has words; the next CHAIN content words after it,
passing over other anchors, form a signature with it, filled up by an end mark where the text is over. The fingerprint of a
text is its multiset of signatures, written as sorted hexadecimal hashes of signature and occurrence; likeness is the
Jaccard of two. One definition holds for all texts, so tables, shouting and other languages, which lack the common words,
have the signatures of their lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliref.llm.common import alone, chunks, materialize
from ampliref.llm.minhash import _mix

# Articles and forms of "to be" and "to have", by language.
ANCHORS = {
    "en": "a an the is are was were be been has have had to of and that it in by with for on at this",
    "de": "der die das den dem des ein eine einen einem einer ist sind war waren und zu im auf mit für nicht sich",
    "es": "el la los las un una unos unas es son era eran ha han de que y en con por para se del al",
    "fr": "le la les un une des du de est sont était ont et que qui dans en pour par sur au aux avec",
}
CHAIN = 2
#: Stands for the beginning of a line among words.
LINE = "\n"
_END = np.uint64(0x7F4A7C15)
WORD_CACHE = 300_000
#: Sets that meet at one signature of a length class in one task, from either side; more are dealt out in blocks.
MEET_ROWS = 4096
_STRIP = " \t\r\n.,;:!?()[]{}\"'|*&%$#<>-–—…"


class Words(dict):
    """Word -> (32-bit hash, 1 if an anchor or 0, or -1 for no word at all); bounded."""

    anchors = frozenset(w for words in ANCHORS.values() for w in words.split())

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        bare = word.strip(_STRIP).lower() if word != LINE else word
        out = self[word] = (xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) >> 32, -1 if not bare else int(bare == LINE or bare in self.anchors))
        return out


_WORDS = Words()


def signatures(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text; empty only for texts without a character other than white space."""
    words: list[str] = []
    for line in (text or "").split("\n"):
        if found := line.split():
            words.append(LINE)
            words += found
    flat = np.array(list(map(alone(_WORDS).__getitem__, words)), np.int64).reshape(-1, 2)
    flat = flat[flat[:, 1] >= 0]
    h, anchor = flat[:, 0].astype(np.uint64), flat[:, 1] == 1
    follow = np.r_[h[~anchor], np.full(CHAIN, _END)]
    at = np.flatnonzero(anchor)
    # the content words before an anchor tell where its chain begins
    start, out = at - np.arange(len(at)), h[at]
    with np.errstate(over="ignore"):
        for k in range(CHAIN):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + follow[np.minimum(start + k, len(follow) - 1)])
    return _numbered(out >> np.uint64(32)).astype(np.uint32)


def _numbered(chains: np.ndarray) -> np.ndarray:
    """The set that stands for a multiset: each chain with the number of its occurrence."""
    chains = np.sort(chains)
    first = np.r_[True, chains[1:] != chains[:-1]][: len(chains)]
    nth = np.arange(len(chains)) - np.maximum.accumulate(np.where(first, np.arange(len(chains)), 0)) if len(chains) else chains
    return np.unique(np.where(nth == 0, chains, _mix(chains + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)))


def fingerprint(sig: np.ndarray) -> str:
    """Eight hexadecimal digits a signature, sorted."""
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard of two sorted sets, 1 for two empty ones; 0 at once where their lengths alone rule out at_least."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_signatures, fingerprint. Null text counts as empty (fingerprint '')."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sigs = [signatures(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sigs], pa.int64()), pa.array([fingerprint(s) for s in sigs], pa.string())], names=["doc_id", "n_signatures", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, n_signatures long, fingerprint string")


def similar_pairs(prints: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of distinct fingerprints, each as its smallest doc_id, with likeness >= at_least; plus (a, a, 1)
    for none. Fingerprints are partitioned by set length: lengths fall into classes of ratio at_least, and a set is
    compared with those of its own and the next class. Within them only sets that share one of their first
    n - ceil(at_least * n) + 1 signatures, rarest first, meet; where many do, in blocks of MEET_ROWS by MEET_ROWS, a task
    each. Membership of copies: links(). Null identifiers are left out, repeated rows count once, no rows give no pairs.
    """
    if not 0 < at_least <= 1:
        raise ValueError("at_least must be above 0 and at most 1")
    reps = materialize(prints.where("fingerprint != '' and doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "spotsigs-sets")
    sets = reps.select("id", F.expr("transform(sequence(0, cast(length(fingerprint) div 8 - 1 as int)), i -> substring(fingerprint, i * 8 + 1, 8))").alias("sigs"))
    sets = sets.withColumn("n", F.size("sigs"))
    each = sets.select("id", "n", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(rarity, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    keep = F.col("n") - F.ceil(F.col("n") * at_least - 1e-9).cast("int") + 1
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(at_least)) if at_least < 1 else 1e-9)).cast("long") if at_least < 1 else F.col("n").cast("long")
    first = materialize(ordered.select("id", "n", size_class.alias("class"), F.explode(F.slice("by_df", F.lit(1), keep)).alias("s")).select("id", "n", "class", F.col("s.sig").alias("sig"), F.col("s.df").alias("df")).where("df > 1").drop("df"), "spotsigs-prefixes")
    x = first.select("sig", F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    y = first.select("sig", F.col("id").alias("b"), F.col("n").alias("nb"), "class")
    # x has all of y's sets and those of the class below; only what many share is dealt out
    many = x.groupBy("sig", "class").agg(F.ceil(F.count(F.lit(1)) / MEET_ROWS).cast("int").alias("parts")).where("parts > 1")
    deal = lambda side, who, own, other: side.join(many, ["sig", "class"], "left").withColumns({own: F.pmod(F.xxhash64(who), F.coalesce("parts", F.lit(1))).cast("int"), other: F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))}).drop("parts")
    x, y = deal(x, "a", "i", "j"), deal(y, "b", "j", "i")
    longer = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") > F.col("a")))
    met = x.join(y, ["sig", "class", "i", "j"]).where(longer & (F.col("na") >= at_least * F.col("nb") - 1e-9)).select("a", "b").distinct()
    full = met.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    like = both / (F.size("sa") + F.size("sb") - both)
    return full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), like.alias("likeness")).where(F.col("likeness") >= at_least - 1e-12)


def links(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Per row of docs: doc_id, n_signatures, class_id, n_links. class_id is the smallest doc_id whose fingerprint is the
    same, and n_links says how many other classes have a likeness of at_least or more with it. A row without signatures
    or without an identifier is a class of its own with no links; no rows give no rows."""
    prints = materialize(fingerprints(docs).withColumn("key", F.sha2("fingerprint", 256)), "spotsigs-prints")
    pairs = materialize(similar_pairs(prints.drop("key"), at_least), "spotsigs-pairs")
    each = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    classes = prints.where("fingerprint != '' and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("class_id")).join(each, "class_id", "left")
    # a class may have a third of all rows; its own table has one, so the side of the rows can be split by the runtime
    found = prints.select("doc_id", "n_signatures", F.when(F.col("doc_id").isNotNull() & (F.col("fingerprint") != ""), F.col("key")).alias("key")).join(classes, "key", "left")
    return found.select("doc_id", "n_signatures", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


#: Documents that one bucket of the order by doc_id holds, about, and buckets for each shuffle partition of the session, which
#: says how many tasks its data needs.
BUCKET_DOCS, PARTITION_BUCKETS = 1000, 16


def with_next(docs: DataFrame, kernel, schema: str) -> DataFrame:
    """Runs kernel over (doc_id, text, next text) tuples, next being the following row by descending doc_id, then text
    digest; after the last comes the first. Rows are cut into buckets of consecutive identifiers; each bucket also gets
    the first row of the one that follows, so a bucket is all that a task needs."""
    from pyspark.ml.feature import Bucketizer

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    stats = rows.agg(F.count(F.lit(1)).alias("n")).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = max(1, min(PARTITION_BUCKETS * parts, -(-stats["n"] // BUCKET_DOCS)))
    # null identifiers come last, as the lowest
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cuts = sorted(set(rows.agg(F.percentile_approx(key, [i / k for i in range(1, k)], 10 * k)).first()[0])) if k > 1 else []
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol="_key", outputCol="_b").transform(rows.withColumn("_key", key.cast("double")))
        placed = placed.withColumn("bucket", (F.lit(len(splits)) - F.col("_b")).cast("int")).drop("_key", "_b")
    else:
        placed = rows.withColumn("bucket", F.lit(0))
    # the first row of each bucket: as many rows as buckets
    heads = sorted((r["bucket"], r["top"]) for r in placed.groupBy("bucket").agg(F.max(key).alias("top")).collect())
    after = docs.sparkSession.createDataFrame([(top, heads[i - 1][0]) for i, (_, top) in enumerate(heads)], "top long, target int")
    halo = rows.where(key.isin([top for _, top in heads])) if heads else rows.limit(0)
    halo = halo.join(F.broadcast(after), key == F.col("top")).select("doc_id", "text", F.col("target").alias("bucket"), F.lit(1).alias("halo"))
    # of rows that share the first identifier only the first is a neighbour
    halo = halo.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "text"), F.sha2("text", 256)).alias("h")).select("h.doc_id", "h.text", "bucket", F.lit(1).alias("halo"))
    both = placed.select("doc_id", "text", "bucket", F.lit(0).alias("halo")).unionByName(halo)
    dealt = both.repartition(k, "bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), F.sha2("text", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in chunks(batches):
            ready = []
            for doc_id, text, bucket, extra in zip(*(c.to_pylist() for c in batch.columns)):
                if before is not None and before[2] == bucket:
                    ready.append((before[0], before[1], text))
                before = None if extra else (doc_id, text, bucket)
            if ready:
                yield kernel(ready)

    return dealt.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def edit_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def kernel(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        last: tuple[str, np.ndarray] = ("", signatures(""))
        for doc_id, text, following in rows:
            own = last[1] if text == last[0] else signatures(text)
            changed = edited(text, following)
            other, last = signatures(changed), (following, signatures(following))
            out.append((doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, last[1])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return with_next(docs, kernel, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
