"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

Two permutations give all coordinates: sigma scatters a document's shingles over a ring of RING places, and coordinate k
is the least value of pi, circularly shifted by k, over those places. Shingle sets that are equal count once. Bands of
coordinates make buckets; within a bucket documents are verified against a centre, the member that shares most buckets
with others, which makes most groups one class at once. Where members of a bucket are still in different classes, their
sketches are compared in blocks, and likely pairs verified too. Links hold on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliref.llm.common import alone, chunks, materialize

#: Coordinates by bands: at Jaccard 0.85 a pair meets in no band with probability (1 - 0.85**6)**40 = 6e-9, at 0.8 in 5e-6.
ROWS, BANDS = 6, 40
RING = 1 << 20
#: Bits of the filter that spares texts which no candidate pair needs; its size doesn't depend on the data.
FILTER_BITS = 1 << 26
WORD_CACHE = 100_000
#: Members of a bucket that are compared at once, and how far below the wanted likeness sketches may agree.
BLOCK_ROWS, MARGIN = 1024, 0.13
#: Bits of a set's parity sketch. Two sketches never differ in more places than their sets do in shingles.
PARITY_BITS = 4096
_BLOCK = 4096  # shingles hashed at once
#: Rows that a task may take before more tasks and files are worth their cost: of a few numbers, with a text's bands, and
#: rows of blocks, of which many likely pairs may come. A table with few rows thus makes few files, one with many as many as the shuffle has.
NARROW_ROWS, WIDE_ROWS, PAIR_ROWS = 50_000, 5_000, 2_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; the whole sequence is one if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(alone(_WORDS).__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, len(h) if len(h) < width else width, np.uint64)
        for k in range(min(width, len(h))):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def _ring() -> np.ndarray:
    """Rows p = pi[p], pi[p + 1], ... of the circularly shifted permutation."""
    pi = np.random.default_rng(20240229).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: ROWS * BANDS]]), ROWS * BANDS)


_RING: list[np.ndarray] = []


def signature(sh: np.ndarray) -> np.ndarray:
    """The ROWS * BANDS coordinates of a set of shingle hashes."""
    if not _RING:
        _RING.append(_ring())
    place = (_mix(sh + np.uint64(0x5851F42D4C957F2D)) % np.uint64(RING)).astype(np.int64)  # sigma
    least = None
    for i in range(0, len(place), _BLOCK):
        block = _RING[0][place[i : i + _BLOCK]].min(axis=0)
        least = block if least is None else np.minimum(least, block)
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        with np.errstate(over="ignore"):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def parity(sh: np.ndarray) -> np.ndarray:
    """A set's parity sketch: for each place, whether an odd number of shingles fall there."""
    place = (_mix(sh + np.uint64(0xD6E8FEB86659FD93)) % np.uint64(PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=PARITY_BITS) & 1).astype(np.uint8))


def _sized(df: DataFrame, rows: int, a_task: int) -> DataFrame:
    """df, which has at most so many rows, in no more partitions than it needs."""
    return df.coalesce(max(1, -(-rows // a_task)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id), n_links.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct shingles of `width`
    words, or the whole sequence where there are fewer. Two documents are linked when 100 * |A & B| >= percent * |A | B|.
    component_id is the smallest doc_id reachable. n_links counts links that were verified from the document's set to
    other sets, plus rows with an equal set. Null or empty texts have an empty set and no links; repeated rows form one
    component; a null doc_id is passed through unlinked. Other columns are ignored; an empty table gives no rows.
    percent must be at least 70, which the bands are made for.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must be from 70 to 100")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n, digest, keys = [], [], []
            for text in batch.column(1).to_pylist():
                sh = shingles(text, width)
                n.append(len(sh))
                digest.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest() if len(sh) else None)
                keys.append(bands(signature(sh)) if len(sh) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "same", "bands"])

    sketched = materialize(rows.mapInArrow(sketch, "doc_id long, n long, same binary, bands array<long>"), "minhash-sketch")
    # documents with equal sets count once, as the smallest of them
    equal = sketched.where("n > 0 and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialize(_sized(equal, sketched.count(), WIDE_ROWS), "minhash-sets")
    links = _links(reps, rows, width, percent)
    labels = components(links, "a", "b")
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("found"))
    classes = (
        reps.select("same", "rep", "copies").join(labels.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
        .select("same", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    own = sketched.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same"))
    # rows without a set must not meet in one task
    own = own.withColumn("same", F.coalesce("same", F.concat(F.lit(b"-"), F.col("doc_id").cast("string").cast("binary")), F.lit(b"-")))
    return own.join(classes, "same", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("class_id", "doc_id"), F.lit(True)).alias("kept"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def _links(reps: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified pairs (a, b) of representatives: enough of them to join all members of each bucket that belong together."""
    spark = reps.sparkSession
    spread = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = materialize(_sized(spread.join(shared, "bucket"), reps.count() * BANDS, NARROW_ROWS), "minhash-met")
    n_met = met.count()  # stars, labels and what is left have no more rows
    narrow = lambda df, tag: materialize(_sized(df, n_met, NARROW_ROWS), tag)
    hub = met.groupBy("rep").agg(F.sum("members").alias("hub"))
    met = narrow(met.join(hub, "rep").select("bucket", "rep", "n", "members", "hub"), "minhash-buckets")
    if not n_met:
        return spark.createDataFrame([], "a long, b long")
    sets = _sets(met, rows, width)
    ratio = lambda m, n: 100 * F.least(m, n) >= percent * F.greatest(m, n)  # noqa: E731  no pair beyond it can be linked
    # the member that shares most buckets stands in the middle of its group
    centre = met.groupBy("bucket").agg(F.min_by(F.struct(F.col("rep").alias("centre"), F.col("n").alias("m"), F.col("hub").alias("height")), F.struct(-F.col("hub"), F.col("rep"))).alias("c")).select("bucket", "c.*")
    stars = met.join(centre, "bucket").where((F.col("rep") != F.col("centre")) & ratio(F.col("n"), F.col("m")))
    ordered = lambda df: df.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    # first the one centre that stands highest among those of a document's buckets, then those of classes that it isn't in
    best = stars.groupBy("rep").agg(F.min_by("centre", F.struct(-F.col("height"), F.col("centre"))).alias("centre"))
    pairs = narrow(ordered(best), "minhash-pairs")
    links = materialize(_verified(pairs, sets, percent), "minhash-links")
    labels = components(links, "a", "b").withColumnRenamed("id", "rep")
    own = labels.select(F.col("rep").alias("centre"), F.col("label").alias("above"))
    apart = stars.join(labels, "rep", "left").join(own, "centre", "left").where(F.coalesce("label", "rep") != F.coalesce("above", "centre"))
    other = narrow(ordered(apart).join(pairs, ["a", "b"], "left_anti"), "minhash-pairs")
    pairs = pairs.unionByName(other)
    links = materialize(links.unionByName(_verified(other, sets, percent)), "minhash-links")
    labels = components(links, "a", "b").withColumnRenamed("id", "rep")
    # buckets whose members are not one class yet
    labelled = narrow(met.join(labels, "rep", "left").select("bucket", "rep", "n", F.coalesce("label", "rep").alias("label")), "minhash-labelled")
    state = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high and members > 2")
    left = narrow(labelled.join(state.select("bucket", "members"), "bucket"), "minhash-left")
    if left.isEmpty():
        return links
    n_left = max(left.count() * NARROW_ROWS // PAIR_ROWS, pairs.count())
    more = materialize(_sized(_likely(left, sets, percent).join(pairs, ["a", "b"], "left_anti"), n_left, NARROW_ROWS), "minhash-more")
    return narrow(links.unionByName(_verified(more, sets, percent)).distinct(), "minhash-links")


def _likely(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different classes in a bucket whose sketches agree well enough, of all that the bucket has.

    Members of a bucket are compared by one byte of each coordinate, block against block where there are more than
    BLOCK_ROWS, so neither a task nor the shuffle holds more than the members; only likely pairs are given out. A linked
    pair falls MARGIN short, five standard deviations or more, less than once in 10**6. Parity sketches then drop pairs
    whose sets must differ in more shingles than a link allows; they never drop a linked one.
    """
    wanted = left.select("rep").distinct()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column(1).to_pylist():
                sh = np.asarray(s, np.int64).view(np.uint64)
                sig = signature(sh)
                out.append(sig.astype(np.uint8).tobytes() + bands(sig).tobytes() + parity(sh).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rep", "sig"])

    sigs = sets.join(wanted, "rep", "left_semi").select("rep", "set").mapInArrow(sketch, "rep long, sig binary")
    dealt = left.join(sigs, "rep").withColumn("blocks", F.ceil(F.col("members") / BLOCK_ROWS).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") != F.least("own", "other")).cast("int").alias("side"), "rep", "n", "label", "sig")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "rep")
    least = int(np.floor(ROWS * BANDS * (percent / 100 - MARGIN)))

    def compare(bucket: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        side, rep, n, label = (np.array([r[k] for r in rows]) for k in range(4))
        both = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        sig, keys, odd = (np.ascontiguousarray(x) for x in np.split(both, [ROWS * BANDS, (ROWS + 8) * BANDS], axis=1))
        keys, odd = keys.view(np.int64), odd.view(np.uint64)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        inner = not len(two)
        two = one if inner else two
        a, b = [], []
        for x in one:
            y = two[two > x] if inner else two
            y = y[(label[y] != label[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            # |A ^ B| = |A | B| - |A & B| <= (100 - percent) / (100 + percent) * (|A| + |B|) for a linked pair
            y = y[(100 + percent) * np.bitwise_count(odd[y] ^ odd[x]).sum(1, dtype=np.int64) <= (100 - percent) * (n[y] + n[x])]
            y = y[(sig[y] == sig[x]).sum(1) >= least]
            # a pair is given out in the first of the buckets that it shares
            y = y[keys[x][(keys[y] == keys[x]).argmax(1)] == bucket]
            a.append(np.full(len(y), rep[x]))
            b.append(rep[y])
        return np.concatenate([*a, rep[:0]]), np.concatenate([*b, rep[:0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, i, j = None, [], -1, -1
        for batch in batches:
            out = []
            for bucket, bi, bj, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, bi, bj) != key:
                    if rows and (i == j or rows[-1][0]):
                        out.append(compare(key[0], rows))
                    key, rows, i, j = (bucket, bi, bj), [], bi, bj
                rows.append(row)
            if out:
                yield _pairs(out)
        if rows and (i == j or rows[-1][0]):
            yield _pairs([compare(key[0], rows)])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (np.concatenate([o[k] for o in out]).astype(np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _sets(met: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(rep, set) of the representatives that share a bucket. A bit filter keeps other texts from being hashed again."""
    wanted = met.select("rep").distinct()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = (_mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(bits)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(bits[part].astype(np.int32))], names=["place", "byte"])

    filled = wanted.mapInArrow(fill, "place int, byte int").groupBy(F.expr("place div 1024").alias("page")).agg(F.collect_list(F.struct("place", "byte")).alias("bytes"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cells in batch.column(1).to_pylist():
                page = np.zeros(1024, np.uint8)
                for c in cells:
                    page[c["place"] % 1024] |= c["byte"]
                out.append(page.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page", "bits"])

    bits = bytearray(FILTER_BITS // 8)  # 8 MB, whatever the data
    for page, cells in filled.mapInArrow(pack, "page long, bits binary").toLocalIterator():
        bits[page * 1024 : (page + 1) * 1024] = cells
    shared = rows.sparkSession.sparkContext.broadcast(bytes(bits))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(shared.value, np.uint8)
        for batch in chunks(batches):
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            at = (_mix(ids.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            batch = batch.filter(pa.array((have[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            sets = [shingles(t, width).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "set"])

    made = rows.where("doc_id is not null").mapInArrow(hashed, "rep long, set array<long>")
    # of rows that repeat an identifier with other texts any has the set of that representative or none
    return materialize(made.join(wanted, "rep", "left_semi"), "minhash-full")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked. Only the sets that they name are shuffled, and by as many tasks as any shuffle has."""
    named = lambda c: sets.join(pairs.select(F.col(c).alias("rep")).distinct(), "rep", "left_semi")
    left, right = named("a").select(F.col("rep").alias("a"), F.col("set").alias("sa")), named("b").select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union: Column = F.size("sa") + F.size("sb") - both
    found = pairs.join(left, "a").join(right, "b").where(100 * both >= percent * union).select("a", "b").distinct()
    # a shuffle of two numbers a link; coalesce() would have few tasks read all sets
    return found.repartition(max(1, -(-pairs.count() // NARROW_ROWS)))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, label) of every linked id: the smallest id reachable. Rounds of least label among neighbours, then of the label's label."""
    pairs = links.select(F.col(left).alias("x"), F.col(right).alias("y"))
    n = 2 * links.count()
    write = lambda df, tag: materialize(_sized(df, n, NARROW_ROWS), tag)
    edges = write(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "components-edges")
    labels = write(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "id"), "components-labels")
    while True:
        near = edges.join(labels, edges["x"] == labels["id"]).groupBy(F.col("y").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.select(F.col("id").alias("label"), F.col("label").alias("above"))
        new = write(step.join(up, "label").select("id", "old", F.least("label", "above").alias("label")), "components-labels")
        labels = new.select("id", "label")
        if new.where("old != label").isEmpty():
            return labels


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates() keeps: of each class the document with the smallest identifier."""
    kept = near_duplicates(docs, width, percent).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]), "left_semi").select(*docs.columns)
