"""The engine's inputs as views of general tables: references from documents, hits from lineitem, counts from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A to Z as A, C, G, T in turn; N stays.
BASES = "".join("N" if x == "N" else "ACGT"[i % 4] for i, x in enumerate(LETTERS))
#: Places of a vector in the embeddings, and bounds of the values that stand for the four bases.
WIDTH, BOUNDS = 64, (-0.125, 0.0, 0.125)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def dna(text: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "[^A-Za-z]", "N")), LETTERS, BASES)


def refs(spark: SparkSession, d: str) -> DataFrame:
    """One reference row per document."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("_l"), "quality", "toxic")
    docs = table(spark, d, "documents")
    both = docs.join(labels, docs["doc_id"] == labels["_l"], "left")
    i = F.col("doc_id")
    flag = (
        F.when(F.col("_l").isNull() | ((F.col("quality") == 1) & (F.col("toxic") == 0)), "pass")
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), "contaminant")
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), "manual_review_needed")
        .otherwise("contaminant|manual_review_needed")
    )
    genus = F.concat(F.lit("Genus"), _text(i % 9))
    return both.select(
        i.alias("row_ord"), F.concat(F.lit("seq_"), _text(i)).alias("unique_code"), F.concat(F.lit("ACC"), _text(i)).alias("sequence_id"), "source",
        F.concat(genus, F.lit(" sp"), _text(i % 45)).alias("species"), genus.alias("genus"), F.concat(F.lit("Fam"), _text(i % 3)).alias("family"),
        F.when(i % 7 == 0, None).when(i % 11 == 0, "").otherwise("OrderA").alias("order"), F.lit("ClassA").alias("class"), F.when(i % 13 != 0, "PhylumA").alias("phylum"), F.lit("KingdomA").alias("kingdom"),
        F.when(F.col("lang") == "en", "COI").when(F.col("lang") == "fr", "12S").when(F.col("lang") == "de", "16S").otherwise("genome").alias("seq_type"),
        F.when(i % 4 == 0, "introduced").otherwise("native").alias("occurrence"), F.lit("f").alias("habitat"), flag.alias("qc_flag"), dna(F.col("text")).alias("sequence"),
    )


def asvs(spark: SparkSession, d: str, every: int = 1) -> DataFrame:
    """All references and benchmark texts as ASVs. every: of the references only those whose number it divides, as queries of a search."""
    own = refs(spark, d).where(F.col("row_ord") % every == 0).select(F.concat(F.lit("ASV_"), _text("row_ord")).alias("asv_id"), "sequence", F.col("row_ord").alias("ord"))
    bench = table(spark, d, "benchmark").select(F.concat(F.lit("BENCH_"), _text("item_id")).alias("asv_id"), dna(F.col("text")).alias("sequence"), (F.col("item_id") + 1_000_000_000).alias("ord"))
    return own.unionByName(bench)


def hits(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("ASV_"), _text(F.col("l_orderkey") % 4000)).alias("asv_id"), F.concat(F.lit("Sp"), _text(s % 20)).alias("species"), F.concat(F.lit("Gen"), _text(s % 5)).alias("genus"), F.concat(F.lit("Fam"), _text(s % 2)).alias("family"),
        (F.lit(95.0) + F.col("l_partkey") % 6).alias("pident"), (F.lit(0.6) + F.lit(0.2) * (F.col("l_linenumber") % 3)).alias("qcov"), F.lit(0.9).alias("scovs"), F.lit(1e-50).alias("evalue"), (F.lit(100.0) + s % 4).alias("bitscore"), F.lit(1.5).alias("bitscore_pb"),
    )
    return rows.withColumn("ccovs", F.sqrt(F.col("qcov") * F.col("scovs")))


def blast_tab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("ASV_"), _text("l_orderkey")).alias("asv_id"), F.concat(F.lit("seq_"), _text("l_partkey")).alias("subject_id"), F.col("l_linenumber").alias("n"),
        F.col("l_quantity").cast("double").alias("length"), F.lit(50.0).alias("qlen"), F.lit(60.0).alias("slen"), (F.lit(100.0) + F.col("l_suppkey") % 4).alias("bitscore"),
    )


def event_types(spark: SparkSession, d: str) -> list[str]:
    """The sample columns. A handful of values, read from one column."""
    return sorted(r[0] for r in table(spark, d, "events").select("event_type").distinct().collect())


def asv_counts(spark: SparkSession, d: str, samples: list[str]) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("ASV_"), _text("user_id")).alias("asv_id"), "event_type")
    return e.groupBy("asv_id").agg(*[F.count_if(F.col("event_type") == s).alias(s) for s in samples])


DESCRIPTIONS = (
    "12S ribosomal RNA gene, partial sequence", "mitochondrion, complete genome", "tRNA-Phe gene, 12S ribosomal RNA gene, and tRNA-Val gene, complete sequence", "cytochrome c oxidase subunit I (COI) gene, partial cds",
    "16S rRNA and 12S rRNA genes for ribosomal RNA", "cytb gene, complete cds; COX1 complete", "isolate X voucher", "MT-RNR2 complete",
)


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    which = F.element_at(F.array(*map(F.lit, DESCRIPTIONS)), (F.col("p_size") % len(DESCRIPTIONS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", which).alias("description"))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of one width: a row per embedding, a base per place of the whole vector; its label is the species."""
    low, middle, high = BOUNDS
    base = lambda x: F.when(x < low, "A").when(x < middle, "C").when(x < high, "G").otherwise("T")
    rows = table(spark, d, "embeddings").where("embedding is not null and label is not null")
    i, genus = F.col("vec_id"), F.concat(F.lit("Genus"), _text(F.col("label") % 3))
    marker = F.when(i % 4 == 0, "COI").when(i % 4 == 1, "12S").when(i % 4 == 2, "16S").otherwise("genome")
    return rows.select(i.alias("row_ord"), F.concat(F.lit("vec_"), _text(i)).alias("unique_code"), F.concat(genus, F.lit(" sp"), _text("label")).alias("species"), genus.alias("genus"), marker.alias("marker"), F.array_join(F.transform("embedding", base), "").alias("aligned"))


def numts(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts, whole, which some documents hold."""
    return table(spark, d, "benchmark").select(dna(F.col("text")).alias("sequence"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    """refs as quality checks name their columns: gene, with genomes as complete_genome and every 17th as other."""
    r = refs(spark, d).withColumn("gene", F.when(F.col("row_ord") % 17 == 0, "other").when(F.col("seq_type") == "genome", "complete_genome").otherwise(F.col("seq_type")))
    return r.drop("seq_type", "qc_flag")
