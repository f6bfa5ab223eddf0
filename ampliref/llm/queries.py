"""Queries opN_<name>: thin views of the operators over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliref.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampliref.llm.wrappers import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampliref.llm import pii

    return pii.report(pii.personal_data(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampliref.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampliref.llm.minhash import near_duplicates

    # n_links says which links were verified on the way, which the result doesn't depend on
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampliref.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampliref.llm import secret_scan

    return secret_scan.report(secret_scan.secrets(table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampliref.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampliref.llm.spotsigs import edit_report

    return edit_report(table(spark, sf_dir, "documents"))


def spotsigs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal fingerprints and links between classes, by length classes and pruned Jaccard."""
    from ampliref.llm.spotsigs import links

    return links(table(spark, sf_dir, "documents"), at_least=0.8)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampliref.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampliref.llm.pieces import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_wrappers, op2_pii, op3_quality, op4_minhash_neardup, op5_token_counts, op6_secrets, op7_mixing, op8_spotsigs, op9_exact_dedup, op10_pieces, spotsigs_links)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    # every pair of sets that share a shingle, and the closure of their links
    "op4_minhash_neardup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        near AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS norm FROM documents)""",
}
