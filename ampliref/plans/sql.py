"""DuckDB SQL with the rows of the queries."""

from __future__ import annotations

from ampliref.functions.markers import MARKER_PATTERNS, MULTI_GENE, OTHER_GENE
from ampliref.plans.views import BASES, BOUNDS, DESCRIPTIONS, LETTERS, WIDTH

CLEAN = "upper(regexp_replace({}, '\\s+', '', 'g'))"
DNA = f"translate(upper(regexp_replace(regexp_replace({{}}, '\\s+', '', 'g'), '[^A-Za-z]', 'N', 'g')), '{LETTERS}', '{BASES}')"

VIEWS = {
    "refs": f"""SELECT d.doc_id AS row_ord, 'seq_' || d.doc_id AS unique_code, 'ACC' || d.doc_id AS sequence_id, d.source,
        'Genus' || (d.doc_id % 9) || ' sp' || (d.doc_id % 45) AS species, 'Genus' || (d.doc_id % 9) AS genus, 'Fam' || (d.doc_id % 3) AS family,
        CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 11 = 0 THEN '' ELSE 'OrderA' END AS "order", 'ClassA' AS class,
        CASE WHEN d.doc_id % 13 <> 0 THEN 'PhylumA' END AS phylum, 'KingdomA' AS kingdom,
        CASE d.lang WHEN 'en' THEN 'COI' WHEN 'fr' THEN '12S' WHEN 'de' THEN '16S' ELSE 'genome' END AS seq_type,
        CASE WHEN d.doc_id % 4 = 0 THEN 'introduced' ELSE 'native' END AS occurrence, 'f' AS habitat,
        CASE WHEN l.doc_id IS NULL OR (quality = 1 AND toxic = 0) THEN 'pass' WHEN quality = 1 THEN 'contaminant' WHEN toxic = 0 THEN 'manual_review_needed' ELSE 'contaminant|manual_review_needed' END AS qc_flag,
        {DNA.format('d.text')} AS sequence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "asvs": f"""SELECT 'ASV_' || row_ord AS asv_id, sequence, row_ord AS ord FROM refs
        UNION ALL SELECT 'BENCH_' || item_id, {DNA.format('text')}, item_id + 1000000000 FROM benchmark""",
    "hits": """SELECT *, sqrt(qcov * scovs) AS ccovs FROM (SELECT 'ASV_' || (l_orderkey % 4000) AS asv_id, 'Sp' || (l_suppkey % 20) AS species, 'Gen' || (l_suppkey % 5) AS genus, 'Fam' || (l_suppkey % 2) AS family,
        95.0::double + l_partkey % 6 AS pident, 0.6::double + 0.2::double * (l_linenumber % 3) AS qcov, 0.9::double AS scovs, 1e-50::double AS evalue, 100.0::double + l_suppkey % 4 AS bitscore, 1.5::double AS bitscore_pb FROM lineitem)""",
    "aligned": f"""SELECT vec_id AS row_ord, 'vec_' || vec_id AS unique_code, 'Genus' || (label % 3) || ' sp' || label AS species, 'Genus' || (label % 3) AS genus,
        CASE vec_id % 4 WHEN 0 THEN 'COI' WHEN 1 THEN '12S' WHEN 2 THEN '16S' ELSE 'genome' END AS marker,
        array_to_string(list_transform(embedding, lambda x: CASE WHEN x < {BOUNDS[0]} THEN 'A' WHEN x < {BOUNDS[1]} THEN 'C' WHEN x < {BOUNDS[2]} THEN 'G' ELSE 'T' END), '') AS aligned FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL""",
    "numts": f"SELECT DISTINCT {DNA.format('text')} AS numt FROM benchmark",
    "genes": "SELECT *, CASE WHEN row_ord % 17 = 0 THEN 'other' WHEN seq_type = 'genome' THEN 'complete_genome' ELSE seq_type END AS gene FROM refs",
    "descriptions": f"SELECT p_partkey, p_name || ' ' || ([{', '.join(repr(x) for x in DESCRIPTIONS)}])[(p_size % {len(DESCRIPTIONS)} + 1)::int] AS description FROM part",
    "exact": f"""SELECT a.asv_id, r.species, r.genus, r.family, 100.0::double AS pident, 1.0::double AS qcov, 1.0::double AS scovs, 1.0::double AS ccovs, 0.0::double AS evalue, length(a.sequence)::double AS bitscore, 1.0::double AS bitscore_pb
        FROM asvs a JOIN refs r ON a.sequence = r.sequence WHERE r.qc_flag = 'pass'""",
}
_NEEDS = {"asvs": ["refs"], "genes": ["refs"], "exact": ["refs", "asvs"]}


def query(body: str, *views: str, **more: str) -> str:
    """body with the views it names, and what they need, in front."""
    order: list[str] = []
    for v in views:
        order += [x for x in [*_NEEDS.get(v, []), v] if x not in order]
    parts = [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def scored(hits: str, min_identity: float, min_coverage: float, tolerance: float) -> str:
    """score_assignments over a view."""
    same = " AND ".join(f"h.{m} = b.{m}" for m in ("bitscore_pb", "evalue", "ccovs", "pident"))
    metrics = ", ".join(f"any_value(b.{m}) AS {m}" for m in ("pident", "qcov", "scovs", "ccovs", "evalue", "bitscore", "bitscore_pb"))
    names = ", ".join(f"string_agg(DISTINCT h.{c}, '|' ORDER BY h.{c}) AS {c}" for c in ("species", "genus", "family"))
    return f"""SELECT asv_id, species, genus, family, pident, qcov, scovs, ccovs, evalue, bitscore, bitscore_pb, n_best_species::int AS n_best_species, assignment_status,
        CASE WHEN assignment_status <> 'unique' THEN 'ambiguous' WHEN pident >= {min_identity} AND ccovs >= {min_coverage} THEN 'high' ELSE 'low' END AS confidence, CASE WHEN n_best_species > 1 THEN species END AS tie_taxa
        FROM (SELECT *, CASE WHEN n_best_species = 1 THEN 'unique' WHEN n_best_species > 1 AND n > 1 AND lo = hi THEN 'check_full_tie' ELSE 'ambiguous' END AS assignment_status
        FROM (SELECT h.asv_id, {names}, {metrics}, count(DISTINCT h.species) AS n_best_species, count(*) AS n, min(h.bitscore) AS lo, max(h.bitscore) AS hi
        FROM {hits} h JOIN (SELECT * FROM {hits} QUALIFY row_number() OVER (PARTITION BY asv_id ORDER BY bitscore DESC, bitscore_pb DESC, evalue, ccovs DESC, pident DESC, qcov DESC, scovs DESC) = 1) b
        ON h.asv_id = b.asv_id AND h.bitscore >= b.bitscore - {tolerance} AND {same} GROUP BY h.asv_id))"""


def assigned() -> str:
    """with_missing over exact hits."""
    rest = "species, genus, family, pident, qcov, scovs, ccovs, evalue, bitscore, bitscore_pb"
    return f"""SELECT a.asv_id, {rest}, coalesce(n_best_species, 0)::int AS n_best_species, coalesce(assignment_status, 'no_match') AS assignment_status, coalesce(confidence, 'none') AS confidence, tie_taxa
        FROM asvs a LEFT JOIN ({scored('exact', 99, 0.9, 0)}) s ON a.asv_id = s.asv_id"""


def markers() -> str:
    """extract_markers over descriptions."""
    low = "lower(description)"
    any_ = f"CASE WHEN {low} LIKE '%partial%' THEN 'partial' WHEN {low} LIKE '%complete%' THEN 'complete' ELSE 'unknown' END"

    def near(p: str) -> str:
        p = f"(?:{p})"
        return f"CASE WHEN regexp_matches({low}, '{p}.*partial|partial.*{p}') THEN 'partial' WHEN regexp_matches({low}, '{p}.*complete|complete.*{p}') THEN 'complete' ELSE 'unknown' END"

    each = [f"CASE WHEN regexp_matches({low}, '{p}') THEN '{n}_' || {near(p)} END" for n, p in MARKER_PATTERNS] + [f"CASE WHEN regexp_matches({low}, '{OTHER_GENE}') THEN 'other_' || {any_} END"]
    several = f"concat_ws(';', {', '.join(each)})"
    single = " ".join(f"WHEN regexp_matches({low}, '{p}') THEN '{n}_' || {any_}" for n, p in MARKER_PATTERNS)
    return f"""CASE WHEN regexp_matches({low}, 'complete genome|mitochondrion, complete genome|mitogenome') THEN 'genome_complete'
        WHEN regexp_matches({low}, '{MULTI_GENE}') THEN CASE WHEN {several} <> '' THEN {several} ELSE 'other_unknown' END {single} ELSE 'other_unknown' END"""


def taxonomy(style: str) -> str:
    ranks = ["kingdom", "phylum", "class", '"order"', "family", "genus", "species"]
    parts = [f"'{p}__' || coalesce(nullif({r}, ''), 'unassigned')" if style == "rank_prefix" else f"coalesce(nullif({r}, ''), 'unassigned')" for p, r in zip("kpcofgs", ranks)]
    return "concat_ws(';', " + ", ".join(parts) + ")"


def codons() -> str:
    """check_codons over genes."""
    stops = "['TAA', 'TAG', 'AGA', 'AGG']"
    count = lambda f: f"len(list_filter(range(0, greatest((length(c) - {f}) // 3, 0)), lambda i: list_contains({stops}, substr(c, i * 3 + {f} + 1, 3))))"
    return f"""SELECT row_ord, least > 0 AS has_stop, n % 3 <> 0 OR least > 2 AS frameshifted, best_frame::int AS best_frame FROM
        (SELECT row_ord, n, list_min(k) AS least, list_position(k, list_min(k)) AS best_frame FROM (SELECT row_ord, length(c) AS n, [{count(0)}, {count(1)}, {count(2)}] AS k
        FROM (SELECT row_ord, regexp_replace(upper(sequence), '[^ACGT]', 'N', 'g') AS c FROM genes WHERE gene IN ('COI', 'complete_genome') AND length(sequence) >= 3)))"""


GAP_COLUMNS = ["max_intra", "min_inter", "gap_width", "p_overlap", "q_overlap", "median_intra", "median_inter", "intra_95", "inter_5", "percentile_gap", "min_congeneric", "congeneric_gap", "congeneric_p_overlap", "congeneric_q_overlap"]


def gap(columns: str | None = None, least: int = 5) -> str:
    """run_barcode_gap over aligned, without caps, doubles rounded; of species with at least so many rows."""
    four = {"p_overlap", "q_overlap", "congeneric_p_overlap", "congeneric_q_overlap"}
    out = ", ".join(f"round({c}, {4 if c in four else 9}) AS {c}" for c in GAP_COLUMNS)
    return query(
        f"""SELECT {columns or "species, marker, n_sequences, gap_exists, robust_gap, n_congeners_in_db, n_diagnostic_sites, sampling_adequacy, taxonomic_resolution, assignment_risk, recommended_threshold"}, {out} FROM
        (SELECT *, CASE WHEN gap_exists AND gap_width > 0.02 THEN 'low' WHEN gap_exists THEN 'moderate' ELSE 'high' END AS assignment_risk,
            round(greatest(quantile_cont(max_intra, 0.95) OVER (PARTITION BY marker) * 1.05, 0.97), 3) AS recommended_threshold,
            CASE WHEN gap_exists THEN 'species' WHEN coalesce(congeneric_gap > 0, false) THEN 'species (congener-supported)' ELSE 'genus_or_higher' END AS taxonomic_resolution,
            CASE WHEN n_sequences >= 20 AND n_congeners_in_db >= 3 THEN 'high' WHEN n_sequences >= 10 AND n_congeners_in_db >= 1 THEN 'moderate' ELSE 'low' END AS sampling_adequacy
        FROM (SELECT i.*, x.min_inter, x.median_inter, x.inter_5, x.min_inter - max_intra AS gap_width, max_intra < min_inter AS gap_exists, inter_5 - intra_95 AS percentile_gap, inter_5 - intra_95 > 0 AS robust_gap,
            list_count(list_filter(ds, lambda d: d > min_inter)) / len(ds)::double AS p_overlap, list_count(list_filter(xs, lambda d: d < max_intra)) / len(xs)::double AS q_overlap,
            min_congeneric, min_congeneric - max_intra AS congeneric_gap, CASE WHEN cs IS NOT NULL THEN list_count(list_filter(ds, lambda d: d > min_congeneric)) / len(ds)::double END AS congeneric_p_overlap,
            list_count(list_filter(cs, lambda d: d < max_intra)) / len(cs)::double AS congeneric_q_overlap, coalesce(n_diag, 0)::int AS n_diagnostic_sites
        FROM i JOIN x USING (marker, species) LEFT JOIN c USING (marker, species) LEFT JOIN diag USING (marker, species)))""",
        "aligned",
        a=f"SELECT * FROM aligned QUALIFY count(*) OVER (PARTITION BY marker, species) >= {least}",
        pairs="SELECT f.marker, f.species, o.species AS other, f.genus, o.genus AS ogenus, f.row_ord AS x, o.row_ord AS y, hamming(f.aligned, o.aligned) / 64.0::double AS d FROM a f JOIN a o ON f.marker = o.marker",
        s="SELECT marker, species, count(*)::int AS n_sequences, any_value(genus) AS genus FROM a GROUP BY ALL",
        g="SELECT marker, genus, count(DISTINCT species) - 1 AS n_congeners_in_db FROM a GROUP BY ALL",
        i="SELECT s.marker, s.species, s.n_sequences, g.n_congeners_in_db::int AS n_congeners_in_db, list(d) AS ds, max(d) AS max_intra, quantile_cont(d, 0.5) AS median_intra, quantile_cont(d, 0.95) AS intra_95 FROM s JOIN g USING (marker, genus) JOIN pairs p ON p.marker = s.marker AND p.species = s.species AND p.other = s.species AND p.x < p.y GROUP BY ALL",
        x="SELECT marker, species, list(d) AS xs, min(d) AS min_inter, quantile_cont(d, 0.5) AS median_inter, quantile_cont(d, 0.05) AS inter_5 FROM pairs WHERE species <> other GROUP BY ALL",
        c="SELECT marker, species, list(d) AS cs, min(d) AS min_congeneric FROM pairs WHERE species <> other AND genus = ogenus GROUP BY ALL",
        **_diagnostic("a"),
    )


def _diagnostic(view: str) -> dict[str, str]:
    return {
        "bases": f"SELECT marker, species, p, substr(aligned, p::int, 1) AS base, count(*) AS n FROM {view}, range(1, {WIDTH + 1}) t(p) GROUP BY ALL",
        "total": "SELECT marker, p, base, sum(n) AS n FROM bases GROUP BY ALL",
        "size": f"SELECT marker, species, count(*) AS size FROM {view} GROUP BY ALL",
        "diag": "SELECT b.marker, b.species, count(DISTINCT b.p) AS n_diag FROM bases b JOIN total t USING (marker, p, base) JOIN size z ON z.marker = b.marker AND z.species = b.species WHERE b.n >= 0.9 * z.size AND b.n = t.n GROUP BY ALL",
    }


def diagnostic_sites() -> str:
    return query("SELECT marker, species, coalesce(n_diag, 0)::int AS n_diagnostic_sites FROM size LEFT JOIN diag USING (marker, species)", "aligned", **_diagnostic("aligned"))
