"""The queries, each with its SQL where SQL can express it. All of them read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliref.functions import lineage, markers, sequences
from ampliref.operators import align, assign, classify, curate, diagnostics, distance, gap, phylogeny, qc, query, taxonomy
from ampliref.plans import sql, views
from ampliref.session import shared_path
from ampliref.sources import export, fasta

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


FINAL = 'row_ord, unique_code, sequence_id, source, species, genus, family, "order", class, phylum, kingdom, seq_type, occurrence, habitat, qc_flag, md5(sequence) AS sequence_md5'


def brief(df: DataFrame) -> DataFrame:
    """Long sequences as digests."""
    return df.withColumn("sequence_md5", F.md5("sequence")).drop("sequence")


# --- sequences and descriptions


@registered("clean_sequence", sql.query(f"SELECT row_ord, md5({sql.CLEAN.format('messy')}) AS cleaned_md5, length({sql.CLEAN.format('messy')}) AS n FROM (SELECT row_ord, ' ' || lower(sequence) || chr(10) || chr(9) || 'ac gt' AS messy FROM refs)", "refs"))
def clean_sequence(spark, d):
    r = views.refs(spark, d).withColumn("c", sequences.clean_sequence(F.concat(F.lit(" "), F.lower("sequence"), F.lit("\n\tac gt"))))
    return r.select("row_ord", F.md5("c").alias("cleaned_md5"), F.length("c").cast("long").alias("n"))


@registered("revcomp", sql.query("SELECT row_ord, md5(reverse(translate(sequence, 'ATCG', 'TAGC'))) AS rc_md5 FROM refs", "refs"))
def revcomp(spark, d):
    return views.refs(spark, d).select("row_ord", F.md5(sequences.reverse_complement(F.col("sequence"))).alias("rc_md5"))


_F, _R = ["GAC", "TGA", None], ["TTG", "GGA"]


def _primers_sql() -> str:
    fwd = "CASE WHEN starts_with(sequence, 'GAC') OR starts_with(sequence, 'TGA') THEN substr(sequence, 4) ELSE sequence END"
    rev = "CASE WHEN ends_with(s, 'CAA') OR ends_with(s, 'TCC') THEN substr(s, 1, length(s) - 3) ELSE s END"
    return sql.query(f"SELECT row_ord, md5({rev}) AS stripped_md5 FROM (SELECT row_ord, {fwd} AS s FROM refs)", "refs")


@registered("remove_primers", _primers_sql())
def remove_primers(spark, d):
    return views.refs(spark, d).select("row_ord", F.md5(sequences.remove_primers(F.col("sequence"), _F, _R)).alias("stripped_md5"))


def _features_sql() -> str:
    n = {b: f"(length(sequence) - length(replace(sequence, '{b}', '')))::double" for b in "ACGT"}
    share = lambda x, y: f"round(CASE WHEN {y} > 0 THEN ({x}) / ({y}) ELSE 0 END, 9)"
    a, c, g, t = (n[b] for b in "ACGT")
    return sql.query(f"SELECT row_ord, length(sequence) AS n, {share(f'{g} + {c}', f'{a} + {c} + {g} + {t}')} AS gc_content, {share(f'{a} + {t}', f'{a} + {c} + {g} + {t}')} AS at_content, {share(f'{g} - {c}', f'{g} + {c}')} AS gc_skew, {share(f'{a} - {t}', f'{a} + {t}')} AS at_skew FROM refs", "refs")


@registered("sequence_features", _features_sql())
def sequence_features(spark, d):
    f = sequences.sequence_features(F.col("sequence"))
    return views.refs(spark, d).select("row_ord", f["length"].cast("long").alias("n"), *[F.round(f[k], 9).alias(k) for k in ("gc_content", "at_content", "gc_skew", "at_skew")])


@registered("extract_markers", sql.query(f"SELECT p_partkey, description, {sql.markers()} AS marker FROM descriptions", "descriptions"))
def extract_markers(spark, d):
    return views.descriptions(spark, d).withColumn("marker", markers.extract_markers(F.col("description")))


_NORMAL = "CASE WHEN m LIKE '%;%' THEN 'multiple' WHEN m IN ('genome_complete', 'complete_genome', 'genome') THEN 'genome' ELSE regexp_replace(m, '_(partial|complete|unknown)$', '') END"


@registered("normalize_marker", sql.query(f"SELECT {_NORMAL} AS marker, count(*) AS n FROM (SELECT {sql.markers()} AS m FROM descriptions) GROUP BY 1", "descriptions"))
def normalize_marker(spark, d):
    m = views.descriptions(spark, d).select(markers.normalize_marker(markers.extract_markers(F.col("description"))).alias("marker"))
    return m.groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


# --- curation


def _sources(spark, d) -> tuple[DataFrame, DataFrame]:
    r = views.refs(spark, d)
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    even = r.where(number % 2 == 0).select("row_ord", F.col("sequence_id").alias("accession"), F.col("species").alias("organism"), F.lower("sequence").alias("seq"), "occurrence")
    odd = r.where(number % 2 == 1).select("row_ord", F.col("sequence_id").alias("id"), F.col("species").alias("taxon"), F.col("sequence").alias("nucleotides"), "habitat")
    a = curate.parse_source(even, "even", {"sequence_id": "accession", "species": "organism", "sequence": "seq"})
    b = curate.parse_source(odd, "odd", {"sequence_id": "id", "species": "taxon", "sequence": "nucleotides"})
    return a, b


_PARSED = """SELECT row_ord, sequence_id, species, sequence, source_name AS source, length(sequence) AS length, 'other_unknown' AS seq_type, occurrence, habitat, src FROM
    (SELECT *, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS source_name, n % 2 AS src FROM (SELECT row_ord, sequence_id, species, sequence, CASE WHEN n % 2 = 0 THEN occurrence END AS occurrence, CASE WHEN n % 2 = 1 THEN habitat END AS habitat, n
    FROM (SELECT *, regexp_extract(source, '([0-9]+)$', 1)::int AS n FROM refs)))"""


@registered("parse_source", sql.query("SELECT row_ord, sequence_id, species, md5(sequence) AS sequence_md5, source, length, seq_type, occurrence FROM parsed WHERE src = 0", "refs", parsed=_PARSED))
def parse_source(spark, d):
    return brief(_sources(spark, d)[0].withColumn("length", F.col("length").cast("long")))


@registered("combine_sources", sql.query("SELECT row_ord, sequence_id, species, md5(sequence) AS sequence_md5, source, length, seq_type, occurrence, habitat FROM parsed QUALIFY row_number() OVER (PARTITION BY species, sequence ORDER BY src, row_ord) = 1", "refs", parsed=_PARSED))
def combine_sources(spark, d):
    out = curate.combine_sources(list(_sources(spark, d)), order_col="row_ord")
    return brief(out.withColumn("length", F.col("length").cast("long")))


_AMBIGUOUS = "SELECT sequence FROM refs GROUP BY sequence HAVING count(DISTINCT species) > 1"


@registered("ambiguous_sequences", sql.query("SELECT row_ord, species, md5(sequence) AS sequence_md5 FROM refs WHERE sequence IN (SELECT sequence FROM amb)", "refs", amb=_AMBIGUOUS))
def ambiguous_sequences(spark, d):
    return brief(curate.ambiguous_sequences(views.refs(spark, d)).select("row_ord", "species", "sequence"))


@registered("resolve_drop", sql.query("SELECT row_ord, species, md5(sequence) AS sequence_md5 FROM refs WHERE sequence NOT IN (SELECT sequence FROM amb)", "refs", amb=_AMBIGUOUS))
def resolve_drop(spark, d):
    return brief(curate.resolve_ambiguous(views.refs(spark, d).select("row_ord", "species", "sequence"), on_unresolved="drop"))


_RESOLUTION = "SELECT species, sequence, genus, row_ord, CASE row_ord % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'combine' ELSE 'remove' END AS action FROM refs WHERE sequence IN (SELECT sequence FROM amb)"
_RESOLVED = """SELECT species, sequence, genus, 0 AS part, row_ord FROM refs WHERE sequence NOT IN (SELECT sequence FROM res)
    UNION ALL SELECT species, sequence, genus, 1, row_ord FROM res WHERE action = 'keep'
    UNION ALL SELECT species, c.sequence, genus, 2, row_ord FROM
      (SELECT sequence, min(row_ord) AS row_ord FROM res WHERE action = 'combine' GROUP BY sequence) c
      JOIN (SELECT sequence, string_agg(species, '|' ORDER BY o) AS species FROM (SELECT sequence, species, min(row_ord) AS o FROM res WHERE action = 'combine' GROUP BY ALL) GROUP BY sequence) s USING (sequence)
      JOIN (SELECT sequence, string_agg(genus, '|' ORDER BY o) AS genus FROM (SELECT sequence, genus, min(row_ord) AS o FROM res WHERE action = 'combine' GROUP BY ALL) GROUP BY sequence) g USING (sequence)"""


@registered("resolve_table", sql.query("SELECT species, genus, md5(sequence) AS sequence_md5 FROM allrows QUALIFY row_number() OVER (PARTITION BY species, sequence ORDER BY part, row_ord) = 1", "refs", amb=_AMBIGUOUS, res=_RESOLUTION, allrows=_RESOLVED))
def resolve_table(spark, d):
    r = views.refs(spark, d).select("row_ord", "species", "sequence", "genus")
    action = F.when(F.col("row_ord") % 3 == 0, "keep").when(F.col("row_ord") % 3 == 1, "combine").otherwise("remove")
    table = curate.ambiguous_sequences(r).withColumn("action", action)
    return brief(curate.resolve_ambiguous(r, resolution=table, order_col="row_ord").select("species", "genus", "sequence"))


@registered("standardize_species", "SELECT c_custkey, upper(n_name) AS name, CASE WHEN c_custkey % 5 <> 0 THEN n_name END AS valid_species FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown ' || n_name ELSE n_name END AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def standardize_species(spark, d):
    n = views.table(spark, d, "nation").select("n_nationkey", "n_name")
    names = views.table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    names = names.select("c_custkey", F.upper(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("unknown "), "n_name")).otherwise(F.col("n_name"))).alias("name"))
    ref = n.select(F.lower("n_name").alias("alternative_clean"), F.col("n_name").alias("valid_name"), "n_nationkey")
    return taxonomy.standardize_species(names, ref, column="name", order_col="n_nationkey")


@registered("join_taxonomy", """SELECT s_suppkey, species, coalesce(family, 'unassigned') AS family, 'unassigned' AS genus, 'unassigned' AS "order", 'Animalia' AS kingdom FROM
    (SELECT s_suppkey, n_name AS species FROM supplier JOIN nation ON s_nationkey = n_nationkey) LEFT JOIN (SELECT n_name AS species, r_name AS family FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0) USING (species)""")
def join_taxonomy(spark, d):
    n, r = views.table(spark, d, "nation"), views.table(spark, d, "region")
    tax = n.where("n_nationkey % 4 <> 0").join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("species"), F.col("r_name").alias("family"))
    s = views.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("species"))
    return taxonomy.join_taxonomy(s, tax, defaults={"kingdom": "Animalia"})


for _style, _name in (("plain", "taxonomy_plain"), ("rank_prefix", "taxonomy_prefixed")):

    @registered(_name, sql.query(f"SELECT row_ord, {sql.taxonomy(_style)} AS taxonomy FROM refs", "refs"))
    def _taxonomy(spark, d, style=_style):
        return lineage.build_taxonomy_string(views.refs(spark, d), style).select("row_ord", "taxonomy")


# --- queries and reports


@registered("tables_rowcount", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in ("documents", "labels", "lineitem", "orders", "events", "benchmark")))
def tables_rowcount(spark, d):
    parts = [views.table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table"), "n_rows") for t in ("documents", "labels", "lineitem", "orders", "events", "benchmark")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@registered("get_sequences", sql.query(f"SELECT {FINAL} FROM refs WHERE qc_flag = 'pass' AND seq_type IN ('COI', '12S') AND occurrence = 'native' AND genus IN ('Genus1', 'Genus2', 'Genus5')", "refs"))
def get_sequences(spark, d):
    return brief(query.get_sequences(views.refs(spark, d), marker=["COI", "12S"], occurrence="native", genus=["Genus1", "Genus2", "Genus5"]))


@registered("get_sequences_qc_partial", sql.query(f"SELECT {FINAL} FROM refs WHERE contains(qc_flag, 'contaminant') OR contains(qc_flag, 'review')", "refs"))
def get_sequences_qc_partial(spark, d):
    return brief(query.get_sequences(views.refs(spark, d), qc_flag=["contaminant", "review"]))


@registered("get_sequences_qc_like", sql.query(f"SELECT {FINAL} FROM refs WHERE qc_flag ILIKE '%MANUAL_REVIEW%' OR qc_flag = 'pass'", "refs"))
def get_sequences_qc_like(spark, d):
    return brief(query.get_sequences(views.refs(spark, d), qc_flag=["MANUAL_REVIEW", "pass"], sql_like=True))


@registered("get_sequences_qc_exact", sql.query(f"SELECT {FINAL} FROM refs WHERE qc_flag = 'contaminant'", "refs"))
def get_sequences_qc_exact(spark, d):
    return brief(query.get_sequences(views.refs(spark, d), qc_flag="contaminant", exact=True))


@registered("filter_length", sql.query(f"SELECT {FINAL} FROM refs WHERE qc_flag = 'pass' AND length(sequence) BETWEEN 300 AND 900 AND source IN ('src1', 'src2')", "refs"))
def filter_length(spark, d):
    return brief(query.filter_reference(views.refs(spark, d), source=["src1", "src2"], min_length=300, max_length=900))


for _rank in ("kingdom", "phylum", "class", "order", "family", "genus", "species"):

    @registered(f"list_taxa_{_rank}", sql.query(f"SELECT \"{_rank}\" AS taxon, count(*) AS n_sequences FROM refs WHERE qc_flag = 'pass' AND occurrence = 'native' GROUP BY 1", "refs"))
    def _list_taxa(spark, d, rank=_rank):
        return query.list_taxa(views.refs(spark, d), rank, occurrence="native")


@registered("taxonomy_distinct", sql.query("SELECT DISTINCT kingdom, phylum, class, \"order\", family, genus, species, occurrence, habitat FROM refs WHERE qc_flag = 'pass'", "refs"))
def taxonomy_distinct(spark, d):
    return query.taxonomy(views.refs(spark, d))


for _rank in ("species", "genus", "family", "order"):

    @registered(f"marker_coverage_{_rank}", sql.query(f"SELECT \"{_rank}\" AS taxon, seq_type, count(*) AS n_sequences, count(DISTINCT source) AS n_sources FROM refs WHERE qc_flag = 'pass' GROUP BY 1, 2", "refs"))
    def _marker_coverage(spark, d, rank=_rank):
        return diagnostics.marker_coverage(views.refs(spark, d), rank)


@registered("source_coverage", sql.query("SELECT source, seq_type, count(*) AS n_sequences, count(DISTINCT species) AS n_species FROM refs WHERE qc_flag = 'pass' GROUP BY 1, 2", "refs"))
def source_coverage(spark, d):
    return diagnostics.source_coverage(views.refs(spark, d))


@registered("qc_summary", sql.query("SELECT qc_flag, count(*) AS n FROM refs GROUP BY 1", "refs"))
def qc_summary(spark, d):
    return diagnostics.qc_summary(views.refs(spark, d))


@registered("ambiguity_by_action", sql.query("SELECT row_ord, species, action, md5(sequence) AS sequence_md5 FROM res WHERE action IN ('keep', 'combine')", "refs", amb=_AMBIGUOUS, res=_RESOLUTION))
def ambiguity_by_action(spark, d):
    r = views.refs(spark, d)
    action = F.when(F.col("row_ord") % 3 == 0, "keep").when(F.col("row_ord") % 3 == 1, "combine").otherwise("remove")
    table = curate.ambiguous_sequences(r).select("row_ord", "species", "sequence", action.alias("action"))
    return brief(diagnostics.ambiguity(table, ["keep", "combine"]))


@registered("database_summary", sql.query("SELECT count(*) AS n_sequences, count(DISTINCT species) AS n_species, count(DISTINCT CASE WHEN contains(species, '|') THEN species END) AS n_composite, count(DISTINCT CASE WHEN NOT contains(species, '|') THEN species END) AS n_single, count(DISTINCT genus) AS n_genera, count(DISTINCT family) AS n_families, count(DISTINCT seq_type) AS n_markers, count(DISTINCT source) AS n_sources FROM refs", "refs"))
def database_summary(spark, d):
    return diagnostics.database_summary(views.refs(spark, d))


@registered("marker_summary", sql.query("SELECT seq_type, count(*) AS n_sequences FROM refs GROUP BY 1", "refs"))
def marker_summary(spark, d):
    return diagnostics.marker_summary(views.refs(spark, d))


@registered("source_proportion", sql.query("SELECT source, qc_flag, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS share FROM refs GROUP BY 1, 2", "refs"))
def source_proportion(spark, d):
    return diagnostics.source_proportion(views.refs(spark, d)).withColumn("share", F.round("share", 9))


# --- assignment


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("qcov", "scovs", "ccovs")})


def _rounded_sql(body: str, *names: str) -> str:
    return sql.query(f"SELECT * REPLACE (round(qcov, 9) AS qcov, round(scovs, 9) AS scovs, round(ccovs, 9) AS ccovs) FROM ({body})", *names)


@registered("exact_hits", sql.query("SELECT * FROM exact", "exact"))
def exact_hits(spark, d):
    return assign.exact_hits(views.asvs(spark, d), query.get_sequences(views.refs(spark, d)))


@registered("blast_derived_metrics", """SELECT l_orderkey AS k, l_linenumber AS n, round(l_quantity::double / 50, 9) AS qcov, round(l_quantity::double / 60, 9) AS scovs, round(sqrt((l_quantity::double / 50) * (l_quantity::double / 60)), 9) AS ccovs, round((100.0::double + l_suppkey % 4) / l_quantity::double, 9) AS bitscore_pb FROM lineitem""")
def blast_derived_metrics(spark, d):
    m = assign.blast_metrics(views.blast_tab(spark, d))
    return m.select(F.regexp_extract("asv_id", "([0-9]+)$", 1).cast("long").alias("k"), "n", *[F.round(c, 9).alias(c) for c in ("qcov", "scovs", "ccovs", "bitscore_pb")])


@registered("score_assignments", _rounded_sql(sql.scored("hits", 99, 0.5, 0), "hits"))
def score_assignments(spark, d):
    return _rounded(assign.score_assignments(views.hits(spark, d), 99, 0.5))


@registered("score_assignments_tol", _rounded_sql(sql.scored("hits", 99, 0.5, 1), "hits"))
def score_assignments_tol(spark, d):
    return _rounded(assign.score_assignments(views.hits(spark, d), 99, 0.5, tie_bitscore=1))


@registered("assign_exact", sql.query(sql.assigned(), "exact"))
def assign_exact(spark, d):
    return assign.assign(views.asvs(spark, d), views.refs(spark, d), method="exact")


_SAMPLES = ["click", "error", "purchase", "signup", "view"]
_SUMS = ", ".join(f"count(*) FILTER (event_type = '{s}')::double AS {s}" for s in _SAMPLES)


@registered("species_matrix", sql.query(f"SELECT species, {_SUMS} FROM ({sql.scored('hits', 99, 0.5, 0)}) s JOIN ev USING (asv_id) WHERE assignment_status = 'unique' AND species IS NOT NULL GROUP BY 1", "hits", ev="SELECT 'ASV_' || user_id AS asv_id, event_type FROM events"))
def species_matrix(spark, d):
    counts = views.asv_counts(spark, d, views.event_types(spark, d))
    return assign.species_matrix(assign.score_assignments(views.hits(spark, d), 99, 0.5), counts)


@registered("species_matrix_long", sql.query(f"SELECT species, event_type AS sample, count(*)::double AS reads FROM ({sql.scored('hits', 99, 0.5, 0)}) s JOIN ev USING (asv_id) WHERE assignment_status = 'unique' AND species IS NOT NULL GROUP BY ALL", "hits", ev="SELECT 'ASV_' || user_id AS asv_id, event_type FROM events"))
def species_matrix_long(spark, d):
    return assign.to_long(species_matrix(spark, d), "species").where("reads > 0")


@registered("species_matrix_ambiguous", sql.query(f"SELECT species, event_type AS sample, count(*)::double AS reads FROM ({sql.scored('hits', 99, 0.5, 0)}) s JOIN ev USING (asv_id) WHERE species IS NOT NULL GROUP BY ALL", "hits", ev="SELECT 'ASV_' || user_id AS asv_id, event_type FROM events"))
def species_matrix_ambiguous(spark, d):
    counts = views.asv_counts(spark, d, views.event_types(spark, d))
    return assign.to_long(assign.species_matrix(assign.score_assignments(views.hits(spark, d), 99, 0.5), counts, include_ambiguous=True), "species").where("reads > 0")


@registered("species_matrix_unassigned", sql.query(f"SELECT CASE WHEN assignment_status IS NULL THEN 'unassigned' ELSE species END AS species, event_type AS sample, count(*)::double AS reads FROM ev LEFT JOIN ({sql.scored('hits', 99, 0.5, 0)}) s USING (asv_id) WHERE assignment_status IS NULL OR assignment_status = 'unique' GROUP BY ALL", "hits", ev="SELECT 'ASV_' || user_id AS asv_id, event_type FROM events"))
def species_matrix_unassigned(spark, d):
    counts = views.asv_counts(spark, d, views.event_types(spark, d))
    every = assign.with_missing(counts.select("asv_id"), assign.score_assignments(views.hits(spark, d), 99, 0.5))
    return assign.to_long(assign.species_matrix(every, counts, unassigned=True), "species").where("reads > 0")


@registered("asv_unpivot", "SELECT asv_id, sample, coalesce(n, 0) AS reads FROM (SELECT DISTINCT 'ASV_' || user_id AS asv_id FROM events) CROSS JOIN (SELECT DISTINCT event_type AS sample FROM events) LEFT JOIN (SELECT 'ASV_' || user_id AS asv_id, event_type AS sample, count(*) AS n FROM events GROUP BY ALL) USING (asv_id, sample)")
def asv_unpivot(spark, d):
    return assign.to_long(views.asv_counts(spark, d, views.event_types(spark, d)))


@registered("site_pivot", "SELECT asv_id, sample, coalesce(n, 0) AS reads FROM (SELECT DISTINCT 'ASV_' || user_id AS asv_id FROM events) CROSS JOIN (SELECT DISTINCT event_type AS sample FROM events) LEFT JOIN (SELECT 'ASV_' || user_id AS asv_id, event_type AS sample, count(*) AS n FROM events GROUP BY ALL) USING (asv_id, sample)")
def site_pivot(spark, d):
    samples = views.event_types(spark, d)
    long = views.table(spark, d, "events").select(F.concat(F.lit("ASV_"), F.col("user_id").cast("string")).alias("asv_id"), F.col("event_type").alias("sample"), F.lit(1).alias("reads"))
    return assign.to_long(assign.to_wide(long, samples))


@registered("assign_compare_full_join", sql.query(f"SELECT asv_id, a.species AS species_x, a.assignment_status AS assignment_status_x, b.species AS species_y, b.assignment_status AS assignment_status_y FROM ({sql.scored('hits', 99, 0.5, 0)}) a FULL JOIN ({sql.scored('odd', 99, 0.5, 1)}) b USING (asv_id)", "hits", odd="SELECT * FROM hits WHERE pident > 96"))
def assign_compare_full_join(spark, d):
    h = views.hits(spark, d)
    pick = lambda df: df.select("asv_id", "species", "assignment_status")
    return assign.compare(pick(assign.score_assignments(h, 99, 0.5)), pick(assign.score_assignments(h.where("pident > 96"), 99, 0.5, 1)))


@registered("tie_override", sql.query(f"SELECT asv_id, CASE WHEN tie_taxa = 'Sp11|Sp15' THEN 'Sp11' WHEN tie_taxa = 'Sp15|Sp19' THEN 'Sp19' ELSE species END AS species, CASE WHEN tie_taxa IN ('Sp11|Sp15', 'Sp15|Sp19') THEN 'unique' ELSE assignment_status END AS assignment_status FROM ({sql.scored('hits', 99, 0.5, 0)})", "hits"))
def tie_override(spark, d):
    return assign.override_ties(assign.score_assignments(views.hits(spark, d), 99, 0.5), {"Sp11|Sp15": "Sp11", "Sp15|Sp19": "Sp19"}).select("asv_id", "species", "assignment_status")


@registered("asv_ids", "SELECT doc_id, printf('ASV_%05d', row_number() OVER (ORDER BY doc_id)) AS asv_id FROM documents")
def asv_ids(spark, d):
    return assign.asv_ids(views.table(spark, d, "documents").select("doc_id"), [F.col("doc_id")])


# --- quality


@registered("numt_screen", sql.query("SELECT row_ord, EXISTS (SELECT 1 FROM numts WHERE contains(sequence, numt)) AS is_numt FROM refs", "refs", "numts"))
def numt_screen(spark, d):
    return qc.screen_numts(views.refs(spark, d), views.numts(spark, d)).select("row_ord", "is_numt")


@registered("codon_check", sql.query(sql.codons(), "genes"))
def codon_check(spark, d):
    # what check_codons asks of a row, so that the filter doesn't make the result once more
    g = views.genes(spark, d).where(F.col("gene").isin("COI", "complete_genome") & (F.length("sequence") >= 3))
    return g.withColumn("c", sequences.check_codons(F.col("sequence"), F.col("gene"))).select("row_ord", "c.*")


@registered("rrna_check", sql.query("SELECT row_ord, length(sequence) < 100 AS has_short, regexp_matches(sequence, '[^ACGT]') AS has_gaps FROM genes WHERE gene IN ('12S', '16S')", "genes"))
def rrna_check(spark, d):
    g = views.genes(spark, d).withColumn("c", sequences.check_rrna(F.col("sequence"), F.col("gene")))
    return g.where("c is not null").select("row_ord", "c.*")


@registered("genome_completeness", sql.query("SELECT row_ord, CASE WHEN gene = 'complete_genome' AND NOT (list_contains(gs, 'COI') AND list_contains(gs, '12S') AND list_contains(gs, '16S')) THEN 'missing_genes' END AS genome_flag FROM genes JOIN (SELECT species, list(DISTINCT gene) AS gs FROM genes GROUP BY 1) USING (species)", "genes"))
def genome_completeness(spark, d):
    return qc.check_genome_completeness(views.genes(spark, d), ("COI", "12S", "16S")).select("row_ord", "genome_flag")


@registered("divergence_precheck", sql.query("SELECT row_ord, CASE WHEN n < 5 THEN 'insufficient_data' WHEN hi > 100 * lo THEN 'high_length_variation' ELSE 'checked' END AS status FROM genes JOIN (SELECT species, gene, count(*) AS n, max(length(sequence)) AS hi, min(length(sequence)) AS lo FROM genes GROUP BY 1, 2) USING (species, gene)", "genes"))
def divergence_precheck(spark, d):
    out = qc.check_divergence(views.genes(spark, d))
    return out.select("row_ord", F.when(F.col("div_result").isin("insufficient_data", "high_length_variation"), F.col("div_result")).otherwise("checked").alias("status"))


_BOOLS = {c: f"CASE WHEN (o_orderkey // {2 ** i}) % 7 = 0 THEN NULL ELSE (o_orderkey // {2 ** i}) % 2 = 1 END" for i, c in enumerate(qc.CHECKS.values())}


@registered("compile_qc_flags", "SELECT o_orderkey, CASE WHEN f = '' THEN 'pass' ELSE f END AS qc_flag FROM (SELECT o_orderkey, concat_ws('|', " + ", ".join(f"CASE WHEN {b} THEN '{n}' END" for n, b in zip(qc.CHECKS, _BOOLS.values())) + ", CASE WHEN o_orderkey % 10 = 3 THEN 'divergent' END) AS f FROM orders)")
def compile_qc_flags(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey")
    for i, c in enumerate(qc.CHECKS.values()):
        bit = F.expr(f"o_orderkey div {2 ** i}")
        o = o.withColumn(c, F.when(bit % 7 != 0, bit % 2 == 1))
    return qc.compile_qc_flags(o, extra_flags=[("divergent", F.col("o_orderkey") % 10 == 3)]).select("o_orderkey", "qc_flag")


def _pipeline_sql() -> str:
    flags = ["CASE WHEN is_numt THEN 'numt' END", "CASE WHEN has_stop THEN 'internal_stop' END", "CASE WHEN frameshifted THEN 'frameshifted' END", "CASE WHEN has_short THEN 'sequence_short' END", "CASE WHEN has_gaps THEN 'sequence_gap' END", "CASE WHEN missing THEN 'incomplete_genome' END", "CASE WHEN gene = 'other' THEN 'manual_review_needed' END"]
    return sql.query(
        f"""SELECT row_ord, CASE WHEN f = '' THEN 'pass' ELSE f END AS qc_flag FROM (SELECT row_ord, concat_ws('|', {', '.join(flags)}) AS f FROM
        (SELECT g.row_ord, gene, EXISTS (SELECT 1 FROM numts WHERE contains(sequence, numt)) AS is_numt, has_stop, frameshifted, gene IN ('12S', '16S') AND length(sequence) < 100 AS has_short, gene IN ('12S', '16S') AND regexp_matches(sequence, '[^ACGT]') AS has_gaps,
        gene = 'complete_genome' AND NOT (list_contains(gs, 'COI') AND list_contains(gs, '12S')) AS missing FROM genes g LEFT JOIN codon c USING (row_ord) JOIN (SELECT species, list(DISTINCT gene) AS gs FROM genes GROUP BY 1) USING (species)))""",
        "genes", "numts", codon=sql.codons(),
    )


@registered("qc_pipeline", _pipeline_sql())
def qc_pipeline(spark, d):
    return qc.run_qc_pipeline(views.genes(spark, d), None, views.numts(spark, d), divergence=False).select("row_ord", "qc_flag")


@registered("qc_pipeline_full")
def qc_pipeline_full(spark, d):
    bad = views.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), views.dna(F.col("text")).alias("sequence"))
    out = qc.run_qc_pipeline(views.genes(spark, d), bad, views.numts(spark, d))
    return out.select("row_ord", "is_contaminant", "is_numt", "has_stop", "frameshifted", "has_short", "has_gaps", "genome_flag", "div_result", "qc_flag")


# --- distances, gaps, trees


@registered("pairwise_hamming", sql.query("SELECT a.marker, hamming(a.aligned, b.aligned)::int AS distance, count(*) AS n FROM aligned a JOIN aligned b ON a.marker = b.marker AND a.row_ord < b.row_ord GROUP BY ALL", "aligned"))
def pairwise_hamming(spark, d):
    return distance.pair_histogram(views.aligned(spark, d), ["marker"], "row_ord")


_GAP_OUT = ["species", "marker", "n_sequences", "gap_exists", "robust_gap", "n_congeners_in_db", "n_diagnostic_sites", "sampling_adequacy", "taxonomic_resolution", "assignment_risk", "recommended_threshold"]


def _gap(spark, d) -> DataFrame:
    # caps are part of the operator; for the comparison they lie above any marker's rows
    return gap.run_barcode_gap(views.aligned(spark, d), gene_col="marker", sequence_col="aligned", max_other=1_000_000, max_congeners=1_000_000, max_diagnostic=1_000_000)


@registered("run_barcode_gap", sql.gap())
def run_barcode_gap(spark, d):
    out = _gap(spark, d)
    four = {"p_overlap", "q_overlap", "congeneric_p_overlap", "congeneric_q_overlap"}
    return out.select(*_GAP_OUT, *[F.round(c, 4 if c in four else 9).alias(c) for c in sql.GAP_COLUMNS])


_SPECIES_OUT = ["species", "marker", "n_sequences", "gap_exists", "robust_gap", "n_congeners_in_db", "n_diagnostic_sites", "sampling_adequacy", "taxonomic_resolution"]


@registered("barcode_gap_species", sql.gap(", ".join(_SPECIES_OUT), least=1))
def barcode_gap_species(spark, d):
    a = views.aligned(spark, d).select("marker", "species", "genus", F.col("unique_code").alias("id"), "aligned")
    four = {"p_overlap", "q_overlap", "congeneric_p_overlap", "congeneric_q_overlap"}
    made = gap.gap_metrics(a, 1_000_000, 1_000_000, 1_000_000)
    return made.select(*_SPECIES_OUT, *[F.round(c, 4 if c in four else 9).alias(c) for c in sql.GAP_COLUMNS])


@registered("barcode_gap_filter", sql.query(f"SELECT species, marker, gap_exists FROM ({sql.gap()}) WHERE marker IN ('COI', '16S') AND species IN ('Genus1 sp1', 'Genus2 sp5', 'Genus0 sp9')"))
def barcode_gap_filter(spark, d):
    return diagnostics.barcode_gap(_gap(spark, d), ["Genus1 sp1", "Genus2 sp5", "Genus0 sp9"], ["COI", "16S"]).select("species", "marker", "gap_exists")


@registered("gap_summary_crosstab", f"SELECT marker, count(*) FILTER (gap_exists) AS gap, count(*) FILTER (NOT gap_exists) AS no_gap FROM ({sql.gap()}) GROUP BY 1")
def gap_summary_crosstab(spark, d):
    return diagnostics.gap_crosstab(_gap(spark, d))


@registered("diagnostic_sites", sql.diagnostic_sites())
def diagnostic_sites(spark, d):
    a = views.aligned(spark, d).select("marker", "species", F.col("unique_code").alias("id"), "aligned")
    return gap.diagnostic_sites(a, 0.9, 1_000_000)


_PURINE = "(x IN ('A', 'G')) = (y IN ('A', 'G'))"
_K80 = """SELECT distance, count(*) AS n FROM (SELECT round(CASE WHEN 1 - 2 * p - q > 0 AND 1 - 2 * q > 0 THEN -0.5 * ln(1 - 2 * p - q) - 0.25 * ln(1 - 2 * q) END, 6) + 0.0 AS distance FROM
    (SELECT (SELECT count(*) FROM range(1, 65) t(i) WHERE substr(a.aligned, i::int, 1) <> substr(b.aligned, i::int, 1) AND (substr(a.aligned, i::int, 1) IN ('A', 'G')) = (substr(b.aligned, i::int, 1) IN ('A', 'G'))) / 64.0::double AS p,
            (SELECT count(*) FROM range(1, 65) t(i) WHERE (substr(a.aligned, i::int, 1) IN ('A', 'G')) <> (substr(b.aligned, i::int, 1) IN ('A', 'G'))) / 64.0::double AS q
     FROM ok a JOIN ok b ON a.row_ord < b.row_ord)) GROUP BY 1"""


@registered("k80_distance", sql.query(_K80, "aligned", ok="SELECT row_ord, aligned FROM aligned WHERE marker = '16S' AND NOT contains(aligned, 'N')"))
def k80_distance(spark, d):
    a = views.aligned(spark, d).where((F.col("marker") == "16S") & ~F.col("aligned").contains("N")).select(F.col("row_ord").alias("id"), "aligned")
    return phylogeny.k80_distances(a).groupBy((F.round("distance", 6) + 0.0).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


@registered("gene_tree")
def gene_tree(spark, d):
    tree = phylogeny.build_gene_tree(views.aligned(spark, d), "16S", "marker", sequence_col="aligned", min_length=views.WIDTH, outgroup="^Genus0")
    return tree.dataframe(spark)


# --- search and classification


@registered("contaminant_screen")
def contaminant_screen(spark, d):
    bad = views.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), views.dna(F.col("text")).alias("sequence"))
    return align.contaminated(views.refs(spark, d), bad).select("row_ord", "is_contaminant")


@registered("assign_kmer")
def assign_kmer(spark, d):
    return assign.assign(views.asvs(spark, d, every=50), views.refs(spark, d), method="blastn")


@registered("divergence")
def divergence(spark, d):
    return qc.check_divergence(views.genes(spark, d)).select("row_ord", "div_result")


def _classified(spark, d):
    rows = classify.add_features(views.refs(spark, d))
    return rows, classify.train_classifier(rows, trees=50)


@registered("train_eval")
def train_eval(spark, d):
    return _classified(spark, d)[1].confusion


@registered("classify_sequences")
def classify_sequences(spark, d):
    rows, fitted = _classified(spark, d)
    return classify.classify_sequences(fitted, rows.select("row_ord", "sequence"), 0.5).select("row_ord", "predicted_label", F.round("confidence", 6).alias("confidence"), "final_label", "prediction_source")


# --- exports

_SAFE = "CASE WHEN nth = 0 THEN name ELSE name || '.' || nth END"
_NAMED = "SELECT *, row_number() OVER (PARTITION BY name ORDER BY row_ord) - 1 AS nth FROM (SELECT *, 'seq.' || (row_ord % 300) AS name FROM refs)"


def _coded(spark, d) -> DataFrame:
    """References whose codes repeat and need cleaning."""
    return views.refs(spark, d).withColumn("unique_code", F.concat(F.lit("seq-"), (F.col("row_ord") % 300).cast("string")))


@registered("safe_id", sql.query(f"SELECT row_ord, {_SAFE} AS safe_id FROM named", "refs", named=_NAMED))
def safe_id(spark, d):
    return lineage.safe_ids(_coded(spark, d), [F.col("row_ord")]).select("row_ord", "safe_id")


for _format, _header in (
    ("blastn", f"'>' || {_SAFE} || ';' || {sql.taxonomy('plain')}"),
    ("dada2", f"'>' || {_SAFE} || ';tax=' || {sql.taxonomy('plain')}"),
    ("usearch", f"'>' || {_SAFE} || ' tax=' || {sql.taxonomy('rank_prefix')}"),
    ("qiime2", f"'>' || {_SAFE}"),
):

    @registered(f"export_headers_{_format}", sql.query(f"SELECT row_ord, {_header} AS header, {sql.taxonomy('plain' if _format in ('blastn', 'dada2') else 'rank_prefix')} AS taxonomy FROM named", "refs", named=_NAMED))
    def _headers(spark, d, format=_format):
        return export.headers(_coded(spark, d), format, "row_ord").select("row_ord", "header", "taxonomy")


@registered("fasta_roundtrip", sql.query("SELECT 'seq_' || row_ord AS asv_id, sequence FROM refs", "refs"))
def fasta_roundtrip(spark, d):
    path = shared_path(spark, "fasta")
    fasta.write_fasta(export.headers(views.refs(spark, d), "qiime2", "row_ord"), path)
    return fasta.read_fasta(spark, path).select("asv_id", "sequence")
