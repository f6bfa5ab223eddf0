"""The operators on small hand-made tables."""

import hashlib
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from ampliref.functions import lineage, markers, sequences
from ampliref.operators import assign, curate, distance, gap, phylogeny, qc, query, taxonomy
from ampliref.schemas import match_arg, require_columns
from ampliref.sources import export, fasta, install, release
from ampliref.sources.blast import read_blast_tabular

RANKS = "kingdom string, phylum string, class string, order string, family string, genus string, species string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [(" ac\tgt\n", "ACGT"), ("", ""), (None, None)])
def test_clean(spark, given, want):
    assert one(spark, sequences.clean_sequence(F.lit(given).cast("string"))) == want


def test_primers(spark):
    assert one(spark, sequences.remove_primers(F.lit("AAACGTACGTTT"), ["AAA"], ["TTT"])) == "CGTACGTTT"
    assert one(spark, sequences.remove_primers(F.lit("AAACGTAAA"), [None, "AAA"], ["TTT"])) == "CGT"
    assert one(spark, sequences.remove_primers(F.lit("CGTACGT"))) == "CGTACGT"
    assert one(spark, sequences.reverse_complement(F.lit("AACGn"))) == "nCGTT"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Danio rerio 12S ribosomal RNA gene, partial sequence", "12S_partial"),
        ("Some species mitochondrion, complete genome", "genome_complete"),
        ("Species tRNA-Phe gene, 12S ribosomal RNA gene, and tRNA-Val gene, complete sequence", "12S_complete;other_complete"),
        ("isolate X voucher", "other_unknown"),
        (None, "other_unknown"),
    ],
)
def test_markers(spark, text, want):
    assert one(spark, markers.extract_markers(F.lit(text).cast("string"))) == want


def test_custom_markers(spark):
    assert one(spark, markers.extract_markers(F.lit("Some plant ITS region, partial sequence"), [("ITS", "its")])) == "ITS_partial"


@pytest.mark.parametrize(("seq", "gene", "want"), [("ATGGCTTAA", "COI", (False, False, 2)), ("ATGGCTGCT", "COI", (False, False, 1)), ("TAATAATAAT", "COI", (False, True, 2)), ("A\n😀TAAGCT", "COI", (False, False, 2)), ("ATG", "16S", None), ("AT", "COI", None)])
def test_codons(spark, seq, gene, want):
    got = one(spark, sequences.check_codons(F.lit(seq), F.lit(gene)))
    assert (tuple(got) if got else None) == want


def test_codons_against_brute_force(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("AAGGTTCacgtn-\n😀") for _ in range(r.randrange(3, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for i, got in df.select("i", sequences.check_codons(F.col("s"), F.lit("COI"))).collect():
        seq = texts[i].upper()
        counts = [sum(seq[k : k + 3] in sequences.STOPS["vertebrate_mitochondrial"] for k in range(f, len(seq) - 2, 3)) for f in range(3)]
        assert tuple(got) == (min(counts) > 0, len(seq) % 3 != 0 or min(counts) > 2, counts.index(min(counts)) + 1)


def test_rrna(spark):
    assert tuple(one(spark, sequences.check_rrna(F.lit("ACGN"), F.lit("12S")))) == (True, True)
    assert one(spark, sequences.check_rrna(F.lit("ACG"), F.lit("COI"))) is None


def test_features(spark):
    got = spark.range(1).select(*[c.alias(k) for k, c in sequences.sequence_features(F.lit("GGGGCCC")).items()]).first()
    assert got["gc_content"] == 1 and got["at_skew"] == 0 and got["gc_skew"] == pytest.approx(1 / 7)


def test_arguments(spark):
    assert match_arg("dr", ("stop", "drop")) == "drop"
    with pytest.raises(ValueError):
        match_arg("x", ("stop", "drop"))
    with pytest.raises(ValueError, match="Missing required columns: b, c"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["b", "a", "c"])


@pytest.fixture(scope="module")
def final(spark):
    rows = [("s1", "sp a", "g", "f", "COI", "native", "pass", "ACGT"), ("s2", "sp a", "g", "f", "12S", "native", "numt|contaminant", "ACG"), ("s2", "sp b", "g", "f", "COI", None, "pass", "ACGTAC"), ("s3", "sp c", "h", "f", "COI", "native", None, "A")]
    df = spark.createDataFrame(rows, "source string, species string, genus string, family string, seq_type string, occurrence string, qc_flag string, sequence string")
    return df.withColumns({c: F.lit("x") for c in ("kingdom", "phylum", "class", "order", "habitat")}).withColumn("unique_code", F.concat(F.lit("u"), F.monotonically_increasing_id() % 2))


def test_query(final):
    assert query.get_sequences(final).count() == 2
    assert query.get_sequences(final, qc_flag=None).count() == 4
    assert query.get_sequences(final, qc_flag="contam").count() == 1
    assert query.get_sequences(final, qc_flag="contam", exact=True).count() == 0
    assert query.get_sequences(final, occurrence="native").count() == 1
    assert query.filter_reference(final, min_length=5, max_length=6).count() == 1
    assert [tuple(r) for r in query.list_taxa(final).collect()] == [("sp a", 1), ("sp b", 1)]
    with pytest.raises(ValueError, match="Unsupported rank"):
        query.list_taxa(final, "tribe")


def test_combine_and_resolve(spark):
    a, b = spark.createDataFrame([("sp1", "ACGT", 1)], "species string, sequence string, n int"), spark.createDataFrame([("sp1", "acgt", 2), ("sp2", "acgt", 3)], "species string, sequence string, n int")
    both = curate.combine_sources([a, b.withColumn("extra", F.lit("e"))], order_col="n")
    assert sorted((r["species"], r["n"]) for r in both.collect()) == [("sp1", 1), ("sp2", 3)]
    with pytest.raises(ValueError, match="2 ambiguous"):
        curate.resolve_ambiguous(both)
    assert curate.resolve_ambiguous(both, on_unresolved="drop").count() == 0
    table = both.withColumn("action", F.lit("combine"))
    assert [r["species"] for r in curate.resolve_ambiguous(both, resolution=table, order_col="n").collect()] == ["sp1|sp2"]


def test_taxonomy(spark):
    df = spark.createDataFrame([("k", None, "", "o", "f", "g", "s")], RANKS)
    assert lineage.build_taxonomy_string(df).first()["taxonomy"] == "k;unassigned;unassigned;o;f;g;s"
    assert lineage.build_taxonomy_string(df, "rank_prefix").first()["taxonomy"].startswith("k__k;p__unassigned")
    names = spark.createDataFrame([("Sp A",), ("zz",), (None,)], "species string")
    ref = spark.createDataFrame([("sp a", "Valid a", 1), ("sp a", "Other", 2)], "alternative_clean string, valid_name string, n int")
    got = {r["species"]: r["valid_species"] for r in taxonomy.standardize_species(names, ref, order_col="n", lookup=lambda c: F.concat(F.lit("asked "), c)).collect()}
    assert got == {"Sp A": "Valid a", "zz": "asked zz", None: None}
    joined = taxonomy.join_taxonomy(names, spark.createDataFrame([("Sp A", "G")], "species string, genus string"), defaults={"kingdom": "K"})
    assert sorted((r["genus"], r["order"], r["kingdom"]) for r in joined.collect()) == [("G", "unassigned", "K"), ("unassigned", "unassigned", "K"), ("unassigned", "unassigned", "K")]


HIT = "asv_id string, species string, genus string, family string, pident double, qcov double, scovs double, ccovs double, evalue double, bitscore double, bitscore_pb double"


def test_scores(spark):
    h = [("a", f"Species {x}", "g", "f", 100.0, 1.0, 1.0, 1.0, 0.0, 50.0, 1.0) for x in "ba"] + [("b", "x", None, None, 98.0, 1.0, 1.0, 1.0, 0.0, 50.0, 1.0), ("c", None, None, None, 99.0, 1.0, 1.0, 1.0, 0.0, 50.0, 1.0)]
    got = {r["asv_id"]: r for r in assign.score_assignments(spark.createDataFrame(h, HIT)).collect()}
    assert (got["a"]["assignment_status"], got["a"]["confidence"], got["a"]["tie_taxa"]) == ("check_full_tie", "ambiguous", "Species a|Species b")
    assert (got["b"]["assignment_status"], got["b"]["confidence"]) == ("unique", "low")
    assert (got["c"]["assignment_status"], got["c"]["species"]) == ("ambiguous", None)
    assert assign.score_assignments(spark.createDataFrame([], HIT)).count() == 0


def test_assign_and_matrix(spark, final):
    asvs = spark.createDataFrame([("z", "acgtac", 1), ("a", "TTTT", 2)], "asv_id string, sequence string, ord long")
    got = assign.assign(asvs, final).collect()
    assert [(r["asv_id"], r["species"], r["confidence"]) for r in got] == [("z", "sp b", "high"), ("a", None, "none")]
    with pytest.raises(ValueError):
        assign.assign(asvs.unionByName(asvs), final)
    counts = spark.createDataFrame([("z", "3", 1.0), ("a", "x", 2.0)], "asv_id string, site_1 string, site_2 double")
    scored = spark.createDataFrame([("z", "sp b", "unique"), ("a", None, "no_match")], "asv_id string, species string, assignment_status string")
    assert [tuple(r) for r in assign.species_matrix(scored, counts).collect()] == [("sp b", 3.0, 1.0)]
    assert sorted(tuple(r) for r in assign.species_matrix(scored, counts, unassigned=True).collect()) == [("sp b", 3.0, 1.0), ("unassigned", 0.0, 2.0)]


def test_similarity(spark):
    import random

    r = random.Random(5)
    base = "".join(r.choice("ACGT") for _ in range(300))
    other = base[:150] + ("A" if base[150] != "A" else "C") + base[151:]
    refs = spark.createDataFrame([("r1", base, "s", "g", "f")], "unique_code string, sequence string, species string, genus string, family string")
    hits = assign.similarity_hits(spark.createDataFrame([("q", other)], "asv_id string, sequence string"), refs).collect()
    assert len(hits) == 1 and hits[0]["mismatch"] == 1 and hits[0]["length"] == 300


def test_numts_and_flags(spark):
    df = spark.createDataFrame([("AAAACCCC",), ("TT",), (None,)], "sequence string")
    hit = qc.screen_numts(df, spark.createDataFrame([("AACC",)], "sequence string"))
    assert [r["is_numt"] for r in hit.orderBy(F.col("sequence").asc_nulls_last()).collect()] == [True, False, False]
    with pytest.warns(UserWarning):
        assert not any(r["is_numt"] for r in qc.screen_numts(df, None).collect())
    toy = spark.createDataFrame([(True, None, "yes"), (False, False, "no")], "is_contaminant boolean, is_numt boolean, special string")
    got = qc.compile_qc_flags(toy, extra_flags=[("manual_review_needed", F.col("special") == "yes")])
    assert sorted(r["qc_flag"] for r in got.collect()) == ["contaminant|manual_review_needed", "pass"]


def test_gap(spark):
    rows = [("COI", sp, "g", f"{sp}{i}", s) for sp, seqs in (("a", ["AAAAAAAA", "AAAAAAAA", "AAAAAAAC"]), ("b", ["TTTTTTTT", "TTTTTTTT", "TTTTTTTG"])) for i, s in enumerate(seqs)]
    got = {r["species"]: r for r in gap.gap_metrics(spark.createDataFrame(rows, "marker string, species string, genus string, id string, aligned string")).collect()}
    assert got["a"]["max_intra"] == 0.125 and got["a"]["min_inter"] == 1.0 and got["a"]["gap_exists"] and got["a"]["n_congeners_in_db"] == 1
    sites = gap.diagnostic_sites(spark.createDataFrame([("m", s, s + str(i), {"x": "AAAA", "y": "TTTT"}[s]) for s in "xy" for i in range(3)], "marker string, species string, id string, aligned string"))
    assert {r["n_diagnostic_sites"] for r in sites.collect()} == {4}


def test_blocks_make_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 7)
    df = spark.createDataFrame([("m", str(i), format(i, "06b")) for i in range(40)], "marker string, id string, aligned string")
    dealt = distance.block_pairs(df, ["marker"], "id", 7)
    assert dealt.select("_i", "_j").distinct().count() > 3
    assert sum(r["n"] for r in distance.pair_histogram(df, ["marker"], "id").collect()) == 40 * 39 // 2


def test_tree():
    import numpy as np

    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    tree = phylogeny.neighbour_joining(d, list("abcde"))
    tips = {label: n for _, _, n, tip, label in tree.edges if tip}
    assert tips == pytest.approx({"a": 2, "b": 3, "c": 4, "d": 2, "e": 1}) and tree.newick().endswith(";")
    assert len(phylogeny.rooted(tree, "c").edges) == len(tree.edges)


def test_fasta_and_exports(spark, tmp_path, final):
    p = tmp_path / "x.fasta"
    p.write_text("junk\n>a one\nac gt\n\nAC\n>b\n>c\nTT\n")
    assert [(r["asv_id"], r["sequence"]) for r in fasta.read_fasta(spark, str(p)).orderBy("ord").collect()] == [("a", "ACGTAC"), ("b", ""), ("c", "TT")]
    out = export.export_dada2(final, str(tmp_path / "o.fasta"), single_file=True)
    lines = open(out["fasta"]).read().splitlines()
    assert len(lines) == 8 and all(";tax=" in x for x in lines[::2])
    with pytest.raises(ValueError, match="taxonomy_file"):
        export.export_qiime2(final, str(tmp_path / "q.fasta"))
    q = export.export_qiime2(final, str(tmp_path / "q.fasta"), str(tmp_path / "q.tsv"), single_file=True)
    assert open(q["taxonomy"]).readline() == "Feature ID\tTaxon\n"


def test_safe_ids(spark):
    df = spark.createDataFrame([("a b", 1), ("a b", 2), ("a.b.1", 3), ("1x", 4), ("a b", 5)], "unique_code string, n int")
    assert [r["safe_id"] for r in lineage.safe_ids(df, [F.col("n")]).orderBy("n").collect()] == ["a.b", "a.b.2", "a.b.1", "X1x", "a.b.3"]


def test_blast(spark, tmp_path):
    assert read_blast_tabular(spark, str(tmp_path / "none")).count() == 0
    p = tmp_path / "b.tsv"
    p.write_text("q\ts\t99\t45\t50\t60\t0\t90\t0\t0\t1\t45\t1\t45\n")
    assert read_blast_tabular(spark, str(p)).first()["qcov"] == 0.9


def test_install(tmp_path, monkeypatch):
    src, dest = tmp_path / "src", tmp_path / "d" / "db"
    src.write_text("payload")
    md5 = hashlib.md5(b"payload").hexdigest()
    assert install.install(str(src), str(dest), md5=md5)
    src.write_text("new")
    install.install(str(src), str(dest))
    assert dest.read_text() == "payload"
    with pytest.raises(ValueError, match="md5 mismatch"):
        install.install(str(src), str(dest), overwrite=True, md5=md5)
    with pytest.raises(ValueError):
        install.install("", str(tmp_path / "e"))
    monkeypatch.setenv(install.URL, "there")
    assert install.db_url() == "there"
    seen = []
    with pytest.raises(OSError, match="no net"):
        install.download_with_retries("u", str(tmp_path / "f"), retries=2, downloader=lambda *a: seen.append(1) or (_ for _ in ()).throw(OSError("no net")))
    assert len(seen) == 2


def test_release(spark, tmp_path, final):
    full = final.withColumn("sequence_id", F.lit("i")).withColumn("cn_name", F.lit("鱼"))
    path = release.write_release(str(tmp_path / "rel"), release.release_tables(full))
    r = release.connect(spark, path)
    assert {x["table"]: x["n_rows"] for x in r.tables().collect()} == {"final": 4, "raw": 4, "qc_reference_p2": 4}
    assert "gene" in r.qc_table().columns
    with pytest.raises(ValueError, match="Table not found"):
        r.read_table("x")
    r.disconnect(), r.disconnect()
    with pytest.raises(FileNotFoundError, match="does not exist"):
        release.connect(spark, str(tmp_path / "none"))


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "x.db")
    with sqlite3.connect(p) as con:
        con.execute("create table t (a integer, b text)")
        con.executemany("insert into t values (?, ?)", [(1, "x"), (None, None), (3, "z")])
    r = release.connect(spark, p)
    assert sorted(((x["a"] or 0), x["b"] or "") for x in r.read_table("t").collect()) == [(0, ""), (1, "x"), (3, "z")]
