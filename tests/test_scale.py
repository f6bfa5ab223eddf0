"""Bounds that results must not depend on: both sides of each, against brute force."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliref.functions import lineage, sequences
from ampliref.operators import assign, classify, distance, gap, numbering, phylogeny, qc
from ampliref.sources import install, release

R = random.Random(6)


def dna(n, letters="ACGT"):
    return "".join(R.choice(letters) for _ in range(n))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_numts_on_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(qc, "BROADCAST_CHARS", limit)
    seqs = [dna(R.randrange(0, 80), "ACGTNacgt") for _ in range(60)] + [None, "", "ACG"]
    parts = [s[3 : 3 + R.choice([2, 7, 15, 16, 17, 40])] for s in seqs if s and len(s) > 20][:20] + ["N" * 18, "acgtn", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "n int, sequence string").withColumn("_key", F.lit(1))
    got = {r["n"]: r["is_numt"] for r in qc.screen_numts(df, spark.createDataFrame([(p,) for p in parts], "sequence string")).collect()}
    assert got == {i: bool(s) and any(p and p in s for p in parts) for i, s in enumerate(seqs)}


def mash(a, b, k=11):
    x, y = ({s[i : i + k] for i in range(len(s) - k + 1)} for s in (a, b))
    j = len(x & y) / len(x | y)
    return 1.0 if not j else min(1.0, max(0.0, -np.log(2 * j / (1 + j)) / k))


@pytest.mark.parametrize(("backbone", "block"), [(64, 512), (3, 4)])
def test_terminal_branches(spark, monkeypatch, backbone, block):
    monkeypatch.setattr(distance, "BACKBONE", backbone)
    monkeypatch.setattr(distance, "BLOCK", block)
    base = dna(300)
    # two close relatives that are far from the rest
    odd = dna(300)
    rows = [("g", f"s{i}", base[: 40 * i] + dna(3) + base[40 * i + 3 :]) for i in range(7)] + [("g", "x", odd), ("g", "y", odd[:100] + "A" + odd[101:]), ("g", "short", "ACGT"), ("h", "one", base)]
    df = spark.createDataFrame(rows, "group string, id string, sequence string")
    got = {(r["group"], r["id"]): r["branch"] for r in distance.terminal_branches(df).collect()}
    assert len(got) == len(rows) and np.isnan(got["g", "short"]) and np.isnan(got["h", "one"])
    own = {i: s for g, i, s in rows if g == "g" and len(s) > 10}
    for i in own:
        rest = [j for j in own if j != i]
        want = max(0.0, min((mash(own[i], own[j]) + mash(own[i], own[k]) - mash(own[j], own[k])) / 2 for j in rest for k in rest if j != k))
        assert got["g", i] >= want - 1e-9
        assert backbone < 64 or got["g", i] == pytest.approx(want)
    assert got["g", "x"] < 0.05 and got["g", "y"] < 0.05


def test_divergence_states(spark):
    base = dna(400)
    rows = [("a", "COI", f"a{i}", base[: 50 * i] + dna(2) + base[50 * i + 2 :]) for i in range(6)] + [("a", "COI", "odd", dna(400)), ("a", "COI", "tiny", "ACGTACG")]
    rows += [("b", "COI", f"b{i}", base) for i in range(3)] + [("c", "COI", f"c{i}", base if i else dna(3)) for i in range(6)]
    df = spark.createDataFrame(rows, "species string, gene string, unique_code string, sequence string")
    got = {r["unique_code"]: r["div_result"] for r in qc.check_divergence(df).collect()}
    assert got["odd"] == "divergent" and got["tiny"] == "tree_error" and all(got[f"a{i}"] == "pass" for i in range(6))
    assert got["b0"] == "insufficient_data" and got["c1"] == "high_length_variation"
    few = {r["unique_code"]: r["div_result"] for r in qc.check_divergence(df, min_seqs=2).collect()}
    assert few["b0"] == "pass"


def test_gap_of_uneven_widths(spark):
    """Sequences that differ in width are aligned: an indel costs one column, not all that follow."""
    one, two = dna(60), dna(60)
    rows = [(sp, "COI", f"{sp}{i}", s[:20] + s[20 + (i == 1) :]) for sp, s in (("p q", one), ("r s", two)) for i in range(5)]
    df = spark.createDataFrame(rows, "species string, seq_type string, unique_code string, sequence string")
    got = {r["species"]: r for r in gap.run_barcode_gap(df).collect()}
    assert all(r["error_msg"] is None and r["gap_exists"] for r in got.values())
    widths = {r["max_intra"] for r in got.values()}
    assert max(widths) <= 1 / 60 + 1e-9
    assert {r["error_msg"] is not None for r in gap.run_barcode_gap(df, alignment="require").collect()} == {True}


def test_gene_tree_aligns(spark):
    base = dna(200)
    far = dna(200)
    rows = [("A a", "a1", base), ("A a", "a2", "G" + base), ("B b", "b1", far), ("B b", "b2", far[:50] + far[51:])]
    df = spark.createDataFrame([("COI", *r) for r in rows], "seq_type string, species string, unique_code string, sequence string")
    tree = phylogeny.build_gene_tree(df, "COI", outgroup="^B")
    tips = {label: n for _, _, n, tip, label in tree.edges if tip}
    assert len(tips) == 4 and tips["A-a-a1"] < 0.01 and tips["A-a-a2"] < 0.01
    labels, d = phylogeny.k80_matrix(spark.createDataFrame([(i, dna(50)) for i in "edcba"], "id string, aligned string"))
    assert labels == list("abcde") and np.array_equal(d, d.T, equal_nan=True) and not d.diagonal().any()


def test_numbers_and_names(spark):
    df = spark.createDataFrame([(i * 7 % 100, "x") for i in range(100)], "a int, b string").repartition(5)
    assert [(r["a"], r["asv_id"]) for r in assign.asv_ids(df, [F.col("a")]).orderBy("a").collect()] == [(i, f"ASV_{i + 1:05d}") for i in range(100)]
    assert numbering.numbered(df.limit(0), [F.col("a")], "n").count() == 0
    names = [R.choice(["a", "a.1", "a.2", "a.3", "a.5", "b", "b.1", "a.1.1"]) for _ in range(60)]
    got = [r["safe_id"] for r in lineage.safe_ids(spark.createDataFrame(list(enumerate(names)), "n int, unique_code string"), [F.col("n")]).orderBy("n").collect()]
    first = set(names)
    counters, want = {}, []
    for name in names:
        if name not in counters:
            counters[name] = 0
            want.append(name)
            continue
        counters[name] += 1
        while f"{name}.{counters[name]}" in first:
            counters[name] += 1
        want.append(f"{name}.{counters[name]}")
    assert got == want
    assert [r["safe_id"] for r in lineage.safe_ids(spark.createDataFrame([(2,), (1,)], "n int"), [F.col("n")]).orderBy("n").collect()] == ["seq_1", "seq_2"]


def test_codons_of_long_sequences(spark):
    for s in [dna(R.randrange(3, 400), "ACGTN") for _ in range(20)] + ["ACC" * 60_000 + "TAA"]:
        stops = [sum(s[i : i + 3] in ("TAA", "TAG", "AGA", "AGG") for i in range(f, len(s) - 2, 3)) for f in range(3)]
        got = spark.range(1).select(sequences.check_codons(F.lit(s), F.lit("COI")).alias("c")).first()["c"]
        assert (got["has_stop"], got["frameshifted"], got["best_frame"]) == (min(stops) > 0, len(s) % 3 != 0 or min(stops) > 2, stops.index(min(stops)) + 1)


def test_stratified_split(spark):
    df = spark.createDataFrame([("a" if i < 50 else "b" if i < 60 else None, float(i)) for i in range(70)], "label string, x double")
    rows = classify.split(df, "label", 0.8, 1, ["x"]).groupBy("label", "_train").count().collect()
    assert {(r["label"], r["_train"]): r["count"] for r in rows} == {("a", True): 40, ("a", False): 10, ("b", True): 8, ("b", False): 2, (None, True): 8, (None, False): 2}


def test_training(spark):
    rows = [("COI", "AT" * (60 + i % 9)) for i in range(60)] + [("12S", "GC" * (60 + i % 9)) for i in range(60)]
    df = classify.add_features(spark.createDataFrame(rows, "seq_type string, sequence string"))
    fitted = classify.train_classifier(df, trees=5, permute=True)
    assert fitted.metrics["accuracy"] == 1 and fitted.importance["length"] <= 0.1 and len(fitted.importance) == 5
    out = classify.classify_sequences(fitted, spark.createDataFrame([("AT" * 70,), ("AT",), (None,)], "sequence string"), 0.5).collect()
    assert [r["final_label"] for r in out if r["sequence"] and len(r["sequence"]) > 99] == ["COI"] and sum(r["final_label"] == "other" for r in out) == 2


def test_manifest(spark, tmp_path):
    src = tmp_path / "src"
    src.write_text("payload")
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"url": str(src), "size_bytes": 7, "md5": install.checksum(str(src), "md5")}))
    manifest = release.read_manifest(str(path))
    assert release.install_release(manifest, str(tmp_path / "a" / "db")).endswith("db")
    src.write_text("other..")
    with pytest.raises(ValueError, match="md5 mismatch"):
        release.install_release(manifest, str(tmp_path / "b" / "db"))
    src.write_text("x")
    with pytest.raises(ValueError, match="too small"):
        release.install_release(manifest, str(tmp_path / "c" / "db"))
    top = release.demo_subset(spark.createDataFrame([(f"u{i}",) for i in range(9)], "unique_code string"), 3)
    assert [r["unique_code"] for r in top.collect()] == ["u0", "u1", "u2"]


def test_features_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def length(s):
        made.add(1)
        return float(len(s))

    rows = [("COI", "AT" * (60 + i % 9)) for i in range(60)] + [("12S", "GC" * (60 + i % 9)) for i in range(60)]
    df = classify.add_features(spark.createDataFrame(rows, "seq_type string, sequence string")).withColumn("length", F.udf(length, "double")("sequence"))
    fitted = classify.train_classifier(df, trees=2)
    assert sum(r["COI"] + r["12S"] for r in fitted.confusion.collect()) == 24 and made.value == 120
    assert fitted.test.select("sequence", "predicted").count() == 24


def test_classified_features_are_counted_once(spark):
    rows = [("COI", "AT" * (60 + i % 9)) for i in range(60)] + [("12S", "GC" * (60 + i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "seq_type string, sequence string")
    fitted = classify.train_classifier(classify.add_features(df), trees=2)
    out = classify.classify_sequences(fitted, df.select("sequence"), 0.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and plan.count("replace(") == 4
    got = {k: v for k, v in classify.add_features(spark.createDataFrame([(None,), ("ACGGNT",)], "sequence string")).collect()[1].asDict().items()}
    assert (got["length"], got["gc_content"], got["gc_skew"]) == (6, 3 / 5, 1 / 3)


def test_neighbour_joining_of_many_tips():
    """The joins are those of a plain version, and take well under the seconds of reading all pairs at each of them."""
    draw = np.random.default_rng(3)

    def plain(d):
        nodes, out = list(range(len(d))), []
        while len(nodes) > 4:
            m, t = len(nodes), d.sum(0)
            q = (m - 2) * d - t[:, None] - t[None, :]
            np.fill_diagonal(q, np.inf)
            i, j = sorted(divmod(int(q.argmin()), m))
            new = (d[i] + d[j] - d[i, j]) / 2
            keep = [k for k in range(m) if k not in (i, j)]
            out.append((nodes[i], nodes[j]))
            d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
            nodes = [nodes[k] for k in keep] + [len(labels) + len(out) - 1]
        return out

    for n in (6, 70, 200):
        x, labels = draw.random((n, 6)), [f"t{i}" for i in range(n)]
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        edges = phylogeny.neighbour_joining((d + d.T) / 2, labels).edges
        assert [(edges[2 * k][1], edges[2 * k + 1][1]) for k in range(n - 4)] == plain((d + d.T) / 2)
    x = draw.random((3000, 6))
    d = np.sqrt(sum((x[:, None, k] - x[None, :, k]) ** 2 for k in range(6)))
    began = time.process_time()
    assert len(phylogeny.neighbour_joining(d, [""] * 3000).edges) == 2 * 3000 - 3
    assert time.process_time() - began < 30
