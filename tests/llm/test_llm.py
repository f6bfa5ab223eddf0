"""The training-data operators against brute force and on awkward tables: nulls, empty and long texts, repeats, no rows."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("public_tokenizers")

from ampliref.llm import exact_dedup, minhash, mixing, pieces, pii, quality, secret_scan, spotsigs, token_counts  # noqa: E402

R = random.Random(11)
WORDS = ["alpha", "Beta", "the", "of", "gamma", "delta", "is", "épsilon", "zeta", "eta", "a", "theta"]


def prose(n):
    return " ".join(R.choice(WORDS) + str(R.randrange(9)) * R.randrange(2) for _ in range(n))


BASE = prose(120)
TEXTS = [
    None, "", " \n\t", "one", "One", BASE, BASE.upper(), BASE + " tail", BASE.replace("gamma", "GAMMA"), prose(80), prose(80), "x" * 40_000, "word " * 6000, "é☃ 漢字 \x1c\x85z", BASE, BASE,
    "mail a@b.co_x@d.com call +1 (555) 123-4567 or 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 and 999.1.1.1 ..a@b..c", "token = 'abcdef' AKIA" + "B" * 16 + " " + "0af" * 10, "password:x secret=" + "ab1" * 9, "<|endoftext|>a  b\n\nc",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "s0"), (None, "lost", None)]
    # columns whose names clash with the operators' own
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"kept": F.lit("k"), "n": F.lit(1), "n_tokens": F.lit("x"), "bucket": F.lit(2)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


def known(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_exact(docs, empty):
    for keep, best in (("max", max), ("min", min)):
        got = rows(exact_dedup.exact_duplicates(docs, keep))
        groups = {}
        for i, t in known(docs):
            groups.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), t), []).append(i)
        assert len(got) == len(known(docs))
        by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
        for r in got:
            ids = by[r["text_sha256"]]
            assert r["group_size"] == len(ids) and r["keep_id"] == (ids[0] if ids == [None] else best(ids))
        assert sum(r["kept"] for r in got) == len(groups)
        kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got if r["kept"])
        for parts in (1, 3, 23):  # runs within and across partitions
            docs.sparkSession.conf.set("spark.sql.shuffle.partitions", parts)
            only = exact_dedup.unique_rows(docs, keep)
            assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in only.collect()) == kept and only.columns == docs.columns
        docs.sparkSession.conf.set("spark.sql.shuffle.partitions", 4)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.unique_rows(empty).columns == empty.columns and exact_dedup.unique_rows(empty).count() == 0


def shingle_set(t, k):
    w = t.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near(spark, docs, empty, width, percent):
    # chains of edits: neighbours are linked, ends are not
    base = prose(150).split()
    chain = [(100 + k, " ".join(["new%d" % j if j < 3 * k else w for j, w in enumerate(base)]), None) for k in range(12)]
    df = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(chain, "doc_id long, text string, source string"))
    have = {i: shingle_set(t, width) for i, t in known(df) if i is not None}
    label = {i: i for i in have}
    for _ in have:
        for a in have:
            for b in have:
                if have[a] and have[b] and 100 * len(have[a] & have[b]) >= percent * len(have[a] | have[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = rows(minhash.near_duplicates(df, width, percent))
    assert len(got) == df.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(have[r["doc_id"]]), label[r["doc_id"]], r["doc_id"] == label[r["doc_id"]])
    assert minhash.near_duplicates(empty).count() == 0


def test_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    base = prose(200).split()
    df = spark.createDataFrame([(k, " ".join(["n%d" % (j % 3) if (j + 7 * k) % 40 < 5 else w for j, w in enumerate(base)])) for k in range(40)], "doc_id long, text string")
    have = {i: shingle_set(t, 3) for i, t in known(df)}
    label = {i: i for i in have}
    for _ in range(6):
        for a in have:
            for b in have:
                if 100 * len(have[a] & have[b]) >= 85 * len(have[a] | have[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(df, 3, 85))} == label


def test_parity_never_drops_a_link():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 300, 20_000):
        one = rng.integers(0, 2**63, n).astype(np.uint64)
        two = np.concatenate([one[n // 10 :], rng.integers(0, 2**63, n // 10).astype(np.uint64)])
        apart = np.unpackbits(minhash.parity(one) ^ minhash.parity(two)).sum()
        assert apart <= len(np.setxor1d(one, two)) and not (minhash.parity(one) ^ minhash.parity(one[::-1])).any()


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(str(path))
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows(token_counts.count_tokens(docs, str(path)))}
    assert got == {(i, len(t.encode()), len(own.encode(t, add_special_tokens=False).ids)) for i, t in known(docs)}
    assert token_counts.count_tokens(empty, str(path)).count() == 0


def test_tokens_of_another_kind(docs, tmp_path):
    """A file that cuts texts in another way is refused, not counted wrongly."""
    import json

    spec = json.loads(Path(tokenizers.path("byte_bpe_50k.json")).read_text())
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="byte-level"):
            token_counts.count_tokens(docs, str(tmp_path / "other.json"))


def test_pieces(docs, empty):
    import sentencepiece

    path = str(tokenizers.path("piece_bpe_32k.model"))
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in rows(pieces.encode_decode(docs, path, with_ids=True)):
        want = own.encode(dict(known(docs))[r["doc_id"]], add_eos=True)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (want, len(want), own.decode(want))
    assert pieces.encode_decode(empty, path).count() == 0


def test_pieces_on_random_strings():
    import sentencepiece

    path = str(tokenizers.path("piece_bpe_32k.model"))
    own, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(open(path, "rb").read())
    texts = ["".join(R.choice("aab  \nthe▁é☃z.,'-") for _ in range(R.randrange(60))) for _ in range(800)] + [" " * 900, "ab" * 900]
    for t, e in zip(texts, codec.entries(texts)):
        assert [int(x) for y in e for x in y[0].split()] == own.encode(t)


def test_quality_reads_long_words_whole(monkeypatch):
    head = "ab" * 40
    texts = [head + "漢字" * 50, head + "zq" * 50, head]
    grams = lambda w: sum(len(w) + 2 - n + 1 for n in quality.GRAMS) + 1
    counted = [quality._counted(t) for t in texts]
    assert [int(n.sum()) for _, n in counted] == [grams(t) for t in texts]
    weights = np.random.default_rng(3).normal(size=quality.BUCKETS)
    want = [1 / (1 + np.exp(-(weights[at] @ n) / n.sum())) for at, n in counted]
    assert quality.Scores(weights, 0.0).score(texts) == pytest.approx(want)
    # parts of any size give the same
    monkeypatch.setattr(quality, "PART_CHARS", 7)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(map(quality._counted, texts), counted))
    assert quality.Scores(weights, 0.0).score(texts) == pytest.approx(want)


BASES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def allowed(kind, m):
    d = re.sub("[^0-9]", "", m)
    return [True, all(int(p) <= 255 for p in m.split(".")) if kind == 1 else True, 16 <= len(d) <= 19 and luhn(d), 8 <= len(d) <= 15][kind]


def test_pii(docs, empty):
    for r in rows(pii.personal_data(docs)):
        t = dict(known(docs))[r["doc_id"]]
        want = [(k, m.start(), m.end()) for k, p in enumerate(BASES) for m in re.finditer(p, t) if allowed(k, m[0])]
        assert [tuple(s) for s in r["base"]] == want
        assert want or not r["terms"]
    assert pii.report(pii.personal_data(empty)).count() == 0


def test_pii_terms(spark):
    rows_ = [(i, f"{prose(4)} Quixote writes q@x.org {prose(5 + i)}") for i in range(6)] + [(10 + i, prose(30)) for i in range(200)]
    got = {r["doc_id"]: r for r in rows(pii.personal_data(spark.createDataFrame(rows_, "doc_id long, text string")))}
    text = dict(rows_)
    assert all("Quixote" in [text[i][s["start"] : s["end"]] for s in got[i]["terms"]] for i in range(6))
    assert not any(got[10 + i]["terms"] for i in range(200))
    clean = pii.sanitised(spark.createDataFrame(rows_, "doc_id long, text string")).where("doc_id < 6").collect()
    assert all("[EMAIL]" in r["text"] and "Quixote" not in r["text"] for r in clean)


def test_pii_terms_of_whole_texts(spark):
    """Terms far from an entity, of entities seen twice or once, and only in texts that hold the entity."""
    far = prose(60)  # over 80 characters
    rows_ = [(i, f"Dulcinea {far} {prose(9)} mail +1 (555) 123-4560") for i in range(4)] + [(4, f"{prose(60)} and Zanzibar to zanzibar@y.org")]
    rows_ += [(5, "+1 (555) 123-4560 " + prose(40)), (6, "Dulcinea alone"), (None, f"Dulcinea {far} {prose(9)} +15551234560"), (7, f"Rocinante {far} 97.51.17.173"), (8, f"97.051.17.173 {far} {far} Rocinante")]
    rows_ += [(10 + i, f"{prose(20)} n{i}@z{i}.net") for i in range(300)]
    got = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["terms"]] for r in rows(pii.personal_data(spark.createDataFrame(rows_, "doc_id long, text string")).join(spark.createDataFrame(rows_, "_id long, text string"), F.expr("doc_id <=> _id")))}
    assert all("Dulcinea" in got[i] for i in (0, 1, 2, 3, None))
    assert got[4] == ["Zanzibar"] and got[7] == got[8] == ["Rocinante"] and got[6] == [] and not any(got[10 + i] for i in range(300))


def brute_terms(texts):
    """The disclosing terms of each text, as {term: removed or not}, from counts made one by one."""
    import math

    import regex

    distinct = set(texts)
    n = len(distinct)
    terms = {t: {w.lower() for w in regex.findall(pii.TERM, t)} for t in distinct}
    vocabulary = Counter(w for t in distinct for w in terms[t])

    def held(t):
        out = {}
        for k, p in enumerate(BASES):
            for m in (m[0] for m in re.finditer(p, t) if allowed(k, m[0])):
                m = m.lower() if k == 0 else ".".join(str(int(x)) for x in m.split(".")) if k == 1 else re.sub("[^0-9]", "", m)
                parts = [f"0l:{m.split('@')[0]}", f"0d:{m.split('@')[-1]}"] if k == 0 else [f"1n:{m.rsplit('.', 1)[0]}"] if k == 1 else [f"{k}n:{m[:-4]}"]
                out[f"{k}:{m}"] = [f"{k}:{m}", *parts]
        return out

    entities = {t: held(t) for t in distinct}
    keys = Counter(k for t in distinct for k in {k for ks in entities[t].values() for k in ks})

    def chance(c, a, b):
        few, share = min(a, b), max(a, b) / n
        x = c / few
        return -few * (x * math.log(x / share) + ((1 - x) * math.log((1 - x) / (1 - share)) if x < 1 else 0)) if x > share else 0.0

    shares = {}
    for e, ks in {e: ks for t in distinct for e, ks in entities[t].items()}.items():
        information = math.log2(n / keys[e])
        if information <= 0:
            continue
        for k in ks:
            holders = [t for t in distinct if any(k in x for x in entities[t].values())]
            for w, c in Counter(w for t in holders for w in terms[t]).items():
                if w in k or chance(c, vocabulary[w], keys[k]) <= math.log(pii.CHANCE / len(vocabulary)):
                    share = round(math.log2(n * c / (vocabulary[w] * keys[k])) / information, 9)
                    shares[w, e] = max(share, shares.get((w, e), -1.0))
    out = {}
    for t in distinct:
        best = {}
        for (w, e), share in shares.items():
            if share >= pii.GENERALISE and e in entities[t] and w in terms[t]:
                best[w] = max(share, best.get(w, 0))
        out[t] = {w: share >= pii.REMOVE for w, share in best.items()}
    return out


def test_pii_terms_against_brute_force(spark):
    rnd = random.Random(3)
    name = lambda: "".join(rnd.choice("bcdfgaeiou") for _ in range(6))
    people = [(name(), f"{name()}@{name()}.org", f"10.{rnd.randrange(9)}.3.{rnd.randrange(4)}", f"+4930555{rnd.randrange(1000, 1010)}") for _ in range(8)]
    texts = [None, "", "one two"]
    for i in range(160):
        who = rnd.choice(people)
        words = [rnd.choice(WORDS) + rnd.choice(["", "x", "yy", "zzz"]) for _ in range(rnd.randrange(3, 25))]
        named = [rnd.choice([who[0], who[0].upper()])] * (rnd.random() < 0.9) + rnd.sample(who[1:], rnd.randrange(1, 3))
        for extra in named if i % 3 else []:
            words.insert(rnd.randrange(len(words)), extra)
        texts.append(" ".join(words))
    texts += texts[20:40]
    want = brute_terms([t or "" for t in texts])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"term": F.lit("clash"), "_key": F.lit(1), "share": F.lit(0.5)})
    shown = 0
    for r in rows(pii.personal_data(df)):
        text = texts[r["doc_id"]] or ""
        got = {text[s["start"] : s["end"]].lower(): gone for s, gone in zip(r["terms"], r["removed"])}
        base = [range(s["start"], s["end"]) for s in r["base"]]
        free = {w for w in want[text] for m in re.finditer(rf"(?<![^\W\d_]){w}(?![^\W\d_])", text.lower()) if not any(m.start() < b.stop and b.start < m.end() for b in base)}
        assert got == {w: want[text][w] for w in free}
        shown += len(got)
    assert shown > 20


def test_secrets(docs, empty):
    assign = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for r in rows(secret_scan.secrets(docs)):
        t = dict(known(docs))[r["doc_id"]]
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3] == sorted(want)
    assert secret_scan.report(secret_scan.secrets(empty)).count() == 0


def test_long_key_headers(spark):
    header = "-----BEGIN " + "VERY LONG " * 9 + "PRIVATE KEY-----"
    df = spark.createDataFrame([(1, "x " + header + " y"), (2, "-----BEGIN " + "A" * 50_000), (3, "-----BEGIN PRIVATE KEY-----")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in rows(secret_scan.secrets(df))}
    assert got == {1: [(2, 2 + len(header))], 2: [], 3: [(0, 27)]}


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("[0-9a-f]{24,}") == [] and q("ab") == [] and q("abcd") == [[frozenset({"abc", "bcd"})]]
    assert q("x(abc|def)?y") == [] or all(len(a) for a in q("x(abc|def)?y"))
    for rule in secret_scan.RULES:
        assert all(alt for c in q(rule.pattern) for alt in c)


def test_mix(spark, docs, empty):
    got = rows(mixing.mix(docs))
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in rows(mixing.mix(docs))}
    big = spark.createDataFrame([(i, prose(R.randrange(400)), f"s{i % 7 if i % 3 else 0}") for i in range(600)], "doc_id long, text string, source string")
    by = {}
    for r in rows(mixing.mix(big)):
        b = by.setdefault(r["source"], [0, r["target"], 0])
        b[0] += r["taken"]
        b[2] += r["size"]
    assert sum(b[1] for b in by.values()) == pytest.approx(sum(b[2] for b in by.values()))
    assert all(abs(b[0] - b[1]) <= 0.03 * b[1] + 64 for b in by.values())
    assert mixing.mix(empty).count() == 0


def test_apportion(spark):
    parties = [("g", k, float(R.randrange(1, 1000))) for k in range(25)]
    df = spark.createDataFrame(parties, "g string, k int, w double").withColumn("seats", F.lit(317))
    got = {r["k"]: r["quota"] for r in rows(mixing.apportion(df, ["g"], [F.col("k")], "w", "seats"))}
    quotients = sorted(((w / (2 * s + 1), -k) for _, k, w in parties for s in range(317)), reverse=True)[:317]
    assert got == {k: sum(q[1] == -k for q in quotients) for _, k, _ in parties}


def spots(text):
    """Brute force: the multiset of (anchor, two content words) of a text."""
    common = set(" ".join(spotsigs.ANCHORS.values()).split())
    marks = " \t\r\n.,;:!?()[]{}\"'|*&%$#<>-\u2013\u2014\u2026"
    words = []
    for line in (text or "").split("\n"):
        if line.split():
            words += [None, *filter(None, (w.strip(marks).lower() for w in line.split()))]
    out = Counter()
    for i, w in enumerate(words):
        if w is None or w in common:
            out[(w, *[x for x in words[i + 1 :] if x is not None and x not in common][:2])] += 1
    return out


def alike(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_spots(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_DOCS", 4)
    more = spark.createDataFrame([(100, "| x | y |\n| z | w |\n\n--- ***"), (101, "UN DEUX TROIS"), (102, "漢字 かな"), (103, "the of"), (104, "the of"), (105, "...")], "doc_id long, text string")
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(more, allowMissingColumns=True)
    order = sorted(known(df), reverse=True)
    got = {r["doc_id"]: r for r in rows(spotsigs.edit_report(df))}
    assert len(got) == len(order)
    prints = {}
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        changed = t[: len(t) - cut] + follow[:cut]
        r, own, other = got[i], spots(t), spots(changed)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and r["n_chars"] == len(t)
        assert r["near_next"] == pytest.approx(alike(own, spots(follow))) and r["near_edited"] == pytest.approx(alike(own, other))
        for bag, shown in ((own, r["fingerprint"]), (other, r["edited_fingerprint"])):
            assert prints.setdefault(frozenset(bag.items()), shown) == shown and (shown == "") == (not bag)
    assert len(set(prints.values())) == len(prints) and got[103]["fingerprint"] == got[104]["fingerprint"] != ""
    # nulls, repeated identifiers and columns with the operator's own names
    clash = docs.withColumns({"halo": F.lit(1), "top": F.lit(2), "fingerprint": F.lit("f")})
    assert spotsigs.edit_report(clash).count() == docs.count() and spotsigs.edit_report(empty).count() == 0


@pytest.mark.parametrize("block", [2, 4096])
def test_spot_links(spark, docs, empty, monkeypatch, block):
    """Pairs, classes and links against multisets compared one by one, with signatures that many texts share dealt out or not."""
    monkeypatch.setattr(spotsigs, "MEET_ROWS", block)
    base = prose(400).split()
    near = [(200 + k, " ".join("other%d" % (j + k) if j % 97 == k % 5 else w for j, w in enumerate(base[: 400 - k]))) for k in range(14)]
    df = docs.dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(near + [(300, "the of"), (301, near[3][1])], "doc_id long, text string"), allowMissingColumns=True)
    bags = {i: spots(t) for i, t in known(df) if i is not None}
    first = {}
    for i in sorted(bags):
        first.setdefault(frozenset(bags[i].items()), i)
    reps = sorted(i for bag, i in first.items() if bag)
    wanted = {(a, b): alike(bags[a], bags[b]) for a in reps for b in reps if a < b and alike(bags[a], bags[b]) >= 0.8}
    found = {(r["a"], r["b"]): r["likeness"] for r in rows(spotsigs.similar_pairs(spotsigs.fingerprints(df), 0.8))}
    assert len(wanted) > 10 and found.keys() == wanted.keys() and all(found[p] == pytest.approx(wanted[p]) for p in wanted)
    count = Counter(i for p in wanted for i in p)
    got = rows(spotsigs.links(df, 0.8))
    assert len(got) == df.count()
    for r in got:
        if r["doc_id"] is not None:
            bag = bags[r["doc_id"]]
            one = first[frozenset(bag.items())] if bag else r["doc_id"]
            assert (r["n_signatures"], r["class_id"], r["n_links"]) == (sum(bag.values()), one, count[one] if bag else 0)
        else:
            assert (r["class_id"], r["n_links"]) == (None, 0)
    assert spotsigs.links(empty).count() == 0
    with pytest.raises(ValueError):
        spotsigs.similar_pairs(spotsigs.fingerprints(df), 0)


def test_quality(spark, empty):
    good = [(i, prose(60)) for i in range(160)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(60).split()) if i % 2 else (R.choice(WORDS) + " ") * 60) for i in range(80)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    model = quality.fit(docs, labels, ~quality.held_out())
    held = rows(quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()))
    assert sum((r["score"] >= 0.7) == bool(r["quality"]) for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "z" * 50_000)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in rows(quality.score(odd, model)))
    assert quality.score(empty, model).count() == 0 and quality.accepted(empty, model).columns == empty.columns
    blank = quality.fit(docs, labels.limit(0), ~quality.held_out())
    assert {r["score"] for r in rows(quality.score(odd.where("doc_id < 3"), blank))} == {0.5}


def test_mix_against_brute_force(spark):
    """Targets by water filling, and rows as often as the mix takes them, with null, shared and clashing identifiers."""
    data = [(i if i % 9 else None, prose(R.randrange(60)), f"s{i % 5}" if i % 4 else None) for i in range(300)] + [(7, prose(40), "s1"), (7, None, "s2")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({"row": F.lit("r"), "size": F.lit("s"), "_id": F.lit(1)})
    total = Counter()
    for _, t, s in data:
        total[s] += len((t or "").split())
    order = sorted((s for s in total), key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(total.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 3 * total[s]]
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)
    for r in rows(mixing.mix(df)):
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == total[r["source"]]
    out = mixing.resampled(df)
    assert out.columns == df.columns
    times = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    assert set(times) <= set(data) and all(n <= 3 for n in times.values()) and any(k[0] is None for k in times)
    words = Counter()
    for (_, t, s), n in times.items():
        words[s] += n * len(t.split())
    assert all(abs(words[s] - target[s]) <= 0.2 * target[s] + 64 for s in order)


def test_pipeline(spark):
    """The stages after the classifier against brute force on the smallest tables, and all of them end to end."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "encoding"]
    unique = corpus_pipeline.drop_copies(spark, docs, d)
    first = {}
    for i, t in sorted(known(docs)):
        first.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), t), i)
    assert unique.columns == docs.columns and sorted(r["doc_id"] for r in unique.collect()) == sorted(first.values())
    near = corpus_pipeline.drop_near_copies(spark, unique, d)
    have = {i: shingle_set(t, 5) for i, t in known(unique)}
    label = {i: i for i in have}
    holders = {}
    for i, s in have.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    linked = [(a, b) for a, b in pairs if 100 * len(have[a] & have[b]) >= 80 * len(have[a] | have[b])]
    for _ in linked:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == sorted(i for i in label if label[i] == i)
    good = corpus_pipeline.keep_quality(spark, docs, d)
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"), ~quality.held_out())
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in quality.score(docs, model).where("score >= 0.7").collect())
    from ampliref.llm import common

    before = common.written()
    out = corpus_pipeline.run(spark, d)
    assert common.written() == before + 1  # the last stage's input alone
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    text = dict(known(docs))
    for r in out.collect():
        assert r["decoded"] == text[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
