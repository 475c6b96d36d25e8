"""Each operator on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and brute force."""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolith.llm import compression_quality, hamming_search, html_extract, html_model, jaccard_join, license_scan, mixing, packing, pii, quality_rules, sharding
from chronolith.llm.html_blocks import blocks
from chronolith.llm.text import n_words

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    out = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(n)]
    for i in range(9, n, 10):
        out[i] += "."
    return " ".join(out) + "."


@pytest.fixture(scope="module")
def documents():
    r = random.Random(3)
    rows = []
    for i in range(120):
        rows.append((i, prose(r, r.choice([3, 8, 40, 200])), r.choice(["en", "de"]), f"s{min(i % 7, 3)}", 0))
    base = prose(r, 150)
    rows += [(200 + i, base, "en", "s0", 0) for i in range(25)]  # copies
    for i in range(25):  # near copies
        w = base.split()
        w[r.randrange(len(w))] = "changed" + str(i)
        rows.append((300 + i, " ".join(w), "en", None, 0))
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, " \n\t ", "en", "s1", 0), (403, "one two", "en", "s1", 0), (None, base, "en", "s2", 0), (405, prose(r, 6000), "fr", "s2", 0)]
    rows += [(200, base, "en", "s0", 0)] * 2  # repeated rows
    return rows


@pytest.fixture(scope="module")
def docs(spark, documents):
    return spark.createDataFrame(documents, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- 6 quality rules


def test_line_cleaning_equals_sql(documents, docs):
    got = quality_rules.clean_lines(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(documents, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    con.register("odd", pd.DataFrame({"x": [1]}))
    want = con.sql(quality_rules.SQL).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want))


def test_line_cleaning_rules(spark, no_docs):
    good = "This is a line of text that ends as it should, with words enough for the rules."
    rows = [(1, "\n".join([good, "Another sentence follows here, quite unlike the one before, and closes properly.", "Home | About | Contact | Login"])), (2, "\n".join([good, "A | B | C |", "menu without an end " * 9])), (3, "### a$$$ b%%% c&&& " * 12), (4, "WHAT!! IS!! THIS!! " * 9), (5, None)]
    out = {r.doc_id: r for r in quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept and out[1].clean_text.count("\n") == 1 and "Home" not in out[1].clean_text
    assert not any(out[i].kept for i in (2, 3, 4, 5))
    assert quality_rules.clean_lines(no_docs).count() == 0
    repeat = " ".join(["a b c d e f g h."] * 3)
    assert quality_rules.clean_lines(spark.createDataFrame([(1, repeat)], "doc_id long, text string")).first()["n_repeat_words"] == 24


# --- 1 mixing


def test_mix_meets_targets_and_repeats(docs):
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("row"))
    a = mixing.mixed(rows).toPandas()
    b = mixing.mixed(rows.repartition(3)).toPandas()
    key = ["row", "doc_id", "size"]
    count = lambda x: x.groupby([*key, "source"], dropna=False)["copies"].sum().to_dict()
    assert repr(sorted(count(a).items(), key=repr)) == repr(sorted(count(b).items(), key=repr))
    assert len(a) == docs.count() and a["copies"].between(0, 2).all()
    g = a.assign(taken=a["copies"] * a["size"]).groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), own=("size", "sum"), source_size=("source_size", "first"))
    assert (g["own"] == g["source_size"]).all()
    longest = a.groupby("source", dropna=False)["size"].max()  # whole documents: half of the longest one may be missing or too much
    assert ((g["taken"] - g["target"]).abs() <= 0.02 * g["target"] + np.maximum(200, longest / 2)).all()
    assert abs(g["target"].sum() - 1.5 * g["own"].sum()) < 1e-6


def test_targets_reshare_what_is_above_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert t["a"] == 20 and t[None] == 0 and abs(sum(t.values()) - 3015) < 1e-6 and abs(t["b"] - 2995 * 2 / 3) < 1e-6 and abs(t["c"] - 2995 / 3) < 1e-6


def test_flight_keeps_totals():
    r = random.Random(1)
    sizes, p = [float(r.randrange(1, 500)) for _ in range(300)], [r.random() for _ in range(300)]
    n, w = sum(p), sum(a * b for a, b in zip(sizes, p, strict=True))
    left = mixing.fly(sizes, p, random.Random(2))
    assert len(left) <= 2 and abs(sum(p) - n) < 1e-6 and abs(sum(a * b for a, b in zip(sizes, p, strict=True)) - w) < 1e-4
    assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i not in left)


def test_empty_mix(no_docs):
    assert mixing.mixed(no_docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.lit(0).cast("long").alias("row"))).count() == 0


# --- 7 packing


def test_packing_round_trip(documents, docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed(packing.pieces(docs.select("doc_id", "text"))).toPandas()
    assert got["length"].between(1, 1024).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.concatenate(([0], g["length"].cumsum().to_numpy()[:-1]))).all() and g["length"].sum() <= 1024
    want = defaultdict(int)
    for doc_id, text, *_ in documents:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first, at, n = len(ids) % 1024 or 1024, 0, 0
        while at < len(ids):
            part = ids[at : at + (first if at == 0 else 1024)]
            want[(doc_id, n, at, len(part), zlib.crc32(part.tobytes()))] += 1
            at, n = at + len(part), n + 1
    have = defaultdict(int)
    for r in got.itertuples():
        have[(None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)] += 1
    assert have == want
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 1024 + 2
    assert packing.packed(packing.pieces(no_docs.select("doc_id", "text"))).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_solver_packs_everything(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 1025): r.randrange(1, 60) for _ in range(r.randrange(1, 200))}
    plan = packing.solve(dict(counts))
    used = defaultdict(int)
    for lengths, runs in plan:
        assert sum(lengths) <= 1024 and runs > 0
        for k in lengths:
            used[k] += runs
    assert used == counts
    assert sum(n for _, n in plan) >= -(-sum(k * v for k, v in counts.items()) // 1024)


def test_dominance_fixes_exact_pairs():
    left = packing.Lengths({600: 2, 424: 1, 300: 1, 700: 1, 324: 1})
    fixed = packing.reduce_dominated(left, 1024)
    assert ((600, 424), 1) in fixed and ((700, 324), 1) in fixed


def test_encoder_follows_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), packing.encoder(path)
    r = random.Random(5)
    for text in ["", " ", "it's  we'll\n\n x", "Ünïcödé 日本 １２ ٣    a", "a" * 3000, *["".join(r.choice("aé ’'\n\t1_日😀-.​") for _ in range(60)) for _ in range(300)]]:
        assert list(e(text)) == t.encode(text, add_special_tokens=False).ids


# --- 5 sharding


def test_shards_are_even_and_keep_copies_together(docs, no_docs):
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text").select("id", F.when(F.col("text").isNotNull(), F.col("h")).alias("key"))
    got = sharding.sharded(keyed, 6).toPandas()
    n = got.groupby("shard").size()
    assert len(got) == docs.count() and n.max() - n.min() <= 1 and len(n) == 6
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    g = got.groupby("key").agg(n=("id", "size"), k=("shard", "nunique"))
    assert (g[g["n"].between(2, 20)]["k"] == 1).all()
    assert g[g["n"] > 20]["k"].max() <= 3
    assert sharding.sharded(no_docs.select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("key")), 6).count() == 0


def test_a_key_larger_than_a_shard_is_split(spark):
    df = spark.range(240).select("id", F.when(F.col("id") < 100, 1).otherwise(F.col("id")).alias("key"))
    got = sharding.sharded(df, 12).toPandas()
    assert (got.groupby("shard").size() == 20).all() and got[got["key"] == 1]["shard"].nunique() <= 7


def test_copies_stay_together_where_nearly_all_rows_have_one(spark):
    """Full shards exchange rows: with 97 % of the rows in groups of 3, the rest is not enough to move them one by one."""
    df = spark.range(2400).select("id", F.when(F.col("id") < 2328, F.floor(F.col("id") / 3)).otherwise(F.col("id")).alias("key"))
    got = sharding.sharded(df, 6).toPandas()
    assert (got.groupby("shard").size() == 400).all()
    assert (got[got["id"] < 2328].groupby("key")["shard"].nunique() == 1).mean() >= 0.95


# --- 10 Jaccard join


def brute(rows):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 4 * both >= 3 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(repr((d, len(s), least.get(find(i)) if s else d)) for i, ((d, *_), s) in enumerate(zip(rows, sets, strict=True)))


def test_join_equals_brute_force(documents, docs, no_docs):
    got = jaccard_join.jaccard_components(docs)
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(documents)
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_join_of_edits_at_the_threshold(spark):
    """Sets of every small size and pairs on both sides of 3/4, and a shared passage."""
    r = random.Random(11)
    rows, passage = [], prose(r, 60)
    for n in [1, 2, 4, 5, 6, 7, 8, 9, 11, 15, 23, 40, 90]:
        base = [r.choice(WORDS) + str(r.randrange(9)) for _ in range(n)]
        for cut in range(0, max(1, n // 2), max(1, n // 8)):
            rows.append((len(rows), " ".join(base[cut:])))
            rows.append((len(rows), " ".join(base[: n - cut]).upper()))
    rows += [(len(rows) + i, passage + " " + prose(r, k)) for i, k in enumerate([10, 15, 20, 25, 30, 60] * 4)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(repr(tuple(x)) for x in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def test_every_linked_pair_shares_an_index_entry():
    """The pigeonhole itself, with all counts equal and with hostile ones."""
    r = np.random.default_rng(7)
    for n in [1, 2, 3, 5, 7, 9, 14, 30, 120]:
        for trial in range(30):
            a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
            drop = r.integers(0, n // 4 + 1)
            b = np.unique(np.concatenate((a[drop:], r.integers(0, 1 << 62, max(0, n // 7 - drop), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 4 * both < 3 * (len(a) + len(b) - both):
                continue
            hashes, of = np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)])
            counts = np.zeros(jaccard_join.BUCKETS, np.int64) if trial % 2 else r.integers(0, 1000, jaccard_join.BUCKETS)
            sets, entries = jaccard_join.Entries(hashes, of, np.array([len(a), len(b)])).chosen(counts)
            assert np.intersect1d(entries[sets == 0], entries[sets == 1]).size


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(9)
    for n in (5, 31, 33, 200, 700, 1400):
        a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        b = a[n // 4 :]
        s = jaccard_join._sketches(np.concatenate((a, b)), None, np.array([len(a), len(b)]))
        size = min(map(len, s))
        differ = np.bitwise_count(jaccard_join._fold(s[0], size) ^ jaccard_join._fold(s[1], size)).sum()
        assert differ <= len(a) - len(b)
        whole = [sum(bin(int(w) % (1 << 64)).count("1") for w in v) for v in s]
        assert whole[0] <= len(a) and whole[1] <= len(b)


# --- 4 PII


def test_pseudonyms_keep_format_and_links(spark, no_docs):
    text = "card 4111111111111111 or 4111 1111 1111 1111, not 4111111111111112; ip 10.1.2.3, 999.1.1.1; born 1984-02-29, 31/12/1999, not 31/02/1999; tel +1 (415) 555-1234; GB82 WEST 1234 5698 7654 32; a.b@mail.example.com; token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""
    rows = [(1, text), (2, "again 4111111111111111 and 10.1.2.3 " + "x" * 50000), (3, None), (4, "")]
    out = {r.doc_id: r for r in pii.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    new = out[1].text
    for secret in ("4111111111111111", "4111 1111 1111 1111", "10.1.2.3", "1984-02-29", "31/12/1999", "555-1234", "5698", "a.b@mail", "24be64"):
        assert secret not in new, secret
    for kept in ("4111111111111112", "999.1.1.1", "31/02/1999", "+1 (", "token = "):
        assert kept in new, kept
    card = re.search(r"card (\d{16}) or (\d{4} \d{4} \d{4} \d{4}),", new)
    assert card and card[1] == card[2].replace(" ", "") and card[1] in out[2].text
    digits = [int(c) for c in card[1]][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    iban = re.search(r"GB\d\d WEST \d{4} \d{4} \d{4} \d\d", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search(r"born \d{4}-\d\d-\d\d, \d\d/\d\d/\d{4}", new)
    assert out[2].text.endswith("x" * 50000) and out[3].text is None and out[4].text == ""
    assert out[1].n_card == 2 and out[1].n_date == 2 and out[3].n_card == 0
    assert pii.pseudonymized(no_docs).count() == 0
    other = pii.pseudonymized(spark.createDataFrame(rows[:1], "doc_id long, text string"), key="other").first()["text"]
    assert other != new


def test_feistel_is_a_permutation(spark):
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert digits.select(pii.permute_digits(F.col("d"), "k", "x").alias("p")).distinct().count() == 1000
    days = spark.range(0, 73049, 7).select(pii._day(F.col("id"), "k").alias("p"))
    assert days.distinct().count() == days.count() and days.agg(F.max("p")).first()[0] < 73049


# --- 3 licenses


def test_licenses_are_found_and_verified(spark, no_docs):
    r = random.Random(2)
    mit = license_scan.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "without charge").replace("publish", "print")
    rows = [(1, prose(r, 300) + " " + mit + " " + prose(r, 90)), (2, "x\n" + changed), (3, prose(r, 500)), (4, "Some text.\nReleased under the MIT License.\n"), (5, None), (6, ""), (7, " ".join(mit.split()[:40])), (1, "again " + mit), (8, "This work is licensed under the GNU General Public License, version 3.")]
    got = {(x.doc_id, x.license): x.containment for x in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop((1, "MIT")) == 1.0 and 0.75 <= got.pop((2, "MIT")) < 1 and got.pop((4, "MIT-line")) == 1.0 and got.pop((8, "GPL-3.0-line")) == 1.0
    assert not got
    assert license_scan.scanned(no_docs.select("doc_id", "text")).count() == 0


# --- 2 quality classifier


def test_compression_classifier(spark, no_docs):
    r = random.Random(4)
    docs = [(i, prose(r, 80)) for i in range(200)] + [(200 + i, " | ".join(r.choice(WORDS).upper() + "###" for _ in range(80))) for i in range(200)]
    docs += [(900, None), (901, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400) if i % 5] + [(None, 1), (3, 7)], "doc_id long, quality int")
    out = compression_quality.scored(d, compression_quality.learned(labels, d)).toPandas().set_index("doc_id")["score"]
    assert out.between(0, 1).all() and len(out) == 402
    held = [i for i in range(400) if i % 5 == 0]
    assert all((out[i] >= 0.5) == (i < 200) for i in held)
    none = compression_quality.learned(labels.limit(0), d)
    assert set(compression_quality.scored(d, none).toPandas()["score"]) == {0.5}
    assert compression_quality.scored(no_docs, none).count() == 0


def test_scores_keep_the_class_shares_where_the_sample_is_bounded(spark):
    """Texts say nothing of their label here: the mean score is the share of label 1, 7 of 8, and not that of the sample, one half."""
    r = random.Random(5)
    d = spark.createDataFrame([(i, prose(r, 60)) for i in range(800)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(800)], "doc_id long, quality int")
    scores = compression_quality.scored(d, compression_quality.learned(labels, d, rows=30)).toPandas()["score"]
    assert 0.8 <= scores.mean() <= 0.95


# --- 8 HTML


@pytest.fixture(scope="module")
def labeller():
    return html_model.trained()


def test_labeller_on_unseen_pages(labeller):
    r, right, total = random.Random(77), 0, 0
    for _ in range(80):
        html, truth = html_model.page(r)
        got = labeller.labels([html_model.vectors(blocks(html))])[0]
        right, total = right + int((got == np.array(truth)).sum()), total + len(truth)
    assert right / total > 0.97


def test_gradients():
    net, r = html_model.Labeller(1), np.random.default_rng(0)
    x, mask, y = r.standard_normal((2, 4, html_model.INPUT)).astype(np.float32), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], np.float32), np.ones((2, 4), np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradients(x.astype(np.float64), mask, y)
    for name in ("xf", "hb", "cf", "o"):
        at = tuple(0 if i else 0 for i in net.p[name].shape)
        net.p[name][at] += 1e-4
        up = net.gradients(x.astype(np.float64), mask, y)[0]
        net.p[name][at] -= 2e-4
        down = net.gradients(x.astype(np.float64), mask, y)[0]
        net.p[name][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-3


def test_extraction(spark, labeller):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="ad">Buy now.</div><article><h1>Big &amp; small</h1><p>First  paragraph\n of the text, with words.<p>Second <b>bold</b> one, with more words.</article><footer>&copy; x.example</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "", ""), (None, "u", "plain words without tags"), (1, "u", page)]
    out = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), labeller).collect()
    want = "Big & small First paragraph of the text, with words. Second bold one, with more words."
    assert sorted((r.page_id, r.text) for r in out if r.page_id) == [(1, want), (1, want), (2, ""), (3, "")]
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string"), labeller).count() == 0


def test_blocks_of_broken_markup():
    for html in ("<p", "<!-- open", "<div class='a>b'>x</div>", "<script>never closed <p>x", "a<b", "</p></div>x", "<p><b>x<p>y"):
        assert isinstance(blocks(html), list)
    assert [b.text for b in blocks("<p><b>x<p>y</b>&lt;z&gt;")] == ["x", "y<z>"]
    assert [b.text for b in blocks("<div class='a>b'>x</div>")] == ["x"]


# --- 9 search


def test_search_equals_brute_force(spark, no_docs):
    r = np.random.default_rng(3)
    v = r.standard_normal((300, 64)).astype(np.float32)
    v[100:160] = v[7]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(999, None), (None, v[0].tolist()), (5, v[5].tolist()), (800, [1.0] * 10)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = hamming_search.search(df, df.filter("id % 20 = 0"), 10).toPandas()
    codes = {i: [x > 0 for x in e] + [False] * (64 - len(e)) for i, e in rows if e is not None and i is not None}
    for q, g in got.groupby("query_id"):
        want = sorted((sum(a != b for a, b in zip(codes[q], c, strict=True)), i) for i, c in codes.items() if i != q)[:10]
        assert list(zip(g.sort_values("rank")["distance"], g.sort_values("rank")["neighbor_id"], strict=True)) == want
    assert set(got["query_id"]) == {i for i in codes if i % 20 == 0}
    assert hamming_search.search(df.limit(0), df.limit(0)).count() == 0


# --- pipeline


def test_rows_keep_their_numbers_however_files_are_read(spark, docs, tmp_path):
    import corpus_pipeline as cp

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            numbered = cp._numbered(spark.read.parquet(str(tmp_path / "documents.parquet")))
            seen.append(sorted((r["row"], r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in numbered.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len({r[0] for r in seen[0]}) == docs.count()


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as cp

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in cp.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        counts.append(at.count())
        if name != "pack":
            assert at.columns == cp.COLUMNS
    assert counts[1] < counts[0] < docs.count()
    kept = spark.read.parquet(str(tmp_path / "near_duplicates")).toPandas()
    assert len(kept[kept["doc_id"].between(200, 399) | kept["doc_id"].isna()]) == 1  # one of all copies and near copies
    assert json.dumps(counts)
