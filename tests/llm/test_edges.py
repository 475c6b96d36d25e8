"""Nulls, large ids, clashing columns, long texts and empty tables; brute-force versions of what SQL can't express."""

from __future__ import annotations

import collections
import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import compression_quality, hamming_search, html_extract, html_model, jaccard_join, license_scan, mixing, packing, pii, quality_rules, registry, sharding
from chronolith.llm.html_blocks import blocks

IDS = [2**63 - 1, None, 2**53 + 1, 2**53 + 3, -(2**63), None, 7, 7]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, path, rows, schema, name="documents"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return spark.read.parquet(f"{path}/{name}.parquet")


def ids_of(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).distinct().collect()), key=lambda x: (x is None, x or 0))


WANTED = sorted(set(IDS), key=lambda x: (x is None, x or 0))


# --- ids


def test_ids_come_back_as_they_were(spark, tmp_path):
    texts = [f"some words of document number {i} that differ from others {i * 7} in a few places" for i in range(len(IDS))]
    docs = table(spark, tmp_path, [(d, t, "en", "a", len(t)) for d, t in zip(IDS, texts, strict=True)], SCHEMA)
    labels = spark.createDataFrame([(2**53 + 1, 1), (7, 0)], "doc_id long, quality int")
    model = compression_quality.learned(labels, docs)
    assert ids_of(compression_quality.scored(docs, model)) == WANTED
    assert ids_of(packing.packed(packing.pieces(docs))) == WANTED
    assert ids_of(mixing.op1_cube_mix(spark, str(tmp_path))) == WANTED
    assert ids_of(license_scan.scanned(docs.withColumn("text", F.lit("Released under the MIT License.")))) == WANTED
    out = jaccard_join.jaccard_components(docs)
    assert ids_of(out) == WANTED
    same = jaccard_join.jaccard_components(docs.filter("doc_id >= 9007199254740993").withColumn("text", F.lit("one two three four five six")))
    assert ids_of(same, "component_id") == [2**53 + 1]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert ids_of(html_extract.extracted(pages, html_model.Labeller()), "page_id") == WANTED


# --- columns of the caller


def test_columns_of_the_caller_stay(spark):
    names = ["line_cleaning", "pii", "PII_", "home", "rank", "cells", "pool", "into", "row", "doc", "taken", "tie", "_w", "_l", "_pii", "key2"]
    rows = [(i, f"Line {i} of a text that has more than twenty words in it, so that the rules of the base are met by it and it stays as it is.", f"k{i % 3}", *range(len(names))) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, text string, key string, " + ", ".join(f"`{n}` long" for n in names))
    for out in (quality_rules.clean_lines(df), pii.pseudonymized(df), sharding.sharded(df, 3), packing.packed(df.withColumn("doc_id", F.col("id")).withColumn("piece", F.lit(0)).withColumn("length", F.col("id") + 1))):
        assert set(df.columns) <= set(out.columns)
        assert {tuple(r) for r in out.select(*[F.col(f"`{n}`") for n in names]).distinct().collect()} == {tuple(range(len(names)))}
        assert out.count() == 9
    replaced = quality_rules.clean_lines(df.withColumn("n_words", F.lit("x"))).schema["n_words"].dataType.simpleString()
    assert replaced == "bigint"
    assert sharding.sharded(df.withColumn("shard", F.lit("x")), 3).schema["shard"].dataType.simpleString() == "int"


# --- long texts


def test_long_texts(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(5000)}" for _ in range(150_000)]
    notice = license_scan.TEMPLATES["Apache-2.0"]
    texts = ["x@" + "a." * 100_000 + "1", "1" * 1_000_000, "1 " * 100_000, "@" * 300_000, "a." * 300_000, " ".join(words), "\n".join(" ".join(words[i : i + 9]) + "." for i in range(0, 90_000, 9)), (notice + "\n") * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8).cache()
    plain = {row["doc_id"]: row["text"] for row in pii.pseudonymized(df, counts=False).collect()}
    assert all(plain[i] == texts[i] for i in (0, 1, 3, 4, 5))
    counted = {row["doc_id"]: row for row in quality_rules.clean_lines(df).select("doc_id", "n_words", "kept").collect()}
    assert counted[5]["n_words"] == 150_000 and counted[6]["kept"]
    found = license_scan.scanned(df).collect()
    assert {(x.doc_id, x.license) for x in found if x.license == "Apache-2.0"} == {(7, "Apache-2.0")}
    assert jaccard_join.jaccard_components(df).count() == len(texts)
    scores = compression_quality.scored(df, compression_quality.Model(b"abc def" * 99, b"xyz uvw" * 99, np.zeros(6), np.zeros(5), np.ones(5), 0.5))
    assert scores.count() == len(texts)
    df.unpersist()


@pytest.mark.parametrize("html", ["<div>x" * 100_000, "<svg>" * 50_000 + "x", "</p>" * 50_000 + "<li>" * 50_000 + "y", "<a b='" * 50_000, "<div class='" + "c " * 100_000 + "'>z</div>"])
def test_hostile_pages_take_time_in_proportion(html):
    page = blocks(html)
    x = html_model.vectors(page)
    assert np.isfinite(x).all() and len(x) == len(page)


def test_all_ancestors_count():
    near, far = (blocks(f"<{tag} class='comments'>" + "<div>" * 14 + "text")[0] for tag in ("section", "div"))
    none = blocks("<div>" * 15 + "text")[0]
    v = [html_model._path_vector(b.place) for b in (near, far, none)]
    assert np.abs(v[0] - v[2]).sum() > 0.1 and np.abs(v[1] - v[2]).sum() > 0.1


# --- 4 PII against a plain Python version


def feistel(a, b, spans, label, key="k"):
    half = [a, b]
    for i in range(8):
        own, other = (0, 1) if i % 2 == 0 else (1, 0)
        h = int(hashlib.sha256(f"{key}|{label}|{i}|{half[other]}".encode()).hexdigest()[:15], 16)
        half[own] = (half[own] + h % spans[own]) % spans[own]
    return half


def digits(d, label, key="k"):
    n, m = len(d) // 2, len(d) - len(d) // 2
    a, b = feistel(int(d[:n]), int(d[n:]), (10**n, 10**m), label, key)
    return f"{a:0{n}d}{b:0{m}d}"


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(int(c) for c in d[::-1])) % 10


def refill(value, new):
    new = iter(new)
    return re.sub(r"\d", lambda _: next(new), value)


def python_pseudonym(kind, value):
    d = re.sub(r"\D", "", value)
    if kind == "card":
        body = digits(d[:-1], "card")
        return refill(value, body + str((10 - luhn(body + "0")) % 10))
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        a, b = feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), "ssn")
        return f"{a + (2 if a > 664 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "phone":
        code = re.match(rf"({pii.COUNTRY}|\d{{3}})", d)[1] if value.startswith("+") else ("1" if len(d) == 11 else "")
        return refill(value, code + digits(d[len(code) :], "phone"))
    if kind == "ipv4":
        p = [int(x) for x in value.split(".")]
        a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], (65536, 65536), "ipv4")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        first = datetime.date(1900, 1, 1)
        n = (datetime.date.fromisoformat(value) - first).days
        while True:
            a, b = feistel(n // 271, n % 271, (271, 271), "date")
            n = a * 271 + b
            if n < 73049:
                return (first + datetime.timedelta(n)).isoformat()
    if kind == "iban":
        t = value.replace(" ", "")
        body = refill(t[4:], digits(re.sub(r"\D", "", t[4:]), "iban"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + t[:2] + "00")) % 97
        return refill(value, f"{check:02d}" + re.sub(r"\D", "", body))
    raise ValueError(kind)


def made_values(r):
    for _ in range(60):
        body = "".join(str(r.randrange(10)) for _ in range(r.choice([14, 15])))
        d = body + str((10 - luhn(body + "0")) % 10)
        yield "card", d if r.random() < 0.5 else " ".join(d[i : i + 4] for i in range(0, len(d), 4))
        yield "ssn", f"{r.choice([1, 123, 665, 667, 899]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
        n = "".join(str(r.randrange(10)) for _ in range(10))
        yield "phone", r.choice(["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+1 {}-{}-{}", "+1{}{}{}", "1-{}-{}-{}"]).format(n[:3], n[3:6], n[6:])
        yield "phone", f"+49 {r.randint(30, 99)} {r.randint(10**6, 10**7)}"
        yield "ipv4", ".".join(str(r.randrange(256)) for _ in range(4))
        yield "date", (datetime.date(1900, 1, 1) + datetime.timedelta(r.randrange(73049))).isoformat()
    for _ in range(400):
        b = "".join(str(r.randrange(10)) for _ in range(18))
        t = f"DE{98 - int(b + '131400') % 97:02d}{b}"
        yield "iban", t if r.random() < 0.3 else " ".join(t[i : i + 4] for i in range(0, len(t), 4))


def test_pseudonyms_equal_the_python_version(spark):
    r = random.Random(8)
    values = list(made_values(r))
    texts = [f"before {v}; after" for _, v in values]
    got = [x["text"] for x in pii.pseudonymized(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), key="k").orderBy("id").select("text").collect()]
    assert got == [f"before {python_pseudonym(k, v)}; after" for k, v in values]
    for (kind, v), g in zip(values, got, strict=True):
        if kind == "iban":
            t = g[7:-7].replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1, (v, t)


def test_values_beside_words_numbers_and_marks(spark):
    """Whatever stands on either side of a value that doesn't join it, the value goes and its surroundings stay."""
    r = random.Random(11)
    cases = []
    for kind, v in [x for x in made_values(r) if x[0] in ("card", "iban", "date", "phone", "ipv4")][:400]:
        alone = kind not in ("card", "iban") or " " in v
        before = r.choice(["", "see ", "No. 1 ", "(", "qty 12 ", "\n"] if kind == "card" and alone else ["", "see ", "(", "x: ", "\n"])
        after = r.choice({"card": [" 12", " 7 items", ".", ")", ", 5", " x"] if alone else [".", " x"], "iban": [" BANK", " AND", " for", ".", " X"] if alone else [" BANK", "."], "date": ["T10:00:00Z", "T23:59", ".", " 5"]}.get(kind, [".", " x", ")", ", 5"]))
        cases.append((kind, v, before, after))
    df = spark.createDataFrame([(i, b + v + a) for i, (_, v, b, a) in enumerate(cases)], "id long, text string")
    got = [x["text"] for x in pii.pseudonymized(df, key="k").orderBy("id").select("text").collect()]
    assert got == [b + python_pseudonym(k, v) + a for k, v, b, a in cases]


def test_leaks_of_an_earlier_round_and_what_is_no_value(spark):
    gone = ["ES91 2100 0418 4502 0005 1332 BANK", "qty 1 4111 1111 1111 1111", "4111 1111 1111 1111 12", "2021-01-05T10:00:00Z", "415 555 1234", "5 4111-1111-1111-1111 7 x", "a@b." + "c." * 40 + "com"]
    kept = ["1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18", "100 200 3000", "4111 1111 1111 1111x", "2021-01-05Text", "12 415 555 1234 5", "9" * 5000, "1 " * 5000, None, ""]
    got = [x["text"] for x in pii.pseudonymized(spark.createDataFrame(list(enumerate(gone + kept)), "id long, text string")).orderBy("id").collect()]
    assert all(g != t and re.sub(r"[^0-9]", "", g)[:12] != re.sub(r"[^0-9]", "", t)[:12] or "@" in t for g, t in zip(got, gone, strict=False)) and "b.c" not in got[len(gone) - 1]
    assert got[len(gone) :] == kept


def test_one_number_has_one_pseudonym(spark):
    forms = ["+1 415-555-1234", "415-555-1234", "(415) 555-1234", "+1 (415) 555-1234", "+14155551234", "1-415-555-1234", "415.555.1234"]
    out = pii.pseudonymized(spark.createDataFrame([(i, f"call {x}, please") for i, x in enumerate(forms)], "id long, text string")).collect()
    assert len({re.sub(r"\D", "", x["text"])[-10:] for x in out}) == 1
    assert all(x["n_phone"] == 1 and x["n_card"] == 0 for x in out)
    kept = ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "4111 1111 1111 1112", "300.1.1.1", "2021-02-30", "+1 55512"]
    same = pii.pseudonymized(spark.createDataFrame([(i, x) for i, x in enumerate(kept)], "id long, text string")).orderBy("id").collect()
    assert [x["text"] for x in same] == kept
    spark.conf.set(pii.KEY_CONF, "another key")
    try:
        other = pii.pseudonymized(spark.createDataFrame([(0, forms[1])], "id long, text string")).first()["text"]
    finally:
        spark.conf.unset(pii.KEY_CONF)
    assert other not in {x["text"] for x in out}


# --- 6 lines of any script


def test_lines_of_any_script_and_menus_of_any_language(spark):
    from chronolith.llm.quality_rules import line_fails

    good = ["هل هذا سطر؟", "यह एक वाक्य है।", "นี่คือประโยคภาษาไทย", "Ein Satz mit einer Fussnote.[1]", "A sentence with a mark.²", "これは文です。」", "Այս նախադասություն է։", 'He said "yes."', "Look at one/two or three / four kinds of things in this long sentence here / there, and go on."]
    bad = ["no end here", "Startseite › Produkte › Kontakt.", "Inicio | Noticias | Contacto.", "a » b » c.", "© 2024 Somebody.", "Alle Rechte vorbehalten.", "Nous utilisons des cookies.", "Lire la suite.", "Todos los derechos reservados.", "WOW! NOW! HERE!"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "line string")
    got = {r["line"]: r["f"] for r in rows.select("line", line_fails(F.col("line")).alias("f")).collect()}
    assert [x for x in good if got[x]] == [] and [x for x in bad if not got[x]] == []


# --- 3 licenses against all shingles


def test_license_retrieval_has_the_recall_of_an_exhaustive_scan(spark):
    r = random.Random(6)
    filler = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath", "inlet", "jetty"]
    rows = []
    for name, text in license_scan.TEMPLATES.items():
        for _ in range(8):
            w = text.split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = [r.choice(filler)] * r.choice([0, 1])
            pad = [r.choice(filler) for _ in range(60)]
            rows.append((len(rows), " ".join(pad[:30] + w + pad[30:])))

    def shingles(text):
        w = [x for x in re.split(license_scan.BREAK, text.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    wanted = {}
    for doc_id, text in rows:
        held = {n: len(shingles(t) & shingles(text)) / len(shingles(t)) for n, t in license_scan.TEMPLATES.items()}
        top = max(held.values())
        if top >= 0.75:
            wanted |= {(doc_id, n): c for n, c in held.items() if c == top}
    got = {(x.doc_id, x.license): x.containment for x in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c >= 0.75 for c in got.values())
    assert len(wanted) > 100 and len(wanted.keys() & got.keys()) / len(wanted) >= 0.98
    assert all(abs(got[k] - c) < 1e-9 for k, c in wanted.items() if k in got)


def test_rows_with_one_id_keep_their_own_licenses(spark):
    rows = [(1, "x " + license_scan.TEMPLATES["GPL-3.0-line"]), (1, license_scan.TEMPLATES["CC-BY-4.0-line"] + " y"), (None, license_scan.TEMPLATES["ISC"]), (None, license_scan.TEMPLATES["MPL-2.0"])]
    got = sorted(x["license"] for x in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == ["CC-BY-4.0-line", "GPL-3.0-line", "ISC", "MPL-2.0"]


# --- 9 search


def test_codes_of_several_words_and_few_verified(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((40, 150))
    v = centres[r.integers(0, 40, 600)] + 0.25 * r.standard_normal((600, 150))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    got = hamming_search.search(df, df.filter("id % 20 = 0"), 5).toPandas()
    bits = v > 0
    for q, g in got.groupby("query_id"):
        want = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(600) if i != q)[:5]
        assert list(zip(g.sort_values("rank")["distance"], g.sort_values("rank")["neighbor_id"], strict=True)) == want
    packed = np.packbits(np.pad(bits, ((0, 0), (0, 42))), axis=1, bitorder="little").view(np.uint64)
    index = hamming_search.MultiIndex(packed)
    verified = [index.nearest(packed[q], 6)[2] for q in range(0, 600, 20)]
    assert np.mean(verified) < 0.25 * 600


@pytest.mark.parametrize("n", [1, 3, 17, 500])
def test_index_covers_every_radius(n):
    r = np.random.default_rng(n)
    codes = r.integers(0, 1 << 63, (n, 2), dtype=np.uint64) & r.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    index = hamming_search.MultiIndex(codes)
    for q in codes[:5]:
        at, distance, _ = index.nearest(q, 4)
        every = np.sort(np.bitwise_count(codes ^ q).sum(axis=1))
        kth = every[min(4, n) - 1]
        assert sorted(distance.tolist()) == every[every <= kth].tolist() if n >= 4 else sorted(distance.tolist()) == every.tolist()


# --- 10 join: entries dealt over tasks, and groups over blocks


def test_join_with_hot_entries_and_blocks(spark, monkeypatch):
    from test_llm import brute, prose

    monkeypatch.setattr(jaccard_join, "PART", 2)
    monkeypatch.setattr(jaccard_join, "HOT", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "GROUP", 3)
    r = random.Random(3)
    base, rows = prose(r, 60).split(), []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(r, 30)) for i in range(20)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(repr(tuple(x)) for x in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


# --- 7 packing


def test_packing_is_near_its_bound_and_takes_runs():
    r = np.random.default_rng(2)
    for trial in range(20):
        counts = {int(k): int(n) for k, n in zip(r.integers(1, 1025, 40), r.integers(1, 50, 40), strict=True)}
        plan = packing.solve(counts)
        used = {}
        for lengths, runs in plan:
            assert sum(lengths) <= 1024
            for k in lengths:
                used[k] = used.get(k, 0) + runs
        assert used == counts
        bound = -(-sum(k * n for k, n in counts.items()) // 1024)
        large = sum(n for k, n in counts.items() if k > 512)
        assert sum(runs for _, runs in plan) <= max(bound, large) * 1.15 + 2
    assert len(packing.solve({700: 10**12, 310: 10**12})) <= 4


# --- empty tables


def test_every_query_takes_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    table(spark, path, [], SCHEMA)
    table(spark, path, [], "doc_id long, quality int, toxic int", "labels")
    table(spark, path, [], "page_id long, url string, html string", "pages")
    table(spark, path, [], "vec_id long, embedding array<float>, label int", "embeddings")
    import corpus_pipeline

    for name, query in (registry.QUERIES | {"pipeline": corpus_pipeline.run}).items():
        assert query(spark, path).count() == 0, name


def test_pipeline_with_odd_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    sentence = lambda: " ".join(f"w{r.randrange(400)}" for _ in range(30)) + "."
    rows = [(i % 5 if i % 3 else None, sentence() + "\n" + sentence(), "en", r.choice(["a", "b", None]), 5, "x") for i in range(60)]
    rows += [(7, None, None, None, None, None), (None, "", "en", "a", 0, None), rows[0], rows[0], (9, sentence() * 400, "de", "b", 1, "y")]
    docs = table(spark, str(tmp_path), rows, SCHEMA + ", row string")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) and (out.groupby("sequence_id")["length"].sum() <= 1024).all() and docs.count() == len(rows)


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    """Each stage on what the one before kept: lines and documents by the rules, one of each brute-force group, Python pseudonyms, whole pieces."""
    import corpus_pipeline as cp
    from test_llm import brute, prose

    r = random.Random(12)
    rows, base = [], [prose(r, 40) + "." for _ in range(8)]
    for i in range(90):
        text = r.choice(base).split() if i % 2 else (prose(r, 40) + ".").split()
        for _ in range(r.randrange(3)):
            text[r.randrange(len(text) - 1)] = f"y{r.randrange(30)}"
        lines = [" ".join(text), r.choice(["", "Home | About | Contact", "Accept all cookies to read more.", "no end of a sentence here"]), f"Call {r.choice(['415-555-1234', '(212) 555-7777'])} today please."]
        rows.append((i, "\n".join(lines), "en", r.choice(["a", "b", None]), 1))
    path = str(tmp_path)
    at = table(spark, path, rows, SCHEMA)
    out = {}
    for name, stage in cp.STAGES:
        stage(spark, at, path).write.parquet(f"{path}/{name}")
        at = out[name] = spark.read.parquet(f"{path}/{name}")

    def cleaned(text):
        keep = []
        for line in dict.fromkeys(x for x in text.split("\n") if x.strip()):
            parts, bars = line.split(" "), len(re.findall(quality_rules.SEPARATOR, line))
            end = line.rstrip(quality_rules.CLOSERS)[-1:] in [*quality_rules.TERMINAL]
            if end and not (bars >= 2 and len(parts) - bars <= 4 * (bars + 1)) and not (len(parts) <= 20 and re.search(quality_rules.BOILERPLATE, line)):
                keep.append(line)
        return "\n".join(keep)

    assert sorted(x["text"] for x in out["quality"].collect()) == sorted(cleaned(x[1]) for x in rows)
    numbered = [(x["row"], x["text"]) for x in cp._numbered(out["quality"]).collect()]
    firsts = {int(re.match(r"\((\d+), \d+, (\d+)\)", x)[1]) for x in brute(numbered) if re.match(r"\((\d+), \d+, \1\)", x)}
    kept = sorted(x["text"] for x in out["near_duplicates"].collect())
    assert kept == sorted(t for row, t in numbered if row in firsts) and len(kept) < len(rows)

    def hidden(text):
        return re.sub(r"\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}", lambda m: python_phone(m[0]), text)

    def python_phone(value):
        return refill(value, digits(re.sub(r"\D", "", value), "phone", pii.KEY))

    assert sorted(x["text"] for x in out["private_data"].collect()) == sorted(map(hidden, kept))
    mixed = collections.Counter(x["text"] for x in out["mix"].collect())
    assert set(mixed) <= set(map(hidden, kept)) and max(mixed.values()) <= 2 * max(collections.Counter(map(hidden, kept)).values())
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for text, n in mixed.items():
        ids = np.asarray([*encode(text), 2], "<u4")
        want[(len(ids), zlib.crc32(ids.tobytes()))] += n
    packed = out["pack"].toPandas()
    assert collections.Counter(zip(packed["length"].tolist(), packed["ids_crc32"].tolist(), strict=True)) == want
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024


def test_special_tokens_in_a_text_are_as_the_tokenizer_has_them():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = packing.encoder(path), Tokenizer.from_file(path)
    for text in ("<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y  z", "a\n\n <|endoftext|>\n", "<|endoftext", "\u00e9  1234's"):
        assert list(own(text)) == plain.encode(text, add_special_tokens=False).ids


def test_intermediate_tables_are_cleared(spark):
    """What sharding writes in its rounds lies where clear_intermediate deletes."""
    from chronolith.session import clear_intermediate, intermediate_dir, shared_dir

    def names():
        path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return {x.getPath().getName() for x in system.listStatus(path)} if system.exists(path) else set()

    before = names()
    df = spark.createDataFrame([(i, f"text {i % 4}") for i in range(40)], "id long, key string")
    assert sharding.sharded(df, 3).count() == 40
    own = intermediate_dir(spark).rpartition("/")[2]
    assert names() - before <= {own}
    clear_intermediate(spark)
    assert own not in names()
