"""Decontamination, host reputation, licences and language ID."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.decontam import decontaminate, drop_contaminated
from quarry.llm.host_reputation import judge_urls, page_outcomes, reputation, suffix_labels
from quarry.llm.language_id import cluster, fit, held_out, identify, keep_identified, ngram_counts, predict
from quarry.llm.license_scan import scan_licenses

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination(spark, odd, empty, plain_rows, most):
    long = words(plain_rows[7][1])
    items = [(1, " ".join(long[5:22])), (2, " ".join(long[5:22])), (30, "lonely TEXT, of no id"), (4, "x"), (5, None), (6, "--"), (None, "12 34"), (7, "word " * 14), (8, "never seen " * 8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = Counter()
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            wins[(tuple(w[s : s + 10]), i)] = 1
    want = Counter()
    for d, t, *_ in plain_rows:
        w, hit, ids = words(t), set(), set()
        for win, i in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    ids.add(i)
        want[(d, len(w), len(hit), ",".join(sorted(str(i) for i in ids if i is not None)), bool(hit))] += 1
    got = decontaminate(odd, bench, broadcast_bytes=most)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got.collect()) == want
    left = drop_contaminated(odd, bench, broadcast_bytes=most)
    assert left.columns == odd.columns and left.count() == sum(n for k, n in want.items() if not k[4])
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1", "http://a.example.com/en/2?x", "https://example.com", "x://b.net/es/", "x://b.net/en/5", "x://b.net/fr#/es/", None, "nothing", "x://", "x://good.org/7", "x://bad.org/3", "x://notexample.com/en/", "x://bad.org/4#://c.com/"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    bad = spark.createDataFrame([("bad.org", 1)] * 40 + [("good.org", 0)] * 40 + [("good.org", None)], "host string, bad int")
    got = {r["page_id"]: tuple(r)[1:5] for r in judge_urls(pages, bad).collect()}
    assert got[0] == got[13] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/2", "example.com/en/", "block")
    assert got[2][:3] == ("example.com", "", None)
    assert got[3][2:] == ("net/es/", "block") and got[4][2] is None and got[5] == ("b.net", "/fr", None, got[5][3])
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8][:2] == ("", "")
    assert got[9] == ("good.org", "/7", None, "allow") and got[10] == ("bad.org", "/3", None, "block") and got[12][:2] == ("bad.org", "/4")
    assert got[11][2] == "com/"
    assert judge_urls(pages.limit(0), bad).count() == 0
    assert judge_urls(pages, bad.limit(0)).count() == 14
    labels = spark.createDataFrame([(5, 0, 0), (7, 1, 0), (7, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert Counter(map(tuple, page_outcomes(pages, labels).collect())) == Counter([("b.net", 1), ("good.org", 1)])


def test_public_suffixes(spark):
    rules = ("co.uk", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "gov")
    want = {"a.b.co.uk": 2, "co.uk": 2, "uk": 1, "x.y.ck": 2, "www.ck": 1, "a.www.ck": 1, "ck": 1, "a.b.kobe.jp": 3, "x.city.kobe.jp": 2, "kobe.jp": 1, "a.gov": 1, "": 1, "plain": 1}
    got = {r["h"]: r["n"] for r in spark.createDataFrame([(h,) for h in want], "h string").select("h", suffix_labels(F.col("h"), rules).alias("n")).collect()}
    assert got == want
    rows = [("a.one.co.uk", 1)] * 30 + [("b.one.co.uk", None), ("c.two.co.uk", 0)] * 30
    means = {r["host"]: r["mean"] for r in reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert means["b.one.co.uk"] > 0.7 > 0.3 > means["c.two.co.uk"]


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    odd = mit.replace("free of charge, ", "").replace("merge,", "merge, remix,").upper()
    texts = [None, "", "no licence", "é Released under the MIT License. Then, Licensed under CC BY-NC 4.0", "intro " * 50 + odd + " end", "Licensed under something else"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = scan_licenses(docs).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(3, "mit-notice"), (3, "cc-by-nc-4.0-notice"), (4, "mit-grant")]
    first = got[0]["spans"][0]
    assert texts[3].encode()[first["start"] : first["end"]] == b"Released under the MIT License"
    assert 0.9 < got[2]["coverage"] < 1 and len(got[2]["spans"]) >= 2
    assert scan_licenses(docs.limit(0)).count() == 0


def test_language(odd, empty, plain_rows):
    got = {}
    for r in identify(odd, sample_per_lang=50).collect():
        got.setdefault(r["doc_id"], r)
    texts = {r[0]: r for r in plain_rows}
    clear = [d for d, r in texts.items() if d is not None and 0 <= d < 60 and len(r[1]) > 100]
    assert sum(got[d]["lang_pred"] == texts[d][2] for d in clear) >= 0.95 * len(clear)
    for d in (104, 105, 106, 107):
        assert (got[d]["lang_pred"], got[d]["score"], got[d]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = keep_identified(odd)
    assert kept.columns == odd.columns and {104, 105, 106, 107}.isdisjoint({r["doc_id"] for r in kept.select("doc_id").collect()})
    assert identify(empty).count() == 0
    assert {r["lang_pred"] for r in identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_against_plain_vectors(spark, sf):
    """idf, weights and cosines by plain loops, with the model's centroids; ties and repeated rows; held-out accuracy."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(120)
    docs = docs.unionByName(docs.limit(10)).cache()
    model, dims = fit(docs, dims=512), 512

    def features(text):
        flat = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(flat) - n + 1):
                if flat[i : i + n] != " ":
                    code = 0
                    for c in flat[i : i + n]:
                        code = (code << 21) | ord(c)
                    code = (code + n) * 0x9E3779B97F4A7C15 % 2**64
                    out[((code ^ (code >> 31)) * 0xD6E8FEB86659FD93 % 2**64) >> 55] += 1
        return out

    rows = docs.collect()
    each = [features(r["text"] or "") for r in rows]
    df = Counter(f for e in each for f in e)
    n, far = sum(bool(e) for e in each), {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs, model).collect()}
    for r, e in zip(rows, each):
        v = {f: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[f])) + 1) for f, k in e.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[f]) for f, x in v.items()) / size for c in model["centroids"]]
        lang, score = far[r["doc_id"]]
        assert math.isclose(score, max(cos), abs_tol=1e-4) and lang in {model["langs"][model["of"][i]] for i, x in enumerate(cos) if x > max(cos) - 1e-5}
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    judged = identify(whole).join(whole.select("doc_id", "lang"), "doc_id").filter(held_out("doc_id") & F.col("lang").isNotNull() & (F.col("lang_pred") != "und")).collect()
    assert len(judged) > 10 and sum(r["lang_pred"] == r["lang"] for r in judged) >= 0.97 * len(judged)


def test_ngrams_of_parts_are_those_of_the_whole(monkeypatch):
    import quarry.llm.language_id as m

    text = "Élan 7 vital, über alles " * 40
    whole = ngram_counts(text, 512)
    monkeypatch.setattr(m, "_PART", 17)
    assert (ngram_counts(text, 512) == whole).all() and ngram_counts("42 !", 512) is None


def test_clusters_leave_outliers_out():
    x = np.abs(np.random.default_rng(1).normal(size=(200, 64))) + 1
    x[5] = 0
    x[5, 3] = 1
    c = cluster(x / np.linalg.norm(x, axis=1, keepdims=True), 4)
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and (c @ x[5]).max() < 0.5


@pytest.mark.parametrize("notice", ["Released under the MIT License", None])
@pytest.mark.parametrize("between", ["", "(c) 2020.", "one two three"])
def test_repeated_notices_are_all_found(notice, between):
    from quarry.llm.license_scan import Index, scan_text
    from quarry.llm.license_templates import TEMPLATES

    index = Index(TEMPLATES, 3, 3)
    for text in [notice] if notice else TEMPLATES.values():
        one = scan_text(text, index, 8, 0.8)
        for n in (2, 3, 7):
            got = scan_text("Before. " + f"\n{between} ".join([text] * n) + " after", index, 8, 0.8)
            assert [(m["license"], m["matched"]) for m in got] == [(m["license"], m["matched"]) for m in one] * n
            assert all(a["spans"][-1]["end"] < b["spans"][0]["start"] for a, b in zip(got, got[1:]))
