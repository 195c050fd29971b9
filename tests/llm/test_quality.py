"""Quality rules against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from strata.llm import quality

from .conftest import frame, key, texts

BLANK = " \t\n\x0b\x0c\r"


def base(t):
    t = t or ""
    w = [x for x in re.split(f"[{BLANK}]+", t) if x]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    rep = {p for i, x in enumerate(wins) if n[x] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.strip(BLANK)]
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), failed


@pytest.mark.parametrize("data", ["odd", "small", "empty"])
def test_base_counts(request, data):
    docs = request.getfixturevalue(data)
    got = quality.judge(docs).collect()
    assert key(tuple(r)[:7] for r in got) == key((i, *base(t)) for i, t in texts(docs))
    assert all(not (r["kept"] and r["base_failed"]) for r in got)


def js(p, q):
    p, q = np.array(p, float) / max(sum(p), 1), np.array(q, float) / max(sum(q), 1)
    m = (p + q) / 2
    part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
    return np.sqrt(max((part(p) + part(q)) / 2, 0))


def classes(t):
    letters, capitals = sum(c.isalpha() for c in t), sum(c.isupper() for c in t)
    digits, blank, symbols = sum(c.isdecimal() for c in t), sum(c in BLANK for c in t), sum(c in "#*$%&|<>" for c in t)
    return [letters - capitals, capitals, digits, blank, symbols, len(t) - letters - digits - blank - symbols]


def test_distances(spark):
    rng = np.random.default_rng(0)
    voc = ["the", "of", "and", "in", "It", "was", "a1", "b2."]
    rows = [(i, " ".join(rng.choice(voc, rng.integers(60, 90), p=np.array([8, 7, 6, 5, 4, 3, 2, 1]) / 36))) for i in range(30)]
    rows += [(98, " ".join(f"{k}###$$$" for k in range(80))), (99, " ".join(f"zz{k}" for k in range(200)))]
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, rows), common=3).collect()}
    every = np.sum([classes(t) for _, t in rows], axis=0)
    counts = Counter(w for _, t in rows for w in t.split())
    top = [w for w, _ in counts.most_common(3)]
    hist = {i: [t.split().count(x) for x in top] for i, t in rows}
    hist = {i: [*h, len(dict(rows)[i].split()) - sum(h)] for i, h in hist.items()}
    whole = np.sum(list(hist.values()), axis=0)
    for i, t in rows:
        assert np.isclose(got[i]["char_js"], js(classes(t), every)) and np.isclose(got[i]["word_js"], js(hist[i], whole))
    assert not got[98]["kept"] and not got[98]["base_failed"] and all(got[i]["kept"] for i in range(30) if not got[i]["base_failed"])


def test_junk_goes_and_clean_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1]
    assert np.mean(clean) > 0.99


def test_texts_without_common_words_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    strange = [(10**6 + i, " ".join(f"zz{x}{k}" for k in range(n)), x, "", n) for i, (x, n) in enumerate(
        (x, n) for x in ("en", "de", "es", "fr") for n in (60, 400))]
    got = {r["doc_id"]: r for r in quality.judge(docs.union(spark.createDataFrame(strange, docs.schema))).collect()}
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i, *_ in strange)
    assert not got[244]["kept"] and not got[660]["kept"]  # words between '|', in French
    by_lang = docs.join(labels.where("quality = 1"), "doc_id").select("doc_id", "lang").collect()
    for x in ("en", "de", "es", "fr"):
        clean = [got[r["doc_id"]]["kept"] for r in by_lang if r["lang"] == x and not got[r["doc_id"]]["base_failed"]]
        assert len(clean) > 20 and np.mean(clean) > 0.98


def test_rare_common_words_need_long_texts(spark):
    # each word is rare in its language: a text of 50 words may well have none of the common ones
    rows = [(i, " ".join(f"w{(i * 61 + k * 7) % 3001}" for k in range(60))) for i in range(60)]
    assert all(r["kept"] for r in quality.judge(frame(spark, rows)).collect())


def test_common_words_are_exact_and_ties_go_by_word(spark):
    # 30,000 words once each, then two ties: more words than a sketch would follow
    rows = [(i, " ".join(f"r{i}_{k}" for k in range(1000)) + " zb zb zb za za za zd zc zd zc") for i in range(30)]
    docs = frame(spark, rows)
    for parts in (1, 7):
        got = quality.features(docs.repartition(parts), "doc_id", "text", "lang", 3).collect()
        assert all(r["common"] == [3, 3, 2, 0, 1002] for r in got)  # za, zb, zc


def test_native_plan(spark, small, capsys):
    quality.judge(small).explain()
    assert "Python" not in capsys.readouterr().out
