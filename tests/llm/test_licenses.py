"""License scans against brute force over words and templates."""

import random
import re
import string

import pytest

from strata.llm import licenses
from strata.llm.license_texts import PHRASES, TEMPLATES

from .conftest import frame, key, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
FULL = {i: " ".join(t.split()) for i, (_, _, t) in enumerate(TEMPLATES)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, phrases=PHRASES, given=TEMPLATES):
    known = [(x, True, words(p), words(p)) for x, p in phrases] + [(x, False, words(t), words(k)) for x, k, t in given]
    out = []
    for d, text in docs:
        w = words(text)
        base, labels, share = [], [], 0.0
        for label, is_base, t, keys in known:
            n, k = len(t), min(4, len(t))
            if not n:
                continue
            grams = {}
            for q in range(n - k + 1):
                grams.setdefault(tuple(t[q:q + k]), []).append(q)
            lines = {}
            for p in range(len(w) - k + 1):
                for q in grams.get(tuple(w[p:p + k]), ()):
                    lines.setdefault(p - q, set()).add(q)
            groups = []
            for line in sorted(lines):
                if groups and line - groups[-1][-1] <= n // 20:
                    groups[-1].append(line)
                else:
                    groups.append([line])
            at = next(i for i in range(n) if t[i:i + len(keys)] == keys)
            for g in groups:
                places = {q + j for line in g for q in lines[line] for j in range(k)}
                start, end = min(x + q for x in g for q in lines[x]), max(x + q + k for x in g for q in lines[x])
                if 10 * len(places) >= (9 if n < 20 else 6) * n and set(range(at, at + len(keys))) <= places and end - start <= 2 * n:
                    labels.append(label)
                    share = max(share, len(places) / n)
                    if is_base:
                        base.append((start, label))
        starts = [s for s, _ in base]
        out.append((d, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(set(labels))), share))
    return out


def planted():
    rng = random.Random(3)
    plain = [f"v{i}" for i in range(80)]
    say = lambda n: " ".join(rng.choices(plain, k=n))
    rows = []
    for i, t in FULL.items():
        rows.append((100 + i, f"{say(30)} {t} {say(20)}"))
        body = t.split()
        holes = [x for j, x in enumerate(body) if j % 23 != 11]
        rows.append((200 + i, f"{say(5)}\n{' '.join(holes)}\n{say(5)}"))
        more = [y for j, x in enumerate(body) for y in ((x, "extra") if j % 29 == 13 else (x,))]
        rows.append((300 + i, " ".join(more).upper()))
        rows.append((400 + i, f"{t} {say(3)} {t} {t}"))
        rows.append((500 + i, " ".join(body[:len(body) // 3])))
        rows.append((600 + i, " ".join(rng.sample(body, len(body)))))
    rows += [(1, "MIT License mit-license; the mit. LICENSE mit"), (2, "general public  license, Apache License"), (3, "mit"), (4, "mit licenses"), (4, "MIT license")]
    return rows


@pytest.mark.parametrize("data", ["small", "odd", "planted", "empty"])
def test_documents(request, spark, data):
    df = frame(spark, planted()) if data == "planted" else request.getfixturevalue(data)
    assert key(map(tuple, licenses.scan(df).collect())) == key(brute(texts(df)))


def test_each_template_is_found_and_told_from_its_relatives(spark):
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, planted())).collect()}
    for i, (label, _, _) in enumerate(TEMPLATES):
        found = set(got[100 + i]["labels"].split(","))
        relatives = {"gpl"} if label in ("lgpl", "agpl") else set()
        assert label in found and found <= {label} | relatives and got[100 + i]["score"] == 1.0
        assert got[600 + i]["labels"] in ("", got[600 + i]["base_labels"])


def test_own_templates_shuffled_join_and_odd_columns(spark, monkeypatch, odd):
    known = licenses.templates(spark, [("x", "w1"), ("none", "!!")], [("y", "b c d e f", "a b c d e f g")])
    df = spark.createDataFrame([("k", "W1 a b c d e f g"), (None, "w1 w1"), (None, "w1 w1"), ("e", "")], "doc_id string, text string").selectExpr("*", "1 as `a.b`", "2 as grams", "3 as t")
    want = brute(texts(df), [("x", "w1")], [("y", "b c d e f", "a b c d e f g")])
    assert key(map(tuple, licenses.scan(df, known=known).collect())) == key(want)
    monkeypatch.setattr(licenses, "MOST_BROADCAST", -1)
    assert key(map(tuple, licenses.scan(df, known=known).collect())) == key(want)
    nothing = licenses.scan(odd, known=known.limit(0)).collect()
    assert len(nothing) == odd.count() and not any(r["labels"] for r in nothing)
