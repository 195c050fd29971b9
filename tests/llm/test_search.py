"""Ranked lexical search against brute force."""

import math
import re
import string
from collections import Counter

import pytest

from strata.llm import search

from .conftest import frame, key, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(t):
    return [x.translate(LOWER) for x in TERM.findall(t or "")]


def brute(docs, items, k=50):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in by_item.items():
        scored = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in ts if t in b)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        scored.sort(key=lambda x: x[:3])
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block", [10**6, 300])
def test_small(spark, small, benchmark, block):
    got = search.search(small, benchmark, block_postings=block).collect()
    assert key(map(tuple, got)) == key(brute(texts(small), [(r["item_id"], r["text"]) for r in benchmark.collect()]))


def test_odd(spark, odd, empty):
    rows = [(1, None), (2, ""), (3, "W1 w2, w3"), (None, "éé"), (5, "x don't"), (5, "日本語 one"), (6, "a a a"), (7, "!!"), (8, "absent-entirely")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    got = search.search(odd, items, k=5)
    assert key(map(tuple, got.collect())) == key(brute(texts(odd), rows, 5))
    assert search.search(empty, items).count() == 0 and search.search(odd, items.limit(0)).count() == 0
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_large_classes_and_ties(spark):
    """A class of a third of the rows, repeated ids, and equal scores of different classes."""
    rows = [(i % 211, "alpha beta") for i in range(400)] + [(i, "alpha gamma") for i in range(60)] + [(i, f"beta w{i} w{i}") for i in range(300)]
    items = [(1, "alpha"), (2, "beta"), (3, "beta gamma w7"), (4, "w1 w2 w3 w4 w5 w6 alpha")]
    got = search.search(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert key(map(tuple, got)) == key(brute(rows, items))


def test_string_ids_and_dotted_columns(spark):
    rows = [("b", "one two"), ("a", "one two"), (None, "one"), ("c", "three")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as `a.b`", "2 as vec", "3 as score")
    items = spark.createDataFrame([("q", "two three")], "item_id string, text string").selectExpr("*", "1 as `x.y`", "2 as term")
    got = search.search(df, items).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == ["c", "a", "b"]


def test_one_long_text(spark):
    rows = [(1, "needle " + "hay " * 200_000), (2, "needle"), (3, "straw")]
    items = [(1, "needle hay")]
    got = search.search(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert key(map(tuple, got)) == key(brute(rows, items))
