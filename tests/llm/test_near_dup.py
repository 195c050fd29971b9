"""Near duplicates against all pairs by brute force."""

import random
import string

import numpy as np
import pytest

from strata.llm import near_dup

from .conftest import frame, key, texts

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = " \t\n\x0b\x0c\r"


def shingles(t):
    for c in SPACE:
        t = (t or "").translate(LOWER).replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            b = docs[j][0]
            n = len(sets[i] & sets[j])
            if a is not None and b is not None and n and 100 * n >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    comp = {i: root(i) for i in parent}
    return [(i, len(s), comp.get(i), i is None or comp[i] == i) for (i, _), s in zip(docs, sets)]


def star(spark):
    """A base, copies that are near it but not near each other, and chains."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(400)]
    rows = [(500, " ".join(base))]
    for i in range(40):
        w = list(base)
        a = rng.randrange(360)
        w[a:a + 40] = [f"x{i}_{j}" for j in range(40)]
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        rows.append((600 - i, " ".join(chain[i * 5:] + [f"n{j}" for j in range(i * 5)])))
    for i in range(30):
        rows.append((700 + i, " ".join(f"u{rng.randrange(5)}" for _ in range(rng.randint(1, 9)))))
    return frame(spark, rows)


@pytest.mark.parametrize("data", ["odd", "small", "empty", "star"])
def test_components(request, spark, data):
    docs = star(spark) if data == "star" else request.getfixturevalue(data)
    got = near_dup.near_duplicates(docs).collect()
    assert key(map(tuple, got)) == key(brute(texts(docs)))


def test_signature_agrees_with_similarity():
    rng = np.random.default_rng(1)
    for n, shared in ((4, 3), (40, 32), (2000, 1600)):
        same = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], pool[n:2 * n - shared]]))
            s = near_dup.signatures([a, b], 128)
            same.append((s[0] == s[1]).mean())
        assert abs(np.mean(same) - shared / (2 * n - shared)) < 0.06


def test_one_value_sets_fill_all_bins():
    s = near_dup.signatures([np.array([5], np.uint64), np.array([2**64 - 9], np.uint64)], 128)
    assert (s[0] == 5).all() and (s[1] == 2**64 - 9).all()


def test_links_across_components_without_all_pairs(spark, monkeypatch):
    """A hot group of copies, sets that share half of its shingles, and sets just at the threshold: the
    prefix join finds every link between components and makes few other pairs."""
    rng = np.random.default_rng(9)
    base = rng.integers(-2**62, 2**62, 120)
    fresh = lambda n: rng.integers(-2**62, 2**62, n)
    rows = [(i, 0, np.concatenate([base[5:], fresh(5)])) for i in range(150)]
    rows += [(1000 + i, 1000 + i, np.concatenate([rng.permutation(base)[:60], fresh(60)])) for i in range(60)]
    rows += [(2000 + i, 2000 + i, np.concatenate([base[:120 - i], fresh(i)])) for i in range(8, 30)]
    rows += [(3000, 3000, base[:4]), (3001, 3001, base[:3]), (3002, 3002, base[:1]), (3003, 3003, base[:1])]
    rows += [(3004, 3004, fresh(30)), (3004, 3004, base[:110])]  # one id with two sets
    sets = spark.createDataFrame([(r, c, j, np.sort(s).tobytes()) for j, (r, c, s) in enumerate(rows)], "rep long, component long, set long, shingles binary")
    monkeypatch.setattr(near_dup, "SALT", 16)
    got = [tuple(r) for r in near_dup.prefix_pairs(sets, 75).collect()]
    want, every = set(), 0
    for i, (a, ca, x) in enumerate(rows):
        for b, cb, y in rows[:i]:
            if ca != cb:
                every += 1
                n = len(np.intersect1d(x, y))
                if 100 * n >= 75 * (len(x) + len(y) - n):
                    want.add((min(a, b), max(a, b)))
    assert want <= set(got) and len(want) > 100
    assert len(got) == len(set(got)) < every / 5
