"""Both substring deduplicators against brute force."""

import hashlib
import random
import re

import pytest

from strata.llm import debruijn, suffixes

from .conftest import frame, key, texts

LAST = 2**63 - 1


def first_docs(seqs, k):
    """window -> smallest document it starts in."""
    first = {}
    for d, s in seqs:
        for i in range(len(s) - k + 1):
            w = s[i:i + k]
            first[w] = min(first.get(w, LAST), d)
    return first


def marks(seq, d, first, k):
    out = [False] * len(seq)
    for i in range(len(seq) - k + 1):
        if first[seq[i:i + k]] < d:
            out[i:i + k] = [True] * k
    return out


def brute_bytes(docs, k):
    seqs = [(LAST if i is None else i, (t or "").encode()) for i, t in docs]
    first, out = first_docs(seqs, k), []
    for (i, _), (d, s) in zip(docs, seqs):
        m = marks(s, d, first, k)
        kept = bytes(b for b, x in zip(s, m) if not x)
        spans = sum(x and not (j and m[j - 1]) for j, x in enumerate(m))
        out.append((i, len(s), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(docs, k):
    seqs = [(LAST if i is None else i, tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in docs]
    first, out = first_docs(seqs, k), []
    for (i, _), (d, s) in zip(docs, seqs):
        m = marks(s, d, first, k)
        kept = " ".join(w for w, x in zip(s, m) if not x)
        out.append((i, len(s), sum(m), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def copies(spark):
    """Copies with edits, shared lines and passages, repeats inside one text."""
    rng = random.Random(11)
    voc = [f"v{i}" for i in range(60)]
    line = " ".join(rng.choices(voc, k=16))
    rows = []
    base = [rng.choices(voc, k=90) for _ in range(4)]
    for i in range(60):
        w = list(rng.choice(base)) if rng.random() < 0.6 else rng.choices(voc, k=rng.randint(5, 120))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(voc)
        t = " ".join(w)
        if rng.random() < 0.5:
            t = t[:rng.randint(0, len(t))] + " " + line + "\n" + t[rng.randint(0, len(t)):]
        if rng.random() < 0.1:
            t = t + " " + t
        rows.append((rng.randint(0, 50), t))
    return frame(spark, rows)


@pytest.mark.parametrize("chunk", [500, 8 << 20])
@pytest.mark.parametrize("data", ["odd", "empty", "copies"])
def test_bytes(request, spark, data, chunk):
    docs = copies(spark) if data == "copies" else request.getfixturevalue(data)
    got = suffixes.remove_repeats(docs, chunk_bytes=chunk, bucket_bytes=max(chunk // 2, 2000)).collect()
    assert key(map(tuple, got)) == key(brute_bytes(texts(docs), 50))


@pytest.mark.parametrize("chunk", [500, 8 << 20])
@pytest.mark.parametrize("data", ["odd", "empty", "copies"])
def test_words(request, spark, data, chunk):
    docs = copies(spark) if data == "copies" else request.getfixturevalue(data)
    got = debruijn.remove_repeats(docs, chunk_bytes=chunk, bucket_bytes=max(chunk // 2, 2000)).collect()
    assert key(map(tuple, got)) == key(brute_words(texts(docs), 13))


def test_whole_table(small):
    docs = texts(small)
    got = suffixes.remove_repeats(small, chunk_bytes=40_000).collect()
    want = brute_bytes(docs, 50)
    assert key(map(tuple, got)) == key(want) and any(w[2] for w in want)
    got = debruijn.remove_repeats(small, chunk_bytes=40_000).collect()
    want = brute_words(docs, 13)
    assert key(map(tuple, got)) == key(want) and any(w[2] for w in want)


def test_kept_text(odd):
    for r in debruijn.remove_repeats(odd, keep_text=True).collect():
        assert r["kept_text"] is None or hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    for r in suffixes.remove_repeats(odd, keep_text=True).collect():
        assert hashlib.sha256(bytes(r["kept_bytes"])).hexdigest() == r["kept_sha256"]
