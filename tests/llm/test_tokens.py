"""Token counts and packing against the libraries themselves."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strata.llm import packing, token_counts, tokens

from .conftest import key, texts

WORD, BYTE = tokens.default_path("word_bpe_49k.json"), tokens.default_path("byte_bpe_50k.json")


@pytest.mark.parametrize("data", ["odd", "small", "empty"])
def test_counts_equal_the_library(request, data):
    docs = request.getfixturevalue(data)
    lib = tokens.load(WORD)
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t in texts(docs)]
    got = [tuple(r) for r in token_counts.token_counts(docs, WORD, limit=50, table_size=100).collect()]
    assert key(got) == key(want)


def test_cache_begins_anew_when_full(small):
    rows = [t for _, t in texts(small)]
    import pyarrow as pa
    c = tokens.Counts(WORD, limit=50)
    got = np.concatenate([c(pa.array(rows[i:i + 20])) for i in range(0, len(rows), 20)])
    assert got.tolist() == [len(c.lib.encode(t, add_special_tokens=False).ids) for t in rows]


@pytest.mark.parametrize("data", ["odd", "small", "empty"])
def test_packing_round_trip(request, data):
    docs = request.getfixturevalue(data)
    cap = 64 if data == "odd" else 1024
    got = packing.pack_documents(docs, BYTE, capacity=cap).collect()
    lib = tokens.load(BYTE)
    want = []
    for i, t in texts(docs):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % cap + 1
        edges = [0, *range(first, len(ids) + 1, cap)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert key([tuple(r)[:5] for r in got]) == key(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= cap
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // cap) * 1.02 + 2


def test_fullest_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = Counter(rng.integers(1, 30, rng.integers(1, 7)).tolist())
        room = int(rng.integers(0, 60))
        items = [x for x, n in counts.items() for _ in range(n)]
        best = max(sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(1 << len(items))
                   if sum(x for k, x in enumerate(items) if m >> k & 1) <= room)
        got = packing.fullest(dict(counts), room)
        assert sum(x * n for x, n in got.items()) == best and all(counts[x] >= n for x, n in got.items())


def test_patterns_use_every_piece():
    rng = np.random.default_rng(4)
    counts = Counter(rng.integers(1, 101, 3000).tolist())
    used = Counter()
    for pattern, times in packing.bin_patterns(dict(counts), 100):
        assert sum(x * n for x, n in pattern.items()) <= 100
        for x, n in pattern.items():
            used[x] += n * times
    assert used == counts
