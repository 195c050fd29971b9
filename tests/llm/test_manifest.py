"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest

from strata.llm import merkle

from .conftest import frame, key


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, path of each leaf as (left, right) hex lists per level)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + 3]) for i in range(0, len(last), 3)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            a = i - i % 3
            path.append((level[a:i], level[i + 1:a + 3]))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = tree([leaf(r) for r in groups[s]])
    root, tops = tree([built[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        sub, paths = built[s]
        for r, path in zip(groups[s], paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            own = leaf(r[:4] + (r[4].replace("\n", "") if r[4] is not None else None,)) if bad else leaf(r)
            shared = []
            for left, right in path + top:
                own = h(*left, own, *right)
                shared += left + right
            out.append((r[0], leaf(r), sub, root, h(*shared), own, own == root))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("data", ["small", "odd"])
def test_proofs(request, data):
    df = request.getfixturevalue(data)
    if "n_chars" not in df.columns:
        df = df.selectExpr("*", "cast(length(text) as long) as n_chars")
    got = merkle.proofs(df).collect()
    want = brute(rows_of(df))
    assert key(map(tuple, got)) == key(want)
    assert data == "odd" or {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4, 1, 27], [243, 244, 1], [730, 2, 81]])
def test_shapes(spark, sizes):
    """Groups that fill blocks, just exceed them, or are a lone leaf; the last name is null."""
    rows = [(1000 * g + i, None if g == len(sizes) - 1 else f"é{g}", "en", i, f"line {i}\nof {g}") for g, n in enumerate(sizes) for i in range(n)]
    assert key(map(tuple, merkle.proofs(docs(spark, rows)).collect())) == key(brute(rows))


def test_many_groups_and_repeated_rows(spark):
    rows = [(i // 3, f"s{i % 250:03}", None, None, "same\n") for i in range(700)] + [(None, "s000", None, 1, None)] * 40
    assert key(map(tuple, merkle.proofs(docs(spark, rows)).collect())) == key(brute(rows))


def test_string_ids_dotted_columns_empty(spark):
    df = spark.createDataFrame([("b", "x", "t\n"), ("a", "x", "u")], "doc_id string, source string, text string")
    df = df.selectExpr("*", "cast(null as string) as lang", "1L as n_chars", "'y' as `tree`", "'z' as `a.b`", "3 as pos")
    got = {r["doc_id"]: r for r in merkle.proofs(df).collect()}
    leaves = [leaf(("a", "x", None, 1, "u")), leaf(("b", "x", None, 1, "t\n"))]
    assert got["a"]["root"] == got["b"]["root"] == h(*leaves) and got["a"]["proof_sha256"] == h(leaves[1])
    assert merkle.proofs(docs(spark, [])).count() == 0


def test_nodes_and_versions_share(spark):
    rows = [(i, "a" if i < 300 else "b", "en", 1, f"t\n{i}") for i in range(330)]
    m = merkle.Manifest(docs(spark, rows), changes={"text": merkle.F.lit("new")}, changed=merkle.F.col("doc_id") == 17)
    nodes = {(r["source"], r["level"], r["pos"]): r["digest"] for r in m.nodes().where("not is_root_tree").collect()}
    levels = {}
    for s, lvl, _ in nodes:
        levels[s, lvl] = levels.get((s, lvl), 0) + 1
    assert [levels["a", i] for i in range(7)] == [300, 100, 34, 12, 4, 2, 1] and ("a", 7) not in levels
    assert [levels["b", i] for i in range(5)] == [30, 10, 4, 2, 1]
    for (s, lvl, p), d in nodes.items():
        if lvl:
            assert d == h(*(nodes[s, lvl - 1, c] for c in range(3 * p, 3 * p + 3) if (s, lvl - 1, c) in nodes))
    version = m.versions().where("changed is not null").collect()
    assert len(version) == 1 and len(version[0]["copied"]) == 7
    known = set(nodes.values()) | {r["digest"] for r in m.nodes().where("is_root_tree").collect()}
    assert set(version[0]["shared"]) <= known and not set(version[0]["copied"]) & known
    assert m.root().first()["root"] == version[0]["root"] and m.subroots().count() == 2
