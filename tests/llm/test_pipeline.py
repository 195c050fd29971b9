"""The pipeline's stages against brute force, each on what the one before kept."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from strata.llm import quality, secrets, tokens

from .conftest import SMALL, frame, key, odd_rows, texts
from .test_near_dup import brute as brute_components
from .test_quality import base
from .test_scans import brute as brute_hits


def both(df):
    return key(texts(df))


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    secret = F.when(F.col("doc_id") % 10 == 0, F.lit(' token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" end')).otherwise("")
    docs = docs.withColumn("text", F.concat("text", secret)).withColumn("n_chars", F.length("text").cast("long"))
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], SMALL).checkpoint())
    return out


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_quality_stage(steps):
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(steps[0]).collect()}
    assert all(not verdict[i] for i, t in texts(steps[0]) if base(t)[5])
    assert both(steps[1]) == key((i, t) for i, t in texts(steps[0]) if verdict[i])
    assert 0 < steps[1].count() < steps[0].count()


def test_near_duplicate_stage(steps):
    kept = {r[0] for r in brute_components(texts(steps[1])) if r[3]}
    assert both(steps[2]) == key((i, t) for i, t in texts(steps[1]) if i in kept)
    assert steps[2].count() < steps[1].count()


def test_decontamination_stage(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute_hits(texts(steps[2]), items, 10) if r[5]}
    assert hit and both(steps[3]) == key((i, t) for i, t in texts(steps[2]) if i not in hit)


def test_secret_stage(steps):
    before, after = dict(texts(steps[3])), dict(texts(steps[4]))
    assert before.keys() == after.keys()
    novelty = secrets.Novelty()
    changed = 0
    for i, t in before.items():
        spans = secrets.base_spans(t)
        spans = sorted(spans + secrets.novel_spans(t, spans, novelty))
        if spans:
            changed += 1
            assert all(t[a:b] not in after[i] for a, _, b in spans) and "[SECRET]" in after[i]
        else:
            assert after[i] == t
    for r in steps[4].collect():
        assert r["n_chars"] == len(r["text"])
    assert changed


def test_packing_stage(spark, steps):
    lib = tokens.load(tokens.default_path("byte_bpe_50k.json"))
    want = {}
    for i, t in texts(steps[4]):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want.update({(i, k): zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:]))})
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in steps[5].collect()} == want


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SMALL).checkpoint()
    some = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert key(map(tuple, P.run(spark, SMALL).select(some).collect())) == key(map(tuple, docs.select(some).collect()))


def test_odd_rows_go_through(spark):
    docs = frame(spark, odd_rows(), extra=False).selectExpr("*", "cast(length(text) as long) n_chars")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SMALL).checkpoint()
        assert docs.count() > 0, name
    docs = frame(spark, [], extra=False).selectExpr("*", "cast(length(text) as long) n_chars")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SMALL).checkpoint()
        assert docs.count() == 0


def test_near_duplicates_of_null_ids_and_repeated_rows(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    near = text + " more"
    rows = [(None, text), (None, text), (None, near), (7, text), (7, text), (3, other), (None, other + " end"), (None, "own words of a row without id"), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1))
    kept = P.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert key(tuple(r)[:2] for r in kept.collect()) == key([(7, text), (3, other), (None, "own words of a row without id"), (9, ""), (9, ""), (None, None)])
