"""Language identification: the forward algorithm by enumeration, learning, held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import langid, tokens

from .conftest import frame

PATH = tokens.default_path("piece_bpe_32k.model")


def table(p):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {t: i for i, t in enumerate(t for t in texts if len(t) <= langid.LONGEST and t.strip())}


def all_segmentations(word, ids, prob):
    """(total probability, expected piece counts) by recursion over all segmentations."""
    total, counts = 0.0, {}

    def go(at, p, used):
        nonlocal total
        if at == len(word):
            total += p
            for u in used:
                counts[u] = counts.get(u, 0) + p
            return
        go(at + 1, p * langid.UNSEEN, used)
        for n in range(1, len(word) - at + 1):
            i = ids.get(word[at:at + n])
            if i is not None:
                go(at + n, p * prob[i], [*used, i])

    go(0, 1.0, [])
    return total, {k: v / total for k, v in counts.items()}


def test_forward_and_expectation_equal_enumeration():
    p = langid.pieces(PATH)
    ids = table(p)
    rng = np.random.default_rng(2)
    prob = rng.random((p.n, 2))
    prob /= prob.sum(axis=0)
    words = [b" the", b" thing", " niño".encode(), b" a", "日本".encode(), b" zq", b" on"]
    got = langid.forward(p, words, prob)
    lang = np.array([0, 1, 0, 1, 0, 1, 1])
    count = np.arange(1, 8)
    want = np.zeros_like(prob)
    for w, g, j, n in zip(words, got, lang, count):
        for k in range(2):
            total, counts = all_segmentations(w, ids, prob[:, k])
            assert np.isclose(g[k], np.log(total))
            if k == j:
                for i, c in counts.items():
                    want[i, k] += n * c
    assert np.allclose(langid.expected(p, words, count, lang, prob), want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("data", ["odd", "empty"])
def test_odd(request, data):
    docs = request.getfixturevalue(data)
    rows = langid.identify(docs, PATH).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (2, 3) or r["score"] == 0)


def test_nothing_to_learn(spark, odd):
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string")), PATH).collect()} == {"und"}


def test_lang_and_id_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs.select("text", "lang"), PATH)
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.drop("lang", "source"), model).collect()}
    assert a == b
    long = frame(spark, [(1, "the and of " * 20_000), (2, "x" * 10_000)])
    assert all(np.isfinite(r["score"]) for r in langid.predict(long, model).collect())


def test_rare_languages_are_learned(spark):
    rows = [(f"the house number {i} and the garden of that street was there", "en") for i in range(4000)]
    rows += [(f"la maison numéro {i} et le jardin de cette rue était là", "fr") for i in range(3)]
    rows += [(f"{i} 12 34", "xx") for i in range(5)]  # no word to learn from
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), PATH, 3, 40)
    assert model.langs == ["en", "fr"]
    new = [(1, "le jardin de la maison était là"), (2, "the garden of the house was there"), (3, "qzx wvk")]
    assert [r["lang_pred"] for r in langid.predict(frame(spark, new), model).orderBy("doc_id").collect()] == ["fr", "en", "en"]


def test_copies_are_drawn_apart(spark):
    for k in range(4):  # with a hash of the text alone all copies or none are drawn, mostly none
        rows = [(i, "the same text with these words " + "a" * k, "en") for i in range(3000)] + [(9000, "der Garten", "de")]
        assert langid.train(spark.createDataFrame(rows, "id long, text string, lang string"), PATH, 1, 300).langs == ["de", "en"]
