"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the
product over its words. Pieces are learned by expectation maximisation on the word counts of the
training rows: forward-backward in Spark tasks over the (language, word) table, expected counts
per (language, piece) summed by Spark; only that table (languages x vocabulary) reaches the
driver.

Words are runs of letters and bytes beyond ASCII of the lower-cased text; the first piece of a word
carries the vocabulary's blank. A byte that no piece covers costs a fixed small probability, and
runs longer than ``LONGEST`` bytes are scored in parts, so every text is scored whole.

Training takes about ``rows_per_language`` labelled rows of each language, or all if it has no more,
drawn by a hash of their id and text; the bound is a parameter. Prediction covers every row.

Defined cases: null texts and texts without a letter are ``und`` with score 0; null languages and
languages without a word are not learned from; with nothing to learn from every row is ``und``; ties take the first language in
alphabetical order; rows stay one to one; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.words import _BASE, _BYTE, _INV, Words, mix, powers, slices
from strata.session import checkpoint_dir

LONGEST = 32
UNSEEN = 1e-7  # probability of a byte that no piece covers
SMOOTH = 0.05  # added to every expected piece count
CACHE = 400_000
LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True


class Pieces:
    """The vocabulary's pieces by length in bytes, found by hash."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        texts = [t for t in texts if len(t) <= LONGEST and t.strip()]
        self.n = len(texts)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(t) for t in texts}):
            some = [i for i, t in enumerate(texts) if len(t) == n]
            h = _hashes(np.frombuffer(b"".join(texts[i] for i in some), np.uint8))(np.arange(len(some)) * n, np.arange(1, len(some) + 1) * n)
            order = np.argsort(h)
            self.by_length[n] = (h[order], np.array(some, dtype=np.int64)[order])

    def arcs(self, words: list[bytes]):
        """(position of the end, length, words, pieces) of every place where a piece fits; ``words``
        should be sorted by falling length. Positions count the blank before a word's first byte."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        hashed = _hashes(np.frombuffer(b"".join(words), np.uint8))
        for end in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -end, side="right"))
            for n, (keys, ids) in self.by_length.items():
                if n > end:
                    break
                h = hashed(start[:active] + end - n, start[:active] + end)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                found = np.flatnonzero(keys[at] == h)
                if len(found):
                    yield end, n, found, ids[at[found]]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _hashes(data: np.ndarray):
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n + 1)[:n], out=total[1:])
    inverse = powers(_INV, n + 1)
    return lambda a, b: mix((total[b] - total[a]) * inverse[a])


def _by_length(words: list[bytes]) -> list[int]:
    return sorted(range(len(words)), key=lambda i: -len(words[i]))


def forward(p: Pieces, words: list[bytes], prob: np.ndarray) -> np.ndarray:
    """log P(word) per language: words x languages; ``prob``: pieces x languages."""
    order = _by_length(words)
    ranked = [words[i] for i in order]
    sizes = np.array([len(w) for w in ranked], dtype=np.int64)
    alpha = np.zeros((int(sizes[0]) + 1 if len(sizes) else 1, len(ranked), prob.shape[1]))
    alpha[0] = 1.0
    last = 0
    for end, n, found, ids in _steps(p, ranked):
        if end != last:
            active = int(np.searchsorted(-sizes, -end, side="right"))
            alpha[end, :active] = alpha[end - 1, :active] * UNSEEN
            last = end
        if n:
            alpha[end, found] += alpha[end - n, found] * prob[ids]
    out = np.zeros((len(words), prob.shape[1]))
    out[order] = np.log(alpha[sizes, np.arange(len(ranked))])
    return out


def _steps(p: Pieces, ranked: list[bytes]):
    """The arcs with one empty arc (length 0) at the start of every position."""
    last = 0
    none = np.zeros(0, np.int64)
    for arc in p.arcs(ranked):
        while last < arc[0]:
            last += 1
            yield last, 0, none, none
        yield arc
    for end in range(last + 1, (len(ranked[0]) if ranked else 0) + 1):
        yield end, 0, none, none


def expected(p: Pieces, words: list[bytes], count: np.ndarray, lang: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts, pieces x languages, of words with a count and a language each."""
    order = np.array(_by_length(words), dtype=np.int64)
    ranked = [words[i] for i in order]
    sizes = np.array([len(w) for w in ranked], dtype=np.int64)
    of, weight = lang[order], count[order].astype(float)
    arcs = list(_steps(p, ranked))
    alpha = np.zeros((int(sizes[0]) + 1 if len(sizes) else 1, len(ranked)))
    alpha[0] = 1.0
    for end, n, found, ids in arcs:
        if not n:
            active = int(np.searchsorted(-sizes, -end, side="right"))
            alpha[end, :active] += alpha[end - 1, :active] * UNSEEN
        else:
            alpha[end, found] += alpha[end - n, found] * prob[ids, of[found]]
    total = alpha[sizes, np.arange(len(ranked))]
    beta = np.zeros_like(alpha)
    beta[sizes, np.arange(len(ranked))] = 1.0
    out = np.zeros_like(prob)
    for end, n, found, ids in reversed(arcs):  # all arcs that end at a position come before it is left
        if not n:
            active = int(np.searchsorted(-sizes, -end, side="right"))
            beta[end - 1, :active] += beta[end, :active] * UNSEEN
        else:
            share = prob[ids, of[found]] * beta[end, found]
            beta[end - n, found] += share
            np.add.at(out, (ids, of[found]), weight[found] * alpha[end - n, found] * share / total[found])
    return out


def word_ranges(col: pa.Array) -> Words:
    """Words of the lower-cased texts; a word's range takes in one byte before it for the blank."""
    return Words(pc.utf8_lower(col.cast(pa.large_string()).fill_null("")), LETTERS)


def parts(word: bytes) -> list[bytes]:
    """The blank and the word, in runs of at most LONGEST bytes."""
    spaced = b" " + word
    return [spaced[i:i + LONGEST] for i in range(0, len(spaced), LONGEST)]


class Model:
    """Languages, log priors and piece probabilities (pieces x languages)."""

    def __init__(self, langs: list[str], prior: np.ndarray, prob: np.ndarray, path: str):
        self.langs, self.prior, self.prob, self.path = langs, prior, prob, path

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        cut = [parts(w) for w in words]
        flat = [x for c in cut for x in c]
        scores = forward(pieces(self.path), flat, self.prob)
        first = np.concatenate([[0], np.cumsum([len(c) for c in cut])])[:-1].astype(np.int64)
        return np.add.reduceat(scores, first, axis=0) if len(words) else scores


class Predictor:
    """Scores texts with a bounded cache of word scores, begun anew when full."""

    def __init__(self, model: Model, limit: int = CACHE):
        self.model, self.limit = model, limit
        self.place: dict[int, int] = {}
        self.scores = np.zeros((0, len(model.langs)))

    def __call__(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        w = word_ranges(col)
        if len(self.place) > self.limit:
            self.place, self.scores = {}, self.scores[:0]
        known, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        keys = known.tolist()
        got = np.fromiter(map(self.place.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(got < 0)
        if len(new):
            texts = [w.data[a:b].tobytes() for a, b in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)]
            have = len(self.place)
            self.scores = np.concatenate([self.scores, *(self.model.word_scores(texts[i:i + 20_000]) for i in range(0, len(texts), 20_000))])
            got[new] = np.arange(have, have + len(new))
            self.place.update(zip(known[new].tolist(), range(have, have + len(new)), strict=True))
        total = np.zeros((len(col) + 1, len(self.model.langs)))
        place = got[back]
        for j in range(total.shape[1]):
            total[:-1, j] = np.bincount(w.doc, weights=self.scores[place, j], minlength=len(col)) if len(place) else 0
        total = total[:-1] + self.model.prior
        best = total.argmax(axis=1)
        with np.errstate(under="ignore"):
            score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.model.langs[b] for b in best.tolist()], score


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(rows: DataFrame, path: str, rounds: int = 3, rows_per_language: int = 20_000) -> Model | None:
    """``rows`` (text, lang, and id if they have one) of labelled training documents."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    by_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not by_lang:
        return None
    langs = sorted(by_lang)
    large = {x: int(rows_per_language / n * (1 << 30)) for x, n in by_lang.items() if n > rows_per_language}
    if large:
        most = F.try_element_at(F.create_map(*(F.lit(v) for pair in large.items() for v in pair)), F.col("lang"))
        key = [c for c in ("id", "text") if c in rows.columns]
        drawn = rows.where(F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1 << 30)) < F.coalesce(most, F.lit(1 << 30)))
    else:
        drawn = rows

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                w = word_ranges(part.column(0))
                lang = np.array([langs.index(x) for x in part.column(1).to_pylist()], dtype=np.uint64)
                _, at, n = np.unique(mix(w.hash + lang[w.doc]), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([w.data[a:b].tobytes() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)], pa.binary()),
                    pa.array(lang[w.doc[at]].astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "lang", "n"])

    words = (drawn.select("text", "lang").mapInArrow(count, "word binary, lang int, n long")
             .groupBy("word", "lang").agg(F.sum("n").alias("n")).checkpoint())
    # a language without words would keep the uniform column and draw odd texts of the others
    seen = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not seen:
        return None
    n_pieces = pieces(path).n
    prob = np.full((n_pieces, len(langs)), 1.0 / n_pieces)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(prob)

        def estimate(batches):
            out = np.zeros_like(now.value)
            for batch in batches:
                lang = batch.column(1).to_numpy(zero_copy_only=False)
                n = batch.column(2).to_numpy(zero_copy_only=False)
                cut = [parts(w) for w in batch.column(0).to_pylist()]
                of = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
                out += expected(pieces(path), [x for c in cut for x in c], n[of], lang[of], now.value)
            piece, j = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(j), pa.array(out[piece, j])], names=["piece", "lang", "n"])

        sums = words.mapInArrow(estimate, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        prob = np.full((n_pieces, len(langs)), SMOOTH)
        prob[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
        prob /= prob.sum(axis=0)
        now.unpersist()
    langs, prob = [langs[j] for j in seen], prob[:, seen]
    prior = np.log(np.array([by_lang[x] for x in langs]) / sum(by_lang[x] for x in langs))
    return Model(langs, prior, prob, path)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score (posterior of the predicted language)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        guess = Predictor(shared.value) if shared.value else None
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                lettered = pc.match_substring_regex(part.column(1).cast(pa.large_string()), r"\p{L}").fill_null(False).to_pylist()
                lang, score = guess(part.column(1)) if guess else ([None] * part.num_rows, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([x if ok and x else "und" for x, ok in zip(lang, lettered, strict=True)], pa.string()),
                    pa.array(np.where(lettered, score, 0.0))], names=[id_col, "lang_pred", "score"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             rounds: int = 3, rows_per_language: int = 20_000) -> DataFrame:
    """Learn from rows that aren't held out, predict all: id, held_out, lang_pred, score."""
    known = docs.where(~F.coalesce(held_out(F.col(id_col)), F.lit(False))).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = predict(docs, train(known, path, rounds, rows_per_language), id_col, text_col)
    return out.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "lang_pred", "score")
