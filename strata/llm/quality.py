"""Quality rules by distribution divergence, in DataFrame functions only.

Base counts per document (words, symbols, repeated lines, words in repeated five-word windows) give
the base rule. The method compares two histograms of a document with those of all documents of
its language: character classes, and the language's most common words against the rest. The
distance is the square root of the Jensen-Shannon divergence to base 2. A distance counts only
for documents that are long enough (minimum-length guards).

The limit of the word distance is derived per language: MOST_BARE of the distance that a text without
any common word has, and never above MOST_WORD_DISTANCE. It holds for texts so long that their language
would put LEAST_COMMON common words into them; shorter ones, or all if ``word_distance`` is given, have
the fixed limit. Words without a letter or digit have a bin of their own unless ``symbol_words`` is set,
which lets them be common words like others.

A reference is the sum of its language's counts over all documents. The common words are the first
by exact count, ties by the word's bytes; each task passes on only its own first ones.

Defined cases: null and empty texts have no words and fail the base rule; a null language is a
language of its own; rows with equal or null ids stay rows of their own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

BLANK = r"[ \t\n\x0B\f\r]"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 5
COMMON = 16
LEAST_CHARS = 200
LEAST_WORDS = 50
MOST_CHAR_DISTANCE = 0.27
MOST_WORD_DISTANCE = 0.45
MOST_BARE = 0.95  # of the distance of a text without common words
LEAST_COMMON = 8  # common words that a text of that length has on average in its language
MOST_BROADCAST = 10_000  # languages: each is one row of a few words and counts


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def _lettered(word: Column) -> Column:
    return F.rlike(word, F.lit(r"[\p{L}\p{N}]"))


def text_hash(text: Column) -> Column:
    """With the id, tells rows apart when verdicts are brought back to documents."""
    return F.xxhash64(text)


def _removed(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in runs of ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from ``ws``: words in windows that occur twice or more in the text."""
    hashed = df.withColumn("hw", F.transform("ws", lambda w: F.xxhash64(w)))
    window = F.when(F.size("ws") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("ws") - WINDOW), lambda i: F.xxhash64(*(F.get("hw", i + j) for j in range(WINDOW)))))
    hashed = hashed.withColumn("h5", F.coalesce(window, F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("h5")) < F.size("h5")
    # only texts with an equal pair of windows sort them
    ranked = hashed.withColumn("ranked", F.when(twice, F.sort_array(F.transform("h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter("ranked", lambda e, j: (F.get("ranked", j - 1)["h"].eqNullSafe(e["h"])) | (F.get("ranked", j + 1)["h"].eqNullSafe(e["h"])))
    placed = ranked.withColumn("at", F.sort_array(F.transform(same, lambda e: e["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("at", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")), lambda a: a["n"])
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("hw", "h5", "ranked", "at")


def distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two histograms (arrays of counts)."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    share = F.arrays_zip(F.transform(p, lambda v: v / F.greatest(total(p), F.lit(1.0))).alias("p"),
                         F.transform(q, lambda v: v / F.greatest(total(q), F.lit(1.0))).alias("q"))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    sum_of = F.aggregate(share, F.lit(0.0), lambda a, s: a + part(s["p"], (s["p"] + s["q"]) / 2) + part(s["q"], (s["p"] + s["q"]) / 2))
    return F.sqrt(F.greatest(sum_of / 2, F.lit(0.0)))


def _small(by_lang: DataFrame) -> DataFrame:
    """A checkpoint of a table with one row per language, for broadcast if they are few enough."""
    by_lang = by_lang.checkpoint()
    return F.broadcast(by_lang) if by_lang.count() <= MOST_BROADCAST else by_lang


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, common: int,
             symbol_words: bool = False) -> DataFrame:
    """Per document: id, language, base counts and the two histograms."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_hash(F.col(text_col)).alias("text_hash"))
    word = F.explode(words(F.col("text"))).alias("w")
    every = base.select("lang", word)
    every = every if symbol_words else every.where(_lettered(F.col("w")))
    ranked = every.groupBy("lang", "w").agg(F.count("*").alias("n")).withColumn(
        "i", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("i") <= common)
    top = ranked.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("top"))
    d = base.withColumn("ws", words(F.col("text"))).join(_small(top), "lang", "left").withColumn("top", F.coalesce("top", F.array().cast("array<string>")))
    blank = F.length("text") - F.length(F.array_join("ws", ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t\n\x0B\f\r]")))
    d = with_repeats(d).withColumn("lines", lines).withColumn("kept_words", F.filter("ws", lambda w: F.array_contains("top", w)))
    others = [] if symbol_words else [F.size(F.filter("ws", lambda w: ~_lettered(w))).cast("long")]
    d = d.select("id", "lang", "top", "kept_words", F.array(*others).cast("array<bigint>").alias("others"), "text_hash", F.size("ws").cast("long").alias("n_words"), "n_repeat_words",
                 F.length("text").cast("long").alias("n_chars"), blank.cast("long").alias("n_blank"),
                 _removed(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 _removed(F.col("text"), r"\p{L}+").cast("long").alias("letters"),
                 _removed(F.col("text"), r"\p{Lu}+").cast("long").alias("capitals"),
                 _removed(F.col("text"), r"\p{Nd}+").cast("long").alias("digits"))
    counts = F.transform("top", lambda c: (F.size("kept_words") - F.size(F.array_remove("kept_words", c))).cast("long"))
    rest = F.col("n_chars") - F.col("letters") - F.col("digits") - F.col("n_blank") - F.col("n_symbols")
    classes = F.array(F.col("letters") - F.col("capitals"), F.col("capitals"), F.col("digits"), F.col("n_blank"), F.col("n_symbols"), rest)
    return d.select("id", "lang", "n_words", (F.col("n_chars") - F.col("n_blank")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
                    "n_chars", "text_hash", classes.alias("classes"),
                    F.concat(counts, "others", F.array(F.col("n_words") - F.size("kept_words") - sum(F.get("others", F.lit(i)) for i in range(len(others))))).alias("common"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: int = COMMON,
          least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS, char_distance: float = MOST_CHAR_DISTANCE,
          word_distance: float | None = None, symbol_words: bool = False) -> DataFrame:
    """Per document: id, base counts, base_failed, kept, char_js, word_js and text_hash."""
    checkpoint_dir(docs.sparkSession)
    d = features(docs, id_col, text_col, lang_col, common, symbol_words).checkpoint()
    sums = lambda name, n: F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(n))).alias(f"all_{name}")
    others = 1 if symbol_words else 2  # bins besides the common words
    # languages may have fewer common words than asked for: the missing bins are null sums
    reference = d.groupBy("lang").agg(sums("classes", 6), sums("common", common + others)).withColumn(
        "all_common", F.filter("all_common", lambda x: x.isNotNull()))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    # all words in the last bin, the rest: a text without a common word
    bare = F.transform("all_common", lambda v, i: F.when(i == F.size("all_common") - 1, 1).otherwise(0).cast("long"))
    reference = reference.withColumn("common_share", total(F.slice("all_common", 1, F.size("all_common") - others)) / F.greatest(total("all_common"), F.lit(1)))
    reference = reference.withColumn("bare_js", distance(bare, F.col("all_common")))
    d = d.join(_small(reference), "lang", "left")
    d = d.withColumn("char_js", distance(F.col("classes"), F.col("all_classes"))).withColumn("word_js", distance(F.col("common"), F.col("all_common")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    if word_distance is None:
        derived = F.least(F.lit(MOST_WORD_DISTANCE), MOST_BARE * F.col("bare_js"))
        most = F.when(F.col("n_words") * F.col("common_share") >= LEAST_COMMON, derived).otherwise(F.lit(MOST_WORD_DISTANCE))
    else:
        most = F.lit(word_distance)
    odd = ((F.col("n_chars") >= least_chars) & (F.col("char_js") > char_distance)) | ((F.col("n_words") >= least_words) & (F.col("word_js") > most))
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~odd).alias("kept"), "char_js", "word_js", "text_hash")
