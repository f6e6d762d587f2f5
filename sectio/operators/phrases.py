"""Sentences and candidate phrases.

Sentences and phrases are produced per row with array expressions and
``posexplode`` (positions are real keys, not row numbers). The only shuffle
is the dedup window (W4), partitioned by (article, phrase): evenly spread,
no hot key beyond one article's repeats of one phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectio.functions import stopwords as SW
from sectio.functions import text as T
from sectio.functions.frames import materialize, with_scalars
from sectio.operators import taggers as TG


def marked(sentence: Column, lang: Column | None = None) -> Column:
    """Token-class marking with the word lists of the row's language
    (English when no language column is given or the language is unknown)."""
    def for_lang(code):
        return T.mark_tokens(sentence, SW.PREPOSITIONS[code], SW.DETERMINERS[code], SW.OTHER_STOPWORDS[code])

    if lang is None:
        return for_lang("en")
    expr = None
    for code in SW.LANGS:
        if code == "en":
            continue
        expr = (F.when(lang == code, for_lang(code)) if expr is None else expr.when(lang == code, for_lang(code)))
    return expr.otherwise(for_lang("en"))


# Probability of a full stop after an abbreviation, the score that makes one, and the
# share of all full stops that a learned one must hold: at most 1 / share are learned.
STOP_AFTER = 0.99
MIN_SCORE = 0.3
MIN_SHARE = 1e-4
# Stops of an abbreviation after which the sentence goes on, as a share of all its stops.
MIN_INSIDE = 0.1


def word_stops(texts: DataFrame, text: str) -> DataFrame:
    """(word, n_stop, n_plain, n_inside): occurrences of each word with and without
    a full stop after it, and those with one after which the sentence goes on (a
    lower-case word or a comma follows), in one aggregate with map-side combining."""
    w = texts.select(F.explode(T.dotted_words(F.col(text))).alias("w")).select(F.lower("w").alias("w"))
    stop, inside = F.col("w").endswith("."), F.col("w").endswith(T.INSIDE_MARK)
    return w.groupBy(F.rtrim("w", F.lit("." + T.INSIDE_MARK)).alias("word")).agg(
        F.count_if(stop).alias("n_stop"), F.count_if(~stop & ~inside).alias("n_plain"), F.count_if(inside).alias("n_inside"))


def abbreviation_scores(texts: DataFrame, text: str, min_share: float = MIN_SHARE) -> DataFrame:
    """(word, n_stop, n_plain, n_inside, score, learned): words before full stops,
    and whether the corpus shows them to be abbreviations, by the log-likelihood ratio of "a full stop nearly always
    follows" against "as often as after any word", scaled down for long words and
    for occurrences without a stop, up for stops inside (after Kiss and Strunk).
    The sentence must go on after ``MIN_INSIDE`` of its stops, so that a word which
    often ends sentences is none.

    A word must hold ``min_share`` of all full stops, so the list is bounded by
    1 / ``min_share`` entries at any size of the corpus."""
    counts = materialize(word_stops(texts, text))  # read for the sums, and again for the scores
    total = counts.groupBy().agg(F.sum("n_stop").alias("stops"), F.sum(F.col("n_stop") + F.col("n_plain")).alias("words"))
    c = with_scalars(counts, total).where((F.col("n_stop") > 0) & (F.col("n_stop") >= F.col("stops") * min_share) & (F.col("stops") < F.col("words")))
    base = F.col("stops") / F.col("words")
    ratio = 2 * (F.col("n_stop") * (F.log(F.lit(STOP_AFTER)) - F.log(base)) + F.col("n_plain") * (F.log(F.lit(1 - STOP_AFTER)) - F.log(1 - base)))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - letters
    score = F.round(ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("n_plain")), 6) + F.lit(0.0)  # no negative zeros
    learned = (F.col("score") >= MIN_SCORE) & (F.col("n_inside") >= F.col("n_stop") * MIN_INSIDE)
    return c.withColumn("score", score).select("word", "n_stop", "n_plain", "n_inside", "score", learned.alias("learned"))


def abbreviations(texts: DataFrame, text: str, min_share: float = MIN_SHARE) -> DataFrame:
    """The learned rows of ``abbreviation_scores``."""
    return abbreviation_scores(texts, text, min_share).where("learned")


def abbreviation_list(learned: DataFrame) -> Column:
    """The learned words and the known ones as one array, a scalar subquery."""
    words = learned.groupBy().agg(F.array_sort(F.collect_set("word")).alias("w")).scalar()
    return F.array_union(F.array(*map(F.lit, T.KNOWN_ABBREVIATIONS)), words)


def explode_sentences(df: DataFrame, text: str, keys: list[str], keep: list[str] | None = None, learned: DataFrame | None = None) -> DataFrame:
    """Rows (keys, sent_idx, sentence) from a text column. ``learned``: the
    corpus's ``abbreviations``, which end no sentence besides the known ones."""
    extra = list(keep or [])
    words = None if learned is None else F.col("__abbr")
    held = df if learned is None else df.withColumn("__abbr", abbreviation_list(learned))
    return held.select(*keys, *extra, F.posexplode(T.sentences(F.col(text), words)).alias("sent_idx", "sentence"))


def explode_phrases(sents: DataFrame, keys: list[str], covered: bool = True, lang: str | None = None, tagger: TG.Tagger | None = None) -> DataFrame:
    """Rows (keys, sent_idx, phrase_idx, phrase, sentence). ``covered``:
    phrases with their prepositional tail (W7); otherwise bare runs (T5). With a
    ``tagger`` they are its noun phrases instead of stop-word runs."""
    if tagger is not None:
        return TG.phrases(sents, [*keys, "sent_idx"], tagger).select(*keys, "sent_idx", "sentence", "phrase_idx", "phrase")
    m = marked(F.col("sentence"), F.col(lang) if lang else None)
    arr = T.covered_phrases(m) if covered else T.phrase_runs(m)
    return sents.select(*keys, "sent_idx", "sentence", F.posexplode(arr).alias("phrase_idx", "phrase"))


def dedup_phrases(phr: DataFrame, keys: list[str]) -> DataFrame:
    """A phrase already seen in an earlier sentence of the same article
    is dropped; repeats within its first sentence stay."""
    w = Window.partitionBy(*keys, "phrase")
    return phr.withColumn("__first", F.min("sent_idx").over(w)).where(F.col("sent_idx") == F.col("__first")).drop("__first")
