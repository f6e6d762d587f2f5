"""Text expressions: heading regex and offsets (F1), heading clean-up (F2),
span cut (F3), whitespace translation (F4), character trigrams, sentence
split (T4) and stop-word phrase runs (T5, W7).

Everything is a JVM-side column expression over one article / one sentence
row, so no stage here shuffles. The same regexes run in DuckDB's RE2, which is
what the oracle relies on; they spell out white space and word characters, on
whose short forms Java and RE2 differ. Groups that repeat per token are
possessive (``*+``): Java then loops where it would otherwise recurse per token
and overflow its stack on long runs. RE2 needs and knows no such mark; ``for_re2``
takes it off, and the matches are the same, since no such group ever has to give
a token back.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
# Section heading: a line of up to a short numbering token and 1-5 words,
# surrounded by line breaks (case-insensitive).
_SOLID = r"[^ \t\n\r\f\x0B]"
_WORD_START = "[A-Za-z0-9_]"
HEADING_RE = (rf"\n+(?:{_WORD_START}{_SOLID}{{0,2}}[ \t]+|{_WORD_START}{_SOLID}?[^ \t\n\r\f\x0BA-Za-z0-9_])?"
              r"[ \t]*[A-Za-z]{3,}(?:[ \t]+[A-Za-z]{3,}){0,4}[ \t]*\n+")
# Characters removed from a heading before comparison.
HEADING_DROP_RE = r"[\n\t0-9.]"
# Anchors that open and close the results section, and the score needed.
ANCHOR_START = "results"
ANCHOR_END = "discussion"
ANCHOR_MIN_SCORE = 0.75
# Headings in the first sixth of the text belong to abstract / introduction.
HEAD_SKIP_FRACTION = 6
# Pre-results text starts after the abstract, this many characters in.
PRERESULTS_START = 2500
# -----------------------------------------------------------------------------

def for_re2(pattern: str) -> str:
    """A pattern of this module as RE2 reads it."""
    return pattern.replace("*+", "*")


WS_CLASS = "[ \\t\\n\\r\\f\\x0B]"
STRIP_RE = f"^{WS_CLASS}+|{WS_CLASS}+$"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (``trim`` strips spaces only)."""
    return F.regexp_replace(c, STRIP_RE, "")


def headings(text: Column) -> Column:
    """all heading matches with their 0-based start offsets, as
    ARRAY<STRUCT<start INT, match STRING>>. Offsets come from the pieces
    between matches: start_i = sum(len(piece_0..i)) + sum(len(match_0..i-1)),
    accumulated in one left-to-right fold (the text is split and matched
    once per row, not once per heading)."""
    pieces = F.split(text, HEADING_RE, -1)
    matches = F.regexp_extract_all(text, F.lit(HEADING_RE), F.lit(0))
    pairs = F.arrays_zip(pieces.alias("p"), matches.alias("m"))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["p"])
        nxt = F.array_append(acc["out"], F.struct(start.alias("start"), x["m"].alias("match")))
        return F.struct((start + F.coalesce(F.length(x["m"]), F.lit(0))).alias("pos"),
                        F.when(x["m"].isNotNull(), nxt).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, init, step, lambda acc: acc["out"])


def clean_heading(m: Column) -> Column:
    """drop newlines, tabs, digits and dots, then strip."""
    return strip_ws(F.regexp_replace(m, HEADING_DROP_RE, ""))


# Every overlapping 3-character window, in one native regex pass: a zero-width
# lookahead at each position capturing the next three characters.
TRIGRAM_RE = "(?s)(?=(.{3}))"


def trigrams(s: Column) -> Column:
    """Character 3-grams of ``s`` (lower-cased), with repeats, in text
    order; empty below 3 chars."""
    return F.regexp_extract_all(F.lower(s), F.lit(TRIGRAM_RE), F.lit(1))


def trigram_counts(word: str) -> Counter:
    w = word.lower()
    return Counter(w[i:i + 3] for i in range(len(w) - 2))


def trigram_cosine(s: Column, anchor: str) -> Column:
    """Cosine of 3-gram count vectors of ``s`` and a constant ``anchor``,
    in-row. The anchor's counts are a literal map; the row's own squared
    norm is sum over its grams of that gram's count."""
    ac = trigram_counts(anchor)
    amap = F.create_map(*[F.lit(x) for kv in ac.items() for x in kv])
    a2 = float(sum(v * v for v in ac.values()))
    g = trigrams(s)
    dot = F.aggregate(g, F.lit(0), lambda acc, x: acc + F.coalesce(F.element_at(amap, x), F.lit(0)))
    h2 = squared_count_norm(g)
    return F.when(h2 > 0, F.round(dot / F.sqrt(h2 * F.lit(a2)), 6)).otherwise(F.lit(0.0))


def squared_count_norm(items: Column) -> Column:
    """Sum of squared occurrence counts of an array's values, in one fold
    over the sorted array: a repeat of the previous value adds 2*run + 1
    ((run + 1)^2 - run^2), a new value adds 1."""
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("s"))

    def step(acc, x):
        same = acc["prev"].eqNullSafe(x)
        return F.struct(x.alias("prev"),
                        F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
                        (acc["s"] + F.when(same, 2 * acc["run"] + 1).otherwise(F.lit(1))).alias("s"))

    return F.aggregate(F.array_sort(items), init, step, lambda acc: acc["s"])


def spaces_for_breaks(c: Column) -> Column:
    """newline, carriage return and tab become one space each."""
    return F.translate(c, "\n\r\t", "   ")


# Sentence boundary: terminal punctuation with the quotes and brackets that it
# closes, spaces, then an upper-case letter or a digit, which a quote or bracket
# may open. The boundary is marked with \x01 before the spaces.
SENT_BOUNDARY_RE = r"([.!?]+[\"'”’»)\]]*)( +[\"'“‘«(\[]*(?:\p{Lu}|\p{N}))"
SENT_MARK = "\u0001"
# The word before a piece's closing full stop; words may hold stops ("e.g").
LAST_WORD_RE = r"([\p{L}]+(?:\.[\p{L}]+)*+)\.$"
# Words of a text, with the full stop that follows.
DOTTED_WORD_RE = r"[\p{L}]+(?:\.[\p{L}]+)*+\.?"
# A word with a full stop after which the sentence plainly goes on.
INSIDE_WORD_RE = r"([\p{L}]+(?:\.[\p{L}]+)*+)\.(?:[,;:]| +\p{Ll})"
INSIDE_MARK = "\u0002"
# Words that never end a sentence by their full stop.
KNOWN_ABBREVIATIONS = "al approx bzw ca cf dr e.g eq eqs fig figs i.e p.ej p.ex prof ref refs resp vs z.b".split()


def sentences(c: Column, abbreviations: Column | None = None) -> Column:
    """T4 (re-aimed): split text into sentences after terminal punctuation, unless
    it is the lone full stop of one of ``abbreviations`` (an array of lower-case
    words; the known ones by default). Pieces are trimmed, empty ones dropped."""
    words = F.array(*map(F.lit, KNOWN_ABBREVIATIONS)) if abbreviations is None else abbreviations
    marked = F.regexp_replace(spaces_for_breaks(c), SENT_BOUNDARY_RE, "$1" + SENT_MARK + "$2")

    def close(p):
        held = F.array_contains(words, F.lower(F.regexp_extract(p, LAST_WORD_RE, 1)))
        return F.concat(p, F.when(held, F.lit("")).otherwise(F.lit(SENT_MARK)))

    joined = F.array_join(F.transform(F.split(marked, SENT_MARK, -1), close), "")
    return F.filter(F.transform(F.split(joined, SENT_MARK, -1), lambda s: F.trim(s)), lambda s: s != "")


def dotted_words(c: Column) -> Column:
    """Words of a text, each with the full stop that follows it, and once more with a mark where the sentence goes on after that."""
    inside = F.transform(F.regexp_extract_all(c, F.lit(INSIDE_WORD_RE), F.lit(1)), lambda t: F.concat(t, F.lit(INSIDE_MARK)))
    return F.concat(F.regexp_extract_all(c, F.lit(DOTTED_WORD_RE), F.lit(0)), inside)


# Tokens: words (letters/digits with inner ' ’ - . joins) or single symbols.
TOKEN_RE = r"[\p{L}\p{N}]+(?:['’\-.][\p{L}\p{N}]+)*+|[^ \t\n\r\f\x0B\p{L}\p{N}]"
# Token class codes used in the marked sentence.
C_CONTENT, C_STOP, C_PREP, C_DET = "\u0002", "\u0003", "\u0004", "\u0005"
RUN_RE = "(?:^| )\\x02([^ ]+(?: \\x02[^ ]+)*+)"
COVER_RE = ("(?:^| )\\x02([^ ]+(?: \\x02[^ ]+)*+"
            "(?: \\x04[^ ]+(?: \\x05[^ ]+)? \\x02[^ ]+(?: \\x02[^ ]+)*+)?)")
CODES_RE = "[\\x02-\\x05]"
HAS_LETTER_RE = r"\p{L}"


def mark_tokens(sentence: Column, prepositions: list[str], determiners: list[str], stops: list[str]) -> Column:
    """Join the sentence's tokens with single spaces, each prefixed with its
    class code: content word, preposition, determiner, other stop word or
    symbol."""
    toks = F.regexp_extract_all(sentence, F.lit(TOKEN_RE), F.lit(0))

    def code(t):
        lt = F.lower(t)
        return (F.when(lt.isin(prepositions), F.lit(C_PREP))
                .when(lt.isin(determiners), F.lit(C_DET))
                .when(lt.isin(stops), F.lit(C_STOP))
                .when(~t.rlike(r"[\p{L}\p{N}]"), F.lit(C_STOP))
                .otherwise(F.lit(C_CONTENT)))

    return F.array_join(F.transform(toks, lambda t: F.concat(code(t), t)), " ")


def _runs(marked: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(marked, F.lit(pattern), F.lit(1))
    clean = F.transform(found, lambda p: F.regexp_replace(p, CODES_RE, ""))
    return F.filter(clean, lambda p: p.rlike(HAS_LETTER_RE))


def phrase_runs(marked: Column) -> Column:
    """T5 (re-aimed, RAKE-style): maximal runs of content words; runs without
    a letter (numbers only) are dropped."""
    return _runs(marked, RUN_RE)


def covered_phrases(marked: Column) -> Column:
    """A run extended by one prepositional tail (preposition, optional
    determiner, next run). Matches are taken left to right without overlap,
    so a run already used as a tail is not a phrase of its own -- the
    token-coverage rule."""
    return _runs(marked, COVER_RE)
