"""Sections, sentences and phrases: hand cases."""

from pyspark.sql import functions as F

from sectio.functions import text as T
from sectio.operators import phrases as P
from sectio.operators import sections as S

FILL = "Lorem ipsum dolor sit amet. " * 20


def locate(spark, text):
    df = spark.createDataFrame([(1, text)], ["doc_id", "text"])
    return S.preresults_text(S.results_text(S.locate_sections(df)), start=10).first()


def test_results_between_anchors(spark):
    t = FILL + "\n\n3. Results\n\nWe saw fewer infections. " + "\n\n4. Discussion\n\nIt worked."
    r = locate(spark, t)
    assert r["status"] == "ok"
    assert r["results"] == "3. Results\n\nWe saw fewer infections."
    assert r["preresults"] == t[10:t.index("\n\n3. Results")]


def test_heading_in_first_sixth_is_ignored(spark):
    t = "\n\nResults\n\n" + FILL + "\n\nDiscussion\n\nend"
    r = locate(spark, t)
    assert r["status"] == "no_results"


def test_no_headings_and_wrong_order(spark):
    assert locate(spark, FILL)["status"] == "no_results"
    t = FILL + "\n\nDiscussion\n\ntext here. " + "\n\nResults\n\nmore text."
    assert locate(spark, t)["status"] == "no_results"


def test_adjacent_headings_one_newline_second_missed(spark):
    t = FILL + "\nResults\nDiscussion\nbody text"
    df = spark.createDataFrame([(1, t)], ["doc_id", "text"])
    heads = [h["match"] for h in df.select(T.headings(df.text).alias("h")).first()["h"]]
    assert heads == ["\nResults\n"]


def test_heading_offsets_match_python(spark):
    import re

    t = FILL + "\n\n2. Methods\n\nx. " + FILL + "\n\n3. Results\n\ny\n\nDiscussion\n\n"
    df = spark.createDataFrame([(1, t)], ["doc_id", "text"])
    got = [(h["start"], h["match"]) for h in df.select(T.headings(df.text).alias("h")).first()["h"]]
    pat = re.compile(T.HEADING_RE)
    assert got == [(m.start(), m.group(0)) for m in pat.finditer(t)]


def test_sentence_split(spark):
    df = spark.createDataFrame([("Mortality fell. Pain, p<0.05, improved!  2 cases remained.\ne.g. this stays",)], ["t"])
    got = df.select(T.sentences(df.t).alias("s")).first()["s"]
    assert got == ["Mortality fell.", "Pain, p<0.05, improved!", "2 cases remained. e.g. this stays"]


def test_sentence_ends_after_abbreviations_quotes_and_brackets(spark):
    cases = {
        "Smith et al. Found it. So did we.": ["Smith et al. Found it.", "So did we."],
        "See Fig. 2 and vs.  Placebo. End": ["See Fig. 2 and vs.  Placebo.", "End"],
        'He said "yes." Then (it ended.) Next ("came"). \u201cQuoted\u201d start.': ['He said "yes."', "Then (it ended.)", 'Next ("came").', "\u201cQuoted\u201d start."],
        "It was real. Real! Als? Über 3 al! Ende": ["It was real.", "Real!", "Als?", "Über 3 al!", "Ende"],
        "i.e. Here. \u00abNow.\u00bb 3 left.": ["i.e. Here.", "\u00abNow.\u00bb", "3 left."],
        "": [], " . ": ["."],
    }
    df = spark.createDataFrame([(k,) for k in cases], ["t"])
    assert {r.t: r.s for r in df.select("t", T.sentences(df.t).alias("s")).collect()} == cases
    assert spark.createDataFrame([(None,)], "t string").select(T.sentences(F.col("t")).alias("s")).first().s is None


def test_abbreviations_are_learned(spark):
    """The score against its formula, and their effect on sentence ends."""
    import math

    body = "Dose was 5 mg. Per day. " * 30 + "The drug was given. The patients slept. We found the drug. " * 40 + "a.m. Rounds were held. Mg was low. It took 2 mg. daily, and 3 mg. a week; 4 mg. more, at 8 a.m. sharp. " * 3
    texts = spark.createDataFrame([(1, body), (2, None), (3, "Then mg. Then a.m. Rounds. ")], "doc_id long, text string")
    got = {r.word: r for r in P.abbreviations(texts, "text", 0.001).collect()}
    counts = {r.word: (r.n_stop, r.n_plain, r.n_inside) for r in P.word_stops(texts, "text").collect()}
    stops, words = sum(a for a, _, _ in counts.values()), sum(a + b for a, b, _ in counts.values())

    def score(w, a, b):
        letters = len(w.replace(".", ""))
        llr = 2 * (a * (math.log(0.99) - math.log(stops / words)) + b * (math.log(0.01) - math.log(1 - stops / words)))
        return llr * math.exp(-letters) * (len(w) - letters + 1) * letters ** -b

    want = {w: score(w, a, b) for w, (a, b, c) in counts.items() if a and a >= stops * 0.001 and 10 * c >= a and score(w, a, b) >= 0.3}
    assert set(got) == set(want) and all(abs(got[w].score - v) < 1e-6 for w, v in want.items())
    assert set(got) == {"a.m", "mg"} and counts["mg"] == (40, 3, 9) and counts["given"] == (40, 0, 0)
    out = P.explode_sentences(texts, "text", ["doc_id"], learned=P.abbreviations(texts, "text", 0.001))
    assert [r.sentence for r in out.where("doc_id = 3").orderBy("sent_idx").collect()] == ["Then mg. Then a.m. Rounds."]
    assert P.abbreviations(texts.limit(0), "text").collect() == []
    assert len(P.explode_sentences(texts.where("doc_id = 3"), "text", ["doc_id"], learned=P.abbreviations(texts.limit(0), "text")).collect()) == 3


def test_very_long_runs_do_not_recurse(spark):
    body = " ".join(f"word{i}" for i in range(20000))
    dots = ".".join(["a1"] * 20000)
    df = spark.createDataFrame([(0, body), (1, dots)], ["sent_idx", "sentence"])
    for covered in (False, True):
        got = {r["sent_idx"]: r["phrase"] for r in P.explode_phrases(df, [], covered=covered).collect()}
        assert got == {0: body, 1: dots}


def test_heading_patterns_without_short_forms(spark):
    lines = ["3. Results", "3.Results", "Results", "12a) Adverse events", "Résultats", "one two three four five", "one two three four five six seven",
             "ab", "Two  words\t", "- Results", "x_y Results", "3.1.2 Results"]
    df = spark.createDataFrame([(i, f"t\n\n{x}\n\nz") for i, x in enumerate(lines)], ["i", "t"])
    got = {r["i"] for r in df.select("i", T.headings(df.t).alias("h")).collect() if r["h"]}
    import re
    old = re.compile(r"(?ia)\n+(?:\b\S{1,3})?(?:[ \t]*\b[a-z]{3,}\b){1,5}[ \t]*\n+")
    assert got == {i for i, x in enumerate(lines) if old.search(f"t\n\n{x}\n\nz")}


def test_phrase_dedup_within_and_across_sentences(spark):
    rows = [(1, 0, 0, "pain"), (1, 0, 1, "pain"), (1, 1, 0, "pain"), (1, 1, 1, "fever"), (2, 3, 0, "pain")]
    df = spark.createDataFrame(rows, ["doc_id", "sent_idx", "phrase_idx", "phrase"])
    got = sorted(tuple(r) for r in P.dedup_phrases(df, ["doc_id"]).select("doc_id", "sent_idx", "phrase_idx", "phrase").collect())
    assert got == [(1, 0, 0, "pain"), (1, 0, 1, "pain"), (1, 1, 1, "fever"), (2, 3, 0, "pain")]


def test_phrase_runs_and_cover(spark):
    df = spark.createDataFrame([(0, "The incidence of the wound infection and 30-day mortality of patients in 2020.")],
                               ["sent_idx", "sentence"])
    runs = P.explode_phrases(df, [], covered=False).select("phrase").collect()
    assert [r[0] for r in runs] == ["incidence", "wound infection", "30-day mortality", "patients"]
    cover = P.explode_phrases(df, [], covered=True).select("phrase").collect()
    assert [r[0] for r in cover] == ["incidence of the wound infection", "30-day mortality of patients"]


def test_phrases_use_the_row_language(spark):
    df = spark.createDataFrame([(0, "fr", "La mortalité des patients et la douleur."),
                                (0, "de", "Die Sterblichkeit von Patienten und die Schmerzen.")],
                               ["sent_idx", "lang", "sentence"])
    got = {r["lang"]: r["phrase"] for r in
           P.explode_phrases(df, ["lang"], covered=True, lang="lang").select("lang", "phrase", "phrase_idx")
           .where("phrase_idx = 0").collect()}
    assert got == {"fr": "mortalité des patients", "de": "Sterblichkeit von Patienten"}
