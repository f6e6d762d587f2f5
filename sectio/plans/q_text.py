"""Step 4: sections, sentences and phrases on the article fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectio.functions import stopwords as SW
from sectio.functions import text as T
from sectio.operators import phrases as P
from sectio.operators import sections as S
from sectio.plans.stages import stage
from sectio.plans import fixtures as fx
from sectio.plans.oracle import compose, lit, register
from sectio.plans.registry import query

PRE_START = T.PRERESULTS_START

STRIP = f"'{T.STRIP_RE}'"


def sql_sentences(x: str) -> str:
    """DuckDB twin of ``T.sentences``."""
    marked = (f"regexp_replace(translate({x}, chr(10) || chr(13) || chr(9), '   '), {lit(T.SENT_BOUNDARY_RE)}, "
              f"'\\1' || chr(1) || '\\2', 'g')")
    last = f"lower(regexp_extract(p, {lit(T.for_re2(T.LAST_WORD_RE))}, 1))"
    joined = f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda p: p || CASE WHEN list_contains(abbr, {last}) THEN '' ELSE chr(1) END), '')"
    return f"list_filter(list_transform(string_split({joined}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def sql_marked(x: str, lang: str | None = None) -> str:
    """DuckDB twin of ``P.marked``: word lists by the column ``lang`` of the row."""
    if lang is None:
        cases = " ".join(f"WHEN '{c}' THEN {sql_marked(x, c)}" for c in SW.LANGS if c != "en")
        return f"CASE lang {cases} ELSE {sql_marked(x, 'en')} END"
    code = (f"CASE WHEN lower(t) IN {_in(SW.PREPOSITIONS[lang])} THEN chr(4) "
            f"WHEN lower(t) IN {_in(SW.DETERMINERS[lang])} THEN chr(5) "
            f"WHEN lower(t) IN {_in(SW.OTHER_STOPWORDS[lang])} THEN chr(3) "
            f"WHEN NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN chr(3) ELSE chr(2) END")
    return f"array_to_string(list_transform(regexp_extract_all({x}, {lit(T.for_re2(T.TOKEN_RE))}, 0), lambda t: {code} || t), ' ')"


def sql_runs(marked: str, cover: bool) -> str:
    pat = T.for_re2(T.COVER_RE if cover else T.RUN_RE)
    found = f"list_transform(regexp_extract_all({marked}, {lit(pat)}, 1), lambda p: regexp_replace(p, {lit(T.CODES_RE)}, '', 'g'))"
    return f"list_filter({found}, lambda p: regexp_matches(p, {lit(T.HAS_LETTER_RE)}))"


def _anchor_values(word: str) -> str:
    return ", ".join(f"({lit(g)}, {c})" for g, c in T.trigram_counts(word).items())


A_S2 = sum(c * c for c in T.trigram_counts(T.ANCHOR_START).values())
A_E2 = sum(c * c for c in T.trigram_counts(T.ANCHOR_END).values())

register("sec_m", ["articles"], f"""SELECT doc_id, text, length(text) AS L,
    regexp_extract_all(text, {lit(T.HEADING_RE)}, 0) AS m, string_split_regex(text, {lit(T.HEADING_RE)}) AS pcs FROM articles""")
register("sec_h", ["sec_m"], """SELECT doc_id, L, m[i] AS match,
    coalesce(list_sum(list_transform(pcs[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT doc_id, L, m, pcs, unnest(range(1, len(m) + 1)) AS i FROM sec_m) q""")
register("sec_k", ["sec_h"], f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS BIGINT) AS idx,
    CAST(start AS BIGINT) AS start, regexp_replace(regexp_replace(match, {lit(T.HEADING_DROP_RE)}, '', 'g'), {STRIP}, '', 'g') AS heading
    FROM sec_h WHERE start > floor(L / {T.HEAD_SKIP_FRACTION})""")
register("sec_sim", ["sec_k"], f"""SELECT k.doc_id, k.idx, k.start, k.heading,
    coalesce(round(s.ds / sqrt(s.h2 * {A_S2}), 6), 0.0) AS sim_start, coalesce(round(s.de / sqrt(s.h2 * {A_E2}), 6), 0.0) AS sim_end
    FROM sec_k k LEFT JOIN (
      SELECT g.doc_id, g.idx, sum(g.c * g.c) AS h2, sum(g.c * coalesce(a.c, 0)) AS ds, sum(g.c * coalesce(b.c, 0)) AS de
      FROM (SELECT doc_id, idx, gram, count(*) AS c FROM (
              SELECT doc_id, idx, substring(lower(heading), unnest(range(1, length(heading) - 1)), 3) AS gram
              FROM sec_k WHERE length(heading) >= 3) x GROUP BY doc_id, idx, gram) g
      LEFT JOIN (VALUES {_anchor_values(T.ANCHOR_START)}) a(gram, c) ON g.gram = a.gram
      LEFT JOIN (VALUES {_anchor_values(T.ANCHOR_END)}) b(gram, c) ON g.gram = b.gram
      GROUP BY g.doc_id, g.idx) s ON k.doc_id = s.doc_id AND k.idx = s.idx""")
register("sec_best", ["sec_sim"], """SELECT doc_id, count(*) AS n_headings,
    arg_min(idx, (-sim_start, idx)) AS start_idx, max(sim_start) AS start_sim,
    arg_min(idx, (-sim_end, idx)) AS end_idx, max(sim_end) AS end_sim FROM sec_sim GROUP BY doc_id""")
register("sec_loc", ["articles", "sec_best", "sec_sim"], f"""SELECT a.doc_id, a.source, a.lang, a.text, CAST(coalesce(b.n_headings, 0) AS BIGINT) AS n_headings,
    b.start_idx, b.start_sim, b.end_idx, b.end_sim,
    CASE WHEN coalesce(b.n_headings, 0) > 0 AND b.start_sim >= {T.ANCHOR_MIN_SCORE} AND b.end_sim >= {T.ANCHOR_MIN_SCORE}
         AND b.start_idx <= b.end_idx THEN 'ok' ELSE 'no_results' END AS status,
    s1.start AS res_start, s2.start AS res_end
    FROM articles a LEFT JOIN sec_best b ON a.doc_id = b.doc_id
    LEFT JOIN sec_sim s1 ON s1.doc_id = a.doc_id AND s1.idx = b.start_idx
    LEFT JOIN sec_sim s2 ON s2.doc_id = a.doc_id AND s2.idx = b.end_idx""")
register("sec_res", ["sec_loc"], f"""SELECT doc_id, source, lang, regexp_replace(substring(text, res_start + 1, res_end - res_start), {STRIP}, '', 'g') AS results
    FROM sec_loc WHERE status = 'ok'""")
register("abbr_n", ["sec_loc", "sec_res"], f"""SELECT rtrim(w, '.' || chr(2)) AS word, count(*) FILTER (WHERE w LIKE '%.') AS n_stop,
      count(*) FILTER (WHERE w NOT LIKE '%.' AND w NOT LIKE '%' || chr(2)) AS n_plain, count(*) FILTER (WHERE w LIKE '%' || chr(2)) AS n_inside
    FROM (SELECT lower(unnest(list_concat(regexp_extract_all(t, {lit(T.for_re2(T.DOTTED_WORD_RE))}, 0),
            list_transform(regexp_extract_all(t, {lit(T.for_re2(T.INSIDE_WORD_RE))}, 1), lambda x: x || chr(2))))) AS w
          FROM (SELECT substring(text, {PRE_START + 1}, greatest(res_start - {PRE_START}, 0)) AS t FROM sec_loc WHERE status = 'ok'
                UNION ALL SELECT results FROM sec_res) x) q GROUP BY rtrim(w, '.' || chr(2))""")
register("abbr", ["abbr_n"], f"""SELECT *, score >= {P.MIN_SCORE} AND n_inside >= n_stop * {P.MIN_INSIDE} AS learned FROM (
    SELECT word, n_stop, n_plain, n_inside, round(2 * (n_stop * (ln({P.STOP_AFTER}::DOUBLE) - ln(base)) + n_plain * (ln(1 - {P.STOP_AFTER}::DOUBLE) - ln(1 - base)))
        * exp(-letters) * (length(word) - letters + 1) * pow(CAST(letters AS DOUBLE), -n_plain), 6) + 0.0::DOUBLE AS score
    FROM (SELECT *, length(replace(word, '.', '')) AS letters, stops / words AS base
          FROM abbr_n, (SELECT sum(n_stop) AS stops, sum(n_stop + n_plain) AS words FROM abbr_n) t) c
    WHERE n_stop > 0 AND n_stop >= stops * {P.MIN_SHARE} AND stops < words) s""")
register("abbr_all", ["abbr"], f"""SELECT list_concat([{', '.join(lit(w) for w in T.KNOWN_ABBREVIATIONS)}],
    coalesce((SELECT list(word) FROM abbr WHERE learned), [])) AS abbr""")
register("sents", ["sec_res", "abbr_all"], f"""SELECT doc_id, lang, CAST(unnest(range(0, len(ss))) AS BIGINT) AS sent_idx, unnest(ss) AS sentence FROM (
    SELECT doc_id, lang, {sql_sentences('results')} AS ss FROM sec_res, abbr_all) q""")
register("phr_all", ["sents"], f"""SELECT doc_id, sent_idx, sentence, CAST(unnest(range(0, len(pp))) AS BIGINT) AS phrase_idx, unnest(pp) AS phrase FROM (
    SELECT doc_id, sent_idx, sentence, {sql_runs(sql_marked('sentence'), True)} AS pp FROM sents) q""")
register("phrases", ["phr_all"], """SELECT doc_id, sent_idx, phrase_idx, phrase, sentence FROM (
    SELECT *, min(sent_idx) OVER (PARTITION BY doc_id, phrase) AS first_sent FROM phr_all) q WHERE sent_idx = first_sent""")


def located(spark, sf_dir):
    return S.locate_sections(fx.articles(spark, sf_dir))


def sections(spark, sf_dir):
    """Stage output: per article the anchor choice, status, span and the
    results / pre-results texts (not the full article), materialized once."""
    def build():
        loc = S.preresults_text(S.results_text(located(spark, sf_dir)), start=PRE_START)
        return loc.select("doc_id", "source", "lang", "heads", "n_headings", "start_idx", "start_sim", "end_idx", "end_sim",
                          "status", "res_start", "res_end", "results", "preresults")
    return stage(spark, sf_dir, "sections", build)


def results(spark, sf_dir):
    return sections(spark, sf_dir).where(F.col("status") == S.STATUS_OK).select("doc_id", "source", "lang", "results")


def abbreviations(spark, sf_dir):
    """Words before full stops with their abbreviation scores, learned from the
    texts that are split, before the results and in them; a stage output."""
    def build():
        texts = sections(spark, sf_dir).where(F.col("status") == S.STATUS_OK).select(F.explode(F.array("preresults", "results")).alias("text"))
        return P.abbreviation_scores(texts, "text")
    return stage(spark, sf_dir, "abbreviations", build)


def sentences(spark, sf_dir):
    return P.explode_sentences(results(spark, sf_dir), "results", ["doc_id"], ["lang"], abbreviations(spark, sf_dir).where("learned"))


def phrases_all(spark, sf_dir, covered=True):
    return P.explode_phrases(sentences(spark, sf_dir), ["doc_id"], covered=covered, lang="lang")


def phrases(spark, sf_dir):
    """The `phrases` fixture: covered phrases of the results sections,
    deduplicated across sentences; a stage output, materialized."""
    return stage(spark, sf_dir, "phrases", lambda: P.dedup_phrases(phrases_all(spark, sf_dir), ["doc_id"]))


@query("section_headings", compose(["sec_sim"], "SELECT doc_id, idx, start, heading FROM sec_sim"))
def q_section_headings(spark, sf_dir):
    loc = sections(spark, sf_dir)
    h = loc.select("doc_id", F.explode("heads").alias("h"))
    return h.select("doc_id", F.col("h.idx").cast("bigint").alias("idx"), F.col("h.start").cast("bigint").alias("start"),
                    F.col("h.heading").alias("heading"))


@query("section_anchor", compose(["sec_loc"], """SELECT doc_id, n_headings, CAST(start_idx AS BIGINT) AS start_idx, start_sim,
    CAST(end_idx AS BIGINT) AS end_idx, end_sim, status FROM sec_loc"""))
def q_section_anchor(spark, sf_dir):
    loc = sections(spark, sf_dir)
    return loc.select("doc_id", F.col("n_headings").cast("bigint").alias("n_headings"),
                      F.col("start_idx").cast("bigint").alias("start_idx"), "start_sim",
                      F.col("end_idx").cast("bigint").alias("end_idx"), "end_sim", "status")


@query("results_section", compose(["sec_res"], "SELECT doc_id, results FROM sec_res"))
def q_results_section(spark, sf_dir):
    return results(spark, sf_dir).select("doc_id", "results")


@query("preresults_section", compose(["sec_loc"], f"""SELECT doc_id,
    substring(text, {PRE_START + 1}, greatest(res_start - {PRE_START}, 0)) AS preresults FROM sec_loc WHERE status = 'ok'"""))
def q_preresults_section(spark, sf_dir):
    pre = sections(spark, sf_dir)
    return pre.where(F.col("status") == S.STATUS_OK).select("doc_id", "preresults")


@query("sentences", compose(["sents"], "SELECT doc_id, sent_idx, sentence FROM sents"))
def q_sentences(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), "sentence")


@query("abbreviations", compose(["abbr"], "SELECT word, CAST(n_stop AS BIGINT) AS n_stop, CAST(n_plain AS BIGINT) AS n_plain, CAST(n_inside AS BIGINT) AS n_inside, score, learned FROM abbr"))
def q_abbreviations(spark, sf_dir):
    """T4: words before full stops, with counts, score and whether they count as abbreviations."""
    return abbreviations(spark, sf_dir).select("word", "n_stop", "n_plain", "n_inside", "score", "learned")


@query("candidate_phrases", compose(["sents"], f"""SELECT doc_id, sent_idx, CAST(unnest(range(0, len(pp))) AS BIGINT) AS phrase_idx,
    unnest(pp) AS phrase FROM (SELECT doc_id, sent_idx, {sql_runs(sql_marked('sentence'), False)} AS pp FROM sents) q"""))
def q_candidate_phrases(spark, sf_dir):
    p = phrases_all(spark, sf_dir, covered=False)
    return p.select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"),
                    F.col("phrase_idx").cast("bigint").alias("phrase_idx"), "phrase")


@query("phrase_cover", compose(["phr_all"], "SELECT doc_id, sent_idx, phrase_idx, phrase FROM phr_all"))
def q_phrase_cover(spark, sf_dir):
    p = phrases_all(spark, sf_dir)
    return p.select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"),
                    F.col("phrase_idx").cast("bigint").alias("phrase_idx"), "phrase")


@query("phrase_positions", compose(["phr_all"], "SELECT doc_id, sent_idx, phrase_idx, phrase, sentence FROM phr_all"))
def q_phrase_positions(spark, sf_dir):
    p = phrases_all(spark, sf_dir)
    return p.select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"),
                    F.col("phrase_idx").cast("bigint").alias("phrase_idx"), "phrase", "sentence")


@query("phrase_dedup", compose(["phrases"], "SELECT doc_id, sent_idx, phrase_idx, phrase FROM phrases"))
def q_phrase_dedup(spark, sf_dir):
    p = phrases(spark, sf_dir)
    return p.select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"),
                    F.col("phrase_idx").cast("bigint").alias("phrase_idx"), "phrase")
