"""DuckDB twins of the derived views, as CTE snippets.

``compose(["preds"], "SELECT ...")`` returns ``WITH <deps...> SELECT ...`` with
every view the named ones depend on, in dependency order. The base tables
(documents, labels, embeddings, ...) are views registered by the checker.
"""

from __future__ import annotations

from sectio.functions.labels import LABEL_FIXES, NOT_OUTCOME, OUTCOME
from sectio.plans import fixtures as fx

NL = "chr(10)"


def lit(s: str | None) -> str:
    """SQL literal for a Python string (newlines spelled with chr(10))."""
    if s is None:
        return "NULL"
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return f" || {NL} || ".join(quoted) if len(quoted) > 1 else quoted[0]


WS = "[ \\t\\n\\r\\f\\x0B]"
STRIP = f"'^{WS}+|{WS}+$'"


def clean_label_sql(x: str) -> str:
    cases = " ".join(f"WHEN {x} = {lit(k)} THEN {lit(v)}" for k, v in LABEL_FIXES.items())
    return f"regexp_replace(CASE {cases} ELSE {x} END, {STRIP}, '', 'g')"


def domain_sql(label: str) -> str:
    cases = " ".join(f"WHEN {label} = {i} THEN {lit(d)}" for i, d in enumerate(fx.MAPPING_DOMAINS) if d is not None)
    return f"CASE {cases} ELSE NULL END"


def wrap(h: str) -> str:
    return f"{NL} || {NL} || {h} || {NL} || {NL}"


_H3 = f"CASE WHEN doc_id % 10 = 0 THEN {lit(fx.H_APPENDIX)} ELSE {lit(fx.H_RESULTS)} END"
_HA = f"CASE WHEN doc_id % 10 = 1 THEN {lit(fx.H_DISCUSSION)} ELSE {_H3} END"
_HB = f"CASE WHEN doc_id % 10 = 1 THEN {_H3} ELSE {lit(fx.H_DISCUSSION)} END"


def _nc(prefix: str, src: str, runs: int = 4, group: list[str] | None = None) -> dict[str, tuple[list[str], str]]:
    """Nearest-centroid predictions over view ``src`` (group..., vec_id, v, cls)."""
    p = prefix
    g = list(group or [])
    gs = "".join(f"{c}, " for c in g)
    pb = f"PARTITION BY {', '.join(g)} " if g else ""
    on = "".join(f" AND t.{c} = c.{c}" for c in g)
    return {
        f"{p}_s": ([src], f"""SELECT *, CAST(round_even(0.75 * n, 0) AS BIGINT) AS n_train FROM (
            SELECT {gs}vec_id, v, cls,
                   row_number() OVER ({pb}ORDER BY md5('4220|' || CAST(vec_id AS VARCHAR)), vec_id) AS rn,
                   count(*) OVER ({pb.strip()}) AS n
            FROM {src}) q"""),
        f"{p}_runs": ([], f"SELECT unnest(range(1, {runs + 1})) AS run"),
        f"{p}_train": ([f"{p}_s", f"{p}_runs"], f"""SELECT {''.join(f's.{c}, ' for c in g)}s.vec_id, s.v, s.cls, r.run FROM {p}_s s JOIN {p}_runs r
            ON s.rn <= floor(s.n_train * r.run / {runs}) WHERE s.rn <= s.n_train"""),
        f"{p}_cent": ([f"{p}_train"], f"""SELECT {gs}run, cls, list(m ORDER BY pos) AS c FROM (
            SELECT {gs}run, cls, pos, avg(x) AS m FROM (
              SELECT {gs}run, cls, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM {p}_train) d
            GROUP BY {gs}run, cls, pos) g GROUP BY {gs}run, cls"""),
        f"{p}_score": ([f"{p}_s", f"{p}_runs", f"{p}_cent"], f"""SELECT t.vec_id, {''.join(f't.{c}, ' for c in g)}r.run, t.cls AS y_true, c.cls AS label,
            round(list_dot_product(t.v, c.c) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(c.c, c.c))), 6) AS score
            FROM {p}_s t JOIN {p}_runs r ON TRUE JOIN {p}_cent c ON c.run = r.run{on} WHERE t.rn > t.n_train"""),
        p: ([f"{p}_score"], f"""SELECT vec_id, {gs}run, y_true,
            first_value(label) OVER (PARTITION BY vec_id, {gs}run ORDER BY score DESC, label) AS y_pred, label, score
            FROM {p}_score"""),
    }


VIEWS: dict[str, tuple[list[str], str]] = {
    "articles": ([], f"""SELECT doc_id, source, lang,
        substring(text, 1, c1) || {wrap(lit(fx.H_INTRO))} || substring(text, c1 + 1, c2 - c1)
        || {wrap(lit(fx.H_METHODS))} || substring(text, c2 + 1, c3 - c2)
        || {wrap(_HA)} || substring(text, c3 + 1, c4 - c3)
        || {wrap(_HB)} || substring(text, c4 + 1) AS text
        FROM (SELECT doc_id, source, lang, text,
                CAST(floor(length(text) * 1 / 10) AS INTEGER) AS c1,
                CAST(floor(length(text) * 3 / 10) AS INTEGER) AS c2,
                CAST(floor(length(text) * 5 / 10) AS INTEGER) AS c3,
                CAST(floor(length(text) * 8 / 10) AS INTEGER) AS c4
              FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents) a) d"""),
    "labelled": ([], f"""SELECT d.source AS study_id, d.doc_id, d.text,
        CASE WHEN l.quality = 0 THEN '{OUTCOME}' ELSE '{NOT_OUTCOME}' END AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "mapping": ([], f"""SELECT vec_id % {fx.N_STUDIES} AS study_id, 'phrase ' || CAST(vec_id AS VARCHAR) AS verbatim,
        {domain_sql('label')} AS domain, vec_id FROM embeddings"""),
    "indicator": (["mapping"], """SELECT * FROM (
        SELECT study_id, study_id % 4 <> 3 AS has_results, study_id % 3 <> 0 AS has_negatives
        FROM (SELECT DISTINCT study_id FROM mapping WHERE study_id < 17) s) f
        UNION ALL SELECT * FROM (
        SELECT study_id, study_id % 4 <> 3 AS has_results, study_id % 3 <> 0 AS has_negatives
        FROM (SELECT DISTINCT study_id FROM mapping WHERE study_id < 17) s) g"""),
    "cemb": ([], f"""SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
        coalesce({clean_label_sql(domain_sql('label'))}, '{NOT_OUTCOME}') AS cls FROM embeddings"""),
    "cemb_bin": ([], f"""SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
        CASE WHEN label < 5 THEN '{OUTCOME}' ELSE '{NOT_OUTCOME}' END AS cls FROM embeddings"""),
}
VIEWS.update(_nc("preds", "cemb"))
VIEWS.update(_nc("preds_bin", "cemb_bin"))
VIEWS["od_preds"] = (["preds", "preds_bin"], f"""SELECT b.vec_id, b.run, m.y_true AS label, b.y_pred AS predicted,
    CASE WHEN b.y_pred = '{OUTCOME}' THEN m.y_pred END AS predicted_od
    FROM (SELECT DISTINCT vec_id, run, y_pred FROM preds_bin) b
    JOIN (SELECT DISTINCT vec_id, run, y_true, y_pred FROM preds) m ON b.vec_id = m.vec_id AND b.run = m.run""")


MATERIALIZED: set[str] = set()


def register(name: str, deps: list[str], sql: str, materialized: bool = False) -> None:
    """``materialized``: a view that later ones read more than once, in chains."""
    VIEWS[name] = (deps, sql)
    if materialized:
        MATERIALIZED.add(name)


def compose(names: list[str], final_sql: str, local: list[tuple[str, str]] | None = None) -> str:
    """``local``: query-specific CTEs appended after the shared views."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = VIEWS[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [(n, VIEWS[n][1]) for n in order] + list(local or [])
    if not parts:
        return final_sql
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in MATERIALIZED)}(\n{sql}\n)" for n, sql in parts)
    return f"WITH {ctes}\n{final_sql}"
