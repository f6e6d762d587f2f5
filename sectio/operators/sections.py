"""Results-section location.

One article is one row and stays one row: heading matches, their offsets,
the length guard, the similarity to both anchors, the best heading per
anchor (first on ties) and the span cut are array expressions on that row.
No shuffle, whole-stage code generation around the scan, and the work of a
long article stays inside its own task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.functions import text as T

STATUS_OK = "ok"
STATUS_NO_RESULTS = "no_results"
STATUS_NO_OUTCOMES = "no_outcomes"


def locate_sections(articles: DataFrame, text: str = "text", start_anchor: str = T.ANCHOR_START,
                    end_anchor: str = T.ANCHOR_END, min_score: float = T.ANCHOR_MIN_SCORE) -> DataFrame:
    """Adds ``heads`` (kept headings: idx, start, heading, sim_start,
    sim_end), the chosen start/end heading with scores, the character span
    ``res_start``..``res_end`` and ``status`` ('ok' / 'no_results')."""
    t = F.col(text)
    guard = F.floor(F.length(t) / T.HEAD_SKIP_FRACTION)
    kept = F.filter(T.headings(t), lambda h: h["start"] > guard)
    heads = F.transform(kept, lambda h, i: F.struct(
        i.alias("idx"), h["start"].alias("start"), T.clean_heading(h["match"]).alias("heading")))
    heads = F.transform(heads, lambda h: F.struct(
        h["idx"].alias("idx"), h["start"].alias("start"), h["heading"].alias("heading"),
        T.trigram_cosine(h["heading"], start_anchor).alias("sim_start"),
        T.trigram_cosine(h["heading"], end_anchor).alias("sim_end")))
    df = articles.withColumn("heads", heads)
    best_s = F.array_max(F.transform("heads", lambda h: F.struct(h["sim_start"].alias("s"), (-h["idx"]).alias("ni"))))
    best_e = F.array_max(F.transform("heads", lambda h: F.struct(h["sim_end"].alias("s"), (-h["idx"]).alias("ni"))))
    df = (df.withColumn("n_headings", F.size("heads"))
          .withColumn("start_sim", best_s["s"]).withColumn("start_idx", -best_s["ni"])
          .withColumn("end_sim", best_e["s"]).withColumn("end_idx", -best_e["ni"]))
    ok = ((F.col("n_headings") > 0) & (F.col("start_sim") >= min_score) & (F.col("end_sim") >= min_score)
          & (F.col("start_idx") <= F.col("end_idx")))
    df = df.withColumn("status", F.when(ok, F.lit(STATUS_OK)).otherwise(F.lit(STATUS_NO_RESULTS)))
    pos = lambda c: F.element_at("heads", F.col(c) + 1)["start"]
    return (df.withColumn("res_start", F.when(ok, pos("start_idx")))
              .withColumn("res_end", F.when(ok, pos("end_idx"))))


def results_text(located: DataFrame, text: str = "text") -> DataFrame:
    """Text from the results heading to the end heading, stripped."""
    span = F.substring(F.col(text), F.col("res_start") + 1, F.col("res_end") - F.col("res_start"))
    return located.withColumn("results", F.when(F.col("status") == STATUS_OK, T.strip_ws(span)))


def preresults_text(located: DataFrame, text: str = "text", start: int = T.PRERESULTS_START) -> DataFrame:
    """Text from character ``start`` up to the results heading, not
    stripped; empty when the heading comes before ``start``."""
    span = F.substring(F.col(text), F.lit(start + 1), F.greatest(F.col("res_start") - start, F.lit(0)))
    return located.withColumn("preresults", F.when(F.col("status") == STATUS_OK, span))
