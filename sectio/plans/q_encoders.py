"""Text vectorisers compared on one split (M10), and a search over them by
successive halving on the eval studies (M14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectio.functions.frames import materialize
from sectio.functions.ordering import hash_rank
from sectio.operators import classify as C
from sectio.operators import metrics as M
from sectio.operators import vectorizers as V
from sectio.plans import fixtures as fx
from sectio.plans.oracle import compose, register
from sectio.plans.q_metrics import report_ctes, report_sql
from sectio.plans.q_splits import lab_split, rank_sql
from sectio.plans.registry import query
from sectio.plans.stages import stage

# Rungs of the search: quarters of the training rows that its fits see.
RUNGS = (1, 2, 4)


def weights(spark, sf_dir) -> DataFrame:
    """Weighted grams of the labelled documents, a stage output."""
    return stage(spark, sf_dir, "doc_weights", lambda: V.weights(fx.labelled(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text"))


def vectors(spark, sf_dir) -> DataFrame:
    """(model, doc_id, v, cls, split) of every labelled document, a stage output.
    The split is that of the document's study; ``rn`` is its seeded rank among the
    training rows and ``n`` their number."""
    def build():
        out = None
        for name, make in V.VECTORIZERS.items():
            v = make(weights(spark, sf_dir), "doc_id").select(F.lit(name).alias("model"), "doc_id", "v")
            out = v if out is None else out.unionByName(v)
        split = lab_split(spark, sf_dir, n_use=None).select("study_id", "split")
        rows = fx.labelled(spark, sf_dir).select("doc_id", "study_id", F.col("label").alias("cls")).join(split, "study_id").drop("study_id")
        rank = hash_rank(rows.where(F.col("split") == "train").select("doc_id"), fx.SEED, "doc_id")
        return out.join(rows.join(rank, "doc_id", "left"), "doc_id")
    return stage(spark, sf_dir, "doc_vectors", build)


def scored(rows: DataFrame, test: str, quarters: int = 4) -> DataFrame:
    """Predictions of every model's nearest-centroid head on the studies ``test``,
    fitted on the first quarters of the training rows; one job for all models."""
    train = rows.where((F.col("split") == "train") & (F.col("rn") <= F.floor(F.col("n") * quarters / 4)))
    # A row a model, written so that its size is known: the rows are not dealt by model.
    model = materialize(C.fit_centroids(train, ["model"]))
    p = C.score_centroids(rows.where(F.col("split") == test), model, ["model"], "doc_id")
    return p.where(F.col("label") == F.col("y_pred")).select("model", "doc_id", "y_true", "y_pred")


def bits_sql(gram: str = "gram") -> str:
    return f"CAST(('0x' || substr(md5({gram}), 1, 8)) AS UBIGINT)"


def sign_sql(bits: str, place: str) -> str:
    return f"CASE WHEN ({bits} >> {place}) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


register("vz_n", ["labelled"], """SELECT doc_id, gram, count(*) AS n FROM (
    SELECT doc_id, substring(lower(t), unnest(range(1, length(lower(t)) - 1)), 3) AS gram FROM (SELECT doc_id, coalesce(text, '') AS t FROM labelled) a WHERE length(lower(t)) >= 3) q
    GROUP BY doc_id, gram""", materialized=True)
register("vz_t", ["vz_n", "labelled"], """SELECT n.doc_id, n.gram, n.n * ln(t.total / f.df) AS w FROM vz_n n
    JOIN (SELECT gram, count(*) AS df FROM vz_n GROUP BY gram) f ON n.gram = f.gram, (SELECT count(*)::DOUBLE AS total FROM labelled) t WHERE f.df < t.total""", materialized=True)
register("vz_w", ["vz_t"], f"""SELECT t.doc_id, t.gram, t.w / n.norm AS x, {bits_sql('t.gram')} AS bits FROM vz_t t
    JOIN (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM vz_t GROUP BY doc_id) n ON t.doc_id = n.doc_id""", materialized=True)
register("vz_hashed", ["vz_w"], f"""SELECT doc_id, list(y ORDER BY j) AS v FROM (
    SELECT d.doc_id, r.j, coalesce(s.y, 0.0) AS y FROM (SELECT DISTINCT doc_id FROM vz_w) d CROSS JOIN (SELECT unnest(range(0, {V.BUCKETS})) AS j) r
    LEFT JOIN (SELECT doc_id, bits % {V.BUCKETS} AS j, sum(x * {sign_sql('bits', '31')}) AS y FROM vz_w GROUP BY doc_id, bits % {V.BUCKETS}) s ON s.doc_id = d.doc_id AND s.j = r.j) q
    GROUP BY doc_id""")
_SUMS = ", ".join(f"sum(x * {sign_sql('bits', str(j))}) AS y{j}" for j in range(V.WIDE))
register("vz_y", ["vz_w"], f"SELECT doc_id, {_SUMS} FROM vz_w GROUP BY doc_id", materialized=True)
register("vz_projected", ["vz_y"], f"SELECT doc_id, [{', '.join(f'y{j}' for j in range(V.WIDE))}] AS v FROM vz_y")
register("vz_b", ["vz_w", "vz_y"], f"SELECT gram, {', '.join(f'sum(x * y{j}) AS b{j}' for j in range(V.NARROW))} FROM vz_w JOIN vz_y USING (doc_id) GROUP BY gram", materialized=True)
_last = "vz_b"
for _j in range(V.NARROW):  # Gram-Schmidt, one direction a step
    _less = "".join(f" - q{i} * (SELECT sum(b{_j} * q{i}) FROM {_last})" for i in range(_j))
    register(f"vz_u{_j}", [_last], f"SELECT *, b{_j}{_less} AS u FROM {_last}", materialized=True)
    register(f"vz_q{_j}", [f"vz_u{_j}"], f"SELECT * EXCLUDE (u), u / (SELECT sqrt(sum(u * u)) FROM vz_u{_j}) AS q{_j} FROM vz_u{_j}", materialized=True)
    _last = f"vz_q{_j}"
register("vz_reduced", ["vz_w", _last], f"""SELECT doc_id, [{', '.join(f'sum(x * q{j})' for j in range(V.NARROW))}] AS v FROM vz_w JOIN {_last} USING (gram) GROUP BY doc_id""")
register("vz_rows", ["labelled", "lab_sp_all"], f"""SELECT d.doc_id, d.label AS cls, s.split, r.rn, r.n FROM labelled d JOIN lab_sp_all s ON d.study_id = s.study_id
    LEFT JOIN ({rank_sql("(SELECT doc_id FROM labelled d JOIN lab_sp_all s ON d.study_id = s.study_id WHERE s.split = 'train') t", 'doc_id')}) r ON r.doc_id = d.doc_id""")
register("vz_all", ["vz_hashed", "vz_projected", "vz_reduced", "vz_rows"], "SELECT m.model, m.doc_id, m.v, r.cls, r.split, r.rn, r.n FROM ("
         + " UNION ALL ".join(f"SELECT '{n}' AS model, doc_id, v FROM vz_{n}" for n in V.VECTORIZERS) + ") m JOIN vz_rows r ON m.doc_id = r.doc_id", materialized=True)


def scored_sql(name: str, source: str, test: str, quarters: int) -> None:
    register(f"{name}_c", [source], f"""SELECT model, cls, list(m ORDER BY pos) AS c FROM (
        SELECT model, cls, pos, avg(x) AS m FROM (SELECT model, cls, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM {source}
          WHERE split = 'train' AND rn <= floor(n * {quarters} / 4)) d GROUP BY model, cls, pos) g GROUP BY model, cls""")
    register(name, [f"{name}_c", source], f"""SELECT model, doc_id, y_true, label AS y_pred FROM (
        SELECT *, row_number() OVER (PARTITION BY model, doc_id ORDER BY score DESC, label) AS r FROM (
          SELECT t.model, t.doc_id, t.cls AS y_true, c.cls AS label,
            round(list_dot_product(t.v, c.c) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(c.c, c.c))), 6) AS score
          FROM {source} t JOIN {name}_c c ON t.model = c.model WHERE t.split = '{test}') s) q WHERE r = 1""", materialized=True)


scored_sql("vz_test", "vz_all", "test", 4)


@query("text_vectors", compose(["vz_all"], "SELECT model, doc_id, CAST(len(v) AS BIGINT) AS dims, round(list_sum(list_transform(v, lambda x: x * x)), 5) AS squared FROM vz_all"))
def q_text_vectors(spark, sf_dir):
    """The three vectorisers' vectors of every labelled document, by size and
    squared length."""
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return vectors(spark, sf_dir).select("model", "doc_id", F.size("v").cast("bigint").alias("dims"), F.round(total, 5).alias("squared"))


@query("model_compare", compose(["vz_test"], """SELECT model,
    max(f1_score) FILTER (WHERE target = 'accuracy') AS accuracy,
    max(precision) FILTER (WHERE target = 'macro avg') AS macro_precision,
    max(recall) FILTER (WHERE target = 'macro avg') AS macro_recall,
    max(f1_score) FILTER (WHERE target = 'macro avg') AS macro_f1 FROM rep GROUP BY model""",
    local=report_ctes("vz_test", g="model") + [("rep", report_sql("vz_test", g="model"))]))
def q_model_compare(spark, sf_dir):
    """Every vectoriser fitted on the training studies' documents and scored on
    the test studies: accuracy and macro averages."""
    m = M.matrix(scored(vectors(spark, sf_dir), "test"), ["model"])
    rep = M.report_rows(m, ["model"])
    of = lambda target, c: F.max(F.when(F.col("target") == target, F.col(c)))
    return rep.groupBy("model").agg(of("accuracy", "f1_score").alias("accuracy"), of("macro avg", "precision").alias("macro_precision"),
                                    of("macro avg", "recall").alias("macro_recall"), of("macro avg", "f1_score").alias("macro_f1"))


def halving(spark, sf_dir) -> DataFrame:
    """Trials (number, value, model, run) of the search: every rung fits all models
    still in it in one job on more of the training rows and scores them on the eval
    studies; the better half, at least one, goes on (ties by name). No row of a test
    study is read. ``run`` is the rung's quarters; a trial is a row, so the table is
    as long as the grid."""
    rows = vectors(spark, sf_dir).where(F.col("split").isin("train", "eval"))
    left, trials = sorted(V.VECTORIZERS), []
    for quarters in RUNGS:
        p = scored(rows.where(F.col("model").isin(left)), "eval", quarters)
        acc = p.groupBy("model").agg(F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 6).alias("value"))
        got = sorted(acc.collect(), key=lambda r: r.model)  # a row a model
        trials += [(len(trials) + i, r.value, r.model, quarters) for i, r in enumerate(got)]
        best = sorted(got, key=lambda r: (-r.value, r.model))
        left = [r.model for r in best[:max(1, (len(best) + 1) // 2)]]
    return spark.createDataFrame(trials, "number long, value double, model string, run int")


_before = "(SELECT DISTINCT model FROM vz_all)"
for _i, _q in enumerate(RUNGS):
    register(f"vz_in{_i}", ["vz_all"] + ([f"vz_keep{_i - 1}"] if _i else []), f"SELECT * FROM vz_all WHERE split <> 'test' AND model IN (SELECT model FROM {_before} b)", materialized=True)
    scored_sql(f"vz_s{_i}", f"vz_in{_i}", "eval", _q)
    register(f"vz_acc{_i}", [f"vz_s{_i}"], f"SELECT model, {_q} AS run, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS value FROM vz_s{_i} GROUP BY model", materialized=True)
    register(f"vz_keep{_i}", [f"vz_acc{_i}"], f"""SELECT model FROM (SELECT *, row_number() OVER (ORDER BY value DESC, model) AS r, count(*) OVER () AS n FROM vz_acc{_i}) q
        WHERE r <= greatest(1, (n + 1) // 2)""", materialized=True)
    _before = f"vz_keep{_i}"
register("trials", [f"vz_acc{i}" for i in range(len(RUNGS))], "SELECT CAST(row_number() OVER (ORDER BY run, model) - 1 AS BIGINT) AS trial, value AS objective_value, model AS encoder, CAST(run AS BIGINT) AS train_quarters FROM ("
         + " UNION ALL ".join(f"SELECT * FROM vz_acc{i}" for i in range(len(RUNGS))) + ") q")
