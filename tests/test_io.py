"""Sources and sinks: round trips through files."""

import json

from pyspark.sql import types as T

from sectio.operators import metrics as M
from sectio.operators import reportio as RIO
from sectio.sources import files, trials


def test_csv_round_trip_keeps_newlines(spark, tmp_path):
    schema = T.StructType([T.StructField("study_id", T.LongType()), T.StructField("domain", T.StringType())])
    df = spark.createDataFrame([(1, "Infection and infestation\n outcomes"), (2, 'quoted "x", y')], schema)
    files.write_csv(df, str(tmp_path / "m"))
    back = files.read_csv(spark, str(tmp_path / "m"), schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_text_corpus_scan(spark, tmp_path):
    (tmp_path / "17.txt").write_text("a\nb")
    (tmp_path / "x9.txt").write_text("c")
    (tmp_path / "skip.pdf").write_text("no")
    got = {r["file_id"]: (r["study_id"], r["text"]) for r in files.scan_text_corpus(spark, str(tmp_path)).collect()}
    assert got == {"17": (17, "a\nb"), "x9": (None, "c")}


def test_reports_write_read_flatten(spark, tmp_path):
    p = spark.createDataFrame([(1, "outcome", "outcome"), (1, "not outcome", "outcome"), (2, "outcome", "not outcome")],
                              ["run", "y_true", "y_pred"])
    rep = M.classification_report(p, ["run"])
    scal = spark.createDataFrame([(1, 0.75, 5, 1, 0), (2, None, 7, 0, 1)], "run int, AUROC double, n_articles int, fp_o int, fp_no int")
    js = RIO.reports_json(rep, scal, ["run"], {"FP": ["fp_o", "fp_no"]})
    for r in js.collect():
        json.loads(r["report"])  # valid JSON
    files.write_reports(js, str(tmp_path / "n-art_binary_model-a"), "first")
    files.write_reports(js.where("run = 1"), str(tmp_path / "n-art_binary_model-b"), "again")
    back = files.read_reports(spark, str(tmp_path / "n-art_binary_model*"))
    assert back.count() == 3 and back.where("parsed").count() == 3
    files.write_reports(js, str(tmp_path / "n-art_binary_model-a"), "second")
    assert files.read_reports(spark, str(tmp_path / "n-art_binary_model-a")).count() == 4
    # A run that is written again replaces itself and no other.
    for _ in range(2):
        files.write_reports(js.where("run = 2"), str(tmp_path / "n-art_binary_model-a"), "second")
    both = spark.read.text(str(tmp_path / "n-art_binary_model-a"))
    assert sorted((r["run_id"], r["count"]) for r in both.groupBy("run_id").count().collect()) == [("first", 2), ("second", 1)]
    files.write_reports(js, str(tmp_path / "n-art_binary_model-c"), "x")
    files.write_reports(js.where("run = 1"), str(tmp_path / "n-art_binary_model-c"), "y", mode="overwrite")
    assert files.read_reports(spark, str(tmp_path / "n-art_binary_model-c")).count() == 1
    flat = RIO.flatten_reports(js.select("run", "report"), ["run"], ["outcome", "not outcome"],
                               {"n_articles": "n_articles", "AUROC": "auroc", "missing": "gone"}, {"FP": ["fp_o", "fp_no"]})
    r1 = flat.where("run = 1 AND target = 'outcome' AND metric = 'precision'").first()
    assert r1["score"] == 0.5 and r1["n_articles"] == 5.0 and r1["auroc"] == 0.75 and r1["gone"] is None
    assert (r1["fp_o"], r1["fp_no"]) == (1, 0)


def test_trial_log_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(0, 0.5, "full", 1), (1, 0.625, "head", 2)], "number int, value double, model string, run int")
    lines = trials.trial_lines(t)
    assert lines.first()["line"] == "Trial 0 | Objective value: 0.5 | Hyperparameters: {'encoder': 'full', 'train_quarters': 1}"
    trials.write_trial_log(lines, str(tmp_path / "hpo_trials-1"))
    (tmp_path / "other.txt").write_text("Trial 9 | Objective value: 0.1 | Hyperparameters: {}")
    back = trials.parse_trial_lines(trials.read_trial_logs(spark, str(tmp_path)))
    got = sorted(tuple(r) for r in back.select("trial", "objective_value", "encoder", "train_quarters").collect())
    assert got == [(0, 0.5, "full", 1), (1, 0.625, "head", 2)]
    line = "Trial 3 | Objective value: 0.91 | Hyperparameters: {'body_learning_rate': 6.8e-05, 'num_epochs': 2, 'batch_size': 64, 'max_iter': 200, 'solver': 'liblinear', 'other': 1}"
    r = trials.parse_trial_lines(spark.createDataFrame([(line,)], "line string")).first()
    assert (r.trial, r.body_learning_rate, r.num_epochs, r.batch_size, r.max_iter, r.solver, r.encoder) == (3, 6.8e-05, 2, 64, 200, "liblinear", None)


def test_csv_by_name_in_any_order(spark, tmp_path):
    import pytest

    from sectio.sources.schemas import MAPPING

    (tmp_path / "m.csv").write_text('Verbatim Outcomes,Study ID,extra,Outcome Domains,Core Areas\n"a ""b""\nc",7,z,Pain,x\nd,seven,z,,\n')
    got = sorted(map(tuple, files.read_csv(spark, str(tmp_path / "m.csv"), MAPPING).collect()), key=str)
    assert got == [(7, 'a "b"\nc', "Pain", "x"), (None, "d", None, None)]
    (tmp_path / "old.csv").write_text("Study-id,Verbatim Outcomes,Outcome Domains\n1,a,b\n")
    with pytest.raises(ValueError, match="core_area"):
        files.read_csv(spark, str(tmp_path / "old.csv"), MAPPING)


def test_reports_as_arrays_lines_and_rubbish(spark, tmp_path):
    (tmp_path / "r-array.json").write_text('[{"a": {"x": 1}, "n": 2},\n {"a": {"x": 3}}]')
    (tmp_path / "r-lines.json").write_text('{"n": 4}\n\n{"n": 5}\n')
    (tmp_path / "r-one.json").write_text('{\n "n": 6\n}\n')
    (tmp_path / "r-bad.json").write_text("not json\n")
    (tmp_path / "r-empty.json").write_text("  \n")
    got = files.read_reports(spark, str(tmp_path / "r-*.json")).collect()
    assert sorted(json.dumps(json.loads(r.report)) for r in got if r.parsed) == sorted(
        ['{"a": {"x": 1}, "n": 2}', '{"a": {"x": 3}}', '{"n": 4}', '{"n": 5}', '{"n": 6}'])
    assert [r.report for r in got if not r.parsed] == ["not json"]


def test_trial_numbers_and_foreign_lines(spark):
    lines = ["Trial 3 | Objective value: 5.0E-4 | Hyperparameters: {'encoder': 'full', 'train_quarters': 1}", "Trial 4 | Objective value: 12.5 | Hyperparameters: {}",
             "Trial 5 | Objective value: nan | Hyperparameters: oops", "some log line", "", "Trial 6 | Objective value: 1e-05 | Hyperparameters: {'encoder': 'x'}"]
    got = sorted(tuple(r)[:2] for r in trials.parse_trial_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect())
    assert got == [(3, 0.0005), (4, 12.5), (5, None), (6, 1e-05)]
    small = spark.createDataFrame([(0, 1e-5, "full", 1)], "number int, value double, model string, run int")
    assert trials.parse_trial_lines(trials.trial_lines(small)).first()["objective_value"] == 1e-5


def test_logistic_head_save_load_and_optimum(spark, tmp_path):
    from sectio.operators import logistic as LG

    rows = [(f"wound infection {i}", "outcome") for i in range(12)] + [(f"we thank the nurses {i}", "not outcome") for i in range(20)] + [(None, "outcome"), ("ab", None)]
    df = spark.createDataFrame(rows, "text string, label string")
    head = LG.fit(df, "text", "label", dims=256)
    head.save(str(tmp_path / "head"))
    got, again = (LG.predict(df, h, "text").collect() for h in (head, LG.load(spark, str(tmp_path / "head"))))
    assert [tuple(r) for r in got] == [tuple(r) for r in again] and len(got) == len(rows)
    for label, n in (("outcome", 13), ("not outcome", 20)):
        assert abs(sum(r.probabilities[label] for r in got if r.label) - n) < 1e-3
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 and r.prob == r.probabilities[r.predicted] for r in got)
    assert sum(r.predicted == r.label for r in got if r.label and r.text) == 32


def test_text_model_save_load(spark, tmp_path):
    from sectio.operators import textmodel as TM

    train = spark.createDataFrame([("a", "wound infection", "outcome"), ("b", "we thank", "not outcome")], "k string, text string, cls string")
    TM.save(TM.fit_head(train, "k", "text", "cls"), str(tmp_path / "m"))
    back = TM.score_texts(spark.createDataFrame([("wound",)], "t string"), "t", TM.load(spark, str(tmp_path / "m"))).first()
    assert back["label"] == "outcome"
