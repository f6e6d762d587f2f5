"""Round trips over files (S2-S6, K1-K5): what the sinks write into the shared
folder, read back by the sources. Each query's rows are those of the table that was
written, so its oracle is that table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sectio.operators import reportio as RIO
from sectio.plans import fixtures as fx
from sectio.plans.oracle import compose
from sectio.plans.q_reports import COUNT_KEYS, TARGETS, size_reports, trial_table
from sectio.plans.registry import query
from sectio.session import checkpoint_dir
from sectio.sources import files
from sectio.sources import trials as TR
from sectio.sources.schemas import MAPPING


def folder(spark, name: str) -> str:
    """A new folder in the shared one; it goes when the cluster clears that."""
    return f"{checkpoint_dir(spark).rstrip('/')}/sectio-files-{uuid.uuid4().hex}/{name}"


@query("mapping_csv", compose(["mapping"], "SELECT study_id, verbatim, domain FROM mapping"))
def q_mapping_csv(spark, sf_dir):
    """The mapping sheet as CSV under the sheet's column names (labels
    hold line breaks), read back by name."""
    sheet = fx.mapping(spark, sf_dir).select(
        F.lit(None).cast("string").alias("Core Areas"), F.col("domain").alias("Outcome Domains"), F.col("verbatim").alias("Verbatim Outcomes"), F.col("study_id").alias("Study ID"))
    path = folder(spark, "mapping.csv")
    files.write_csv(sheet, path)
    back = files.read_csv(spark, path, MAPPING)
    return back.select(F.col("study_id").cast("bigint").alias("study_id"), "verbatim", "domain")


@query("report_files", compose(["flat"], "SELECT * FROM flat"))
def q_report_files(spark, sf_dir):
    """The reports of all training sizes, each appended as its own run
    and one of them twice (a run that is written again counts once), read back from
    the folder and flattened."""
    path = folder(spark, "reports")
    reports = size_reports(spark, sf_dir)
    for run in (1, 2, 3, 1):
        own = reports.where(F.col("run") == run) if run < 3 else reports.where(F.col("run") >= 3)
        files.write_reports(own.select(F.regexp_replace("report", "^\\{", F.concat(F.lit('{"run": '), F.col("run").cast("string"), F.lit(", "))).alias("report")), path, f"size-{run}")
    back = files.read_reports(spark, path).where("parsed")
    back = back.withColumn("run", F.get_json_object("report", "$.run").cast("bigint"))
    return RIO.flatten_reports(back, ["run"], TARGETS, {"n_articles": "n_articles", "accuracy": "accuracy", "AUROC": "auroc", "AUPRC": "auprc"}, COUNT_KEYS)


@query("trial_log_files", compose(["trials"], "SELECT trial, objective_value, encoder, train_quarters FROM trials"))
def q_trial_log_files(spark, sf_dir):
    """The search's lines appended to a log folder, read back by name and parsed."""
    path = folder(spark, "logs")
    TR.write_trial_log(TR.trial_lines(trial_table(spark, sf_dir)), f"{path}/hpo_trials-1")
    back = TR.parse_trial_lines(TR.read_trial_logs(spark, path))
    return back.select("trial", "objective_value", "encoder", "train_quarters")
