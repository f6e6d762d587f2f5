"""Hyper-parameter search logs: one text line per trial (K4) and their
parsing (S6, F9, F10, F15).

Line format: ``Trial <n> | Objective value: <float> | Hyperparameters: <dict>``
with the parameter dict in Python literal form (single quotes). Parsing keeps
number, objective and parameters of one line together (regex per line), and
reads the dict with ``from_json`` (single quotes accepted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the log line layout ---------------------------------------
LINE_FORMAT = "Trial %d | Objective value: %s | Hyperparameters: %s"
NUMBER_RE = r"^Trial (\d+)"
OBJECTIVE_RE = r"Objective value: ([-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?)"
PARAMS_RE = r"Hyperparameters: (.*?)$"
# -----------------------------------------------------------------------------

# Parameters of this library's search, and of the original one; others are left out.
PARAMS_SCHEMA = ("struct<encoder:string,train_quarters:bigint,body_learning_rate:double,num_epochs:bigint,"
                 "batch_size:bigint,max_iter:bigint,solver:string>")


def trial_lines(trials: DataFrame) -> DataFrame:
    """Rows (line) from trials (number, value, model, run)."""
    params = F.format_string("{'encoder': '%s', 'train_quarters': %d}", F.col("model"), F.col("run"))
    return trials.select(F.format_string(LINE_FORMAT, F.col("number"), F.col("value").cast("string"), params).alias("line"))


def parse_trial_lines(lines: DataFrame, params_schema: str = PARAMS_SCHEMA) -> DataFrame:
    """Trial lines as columns; other lines are left out. A number that cannot be
    read is null."""
    lines = lines.where(F.col("line").rlike(NUMBER_RE))
    p = F.from_json(F.regexp_extract("line", PARAMS_RE, 1), params_schema, {"allowSingleQuotes": "true"})
    out = lines.select(
        F.regexp_extract("line", NUMBER_RE, 1).try_cast("bigint").alias("trial"),
        F.regexp_extract("line", OBJECTIVE_RE, 1).try_cast("double").alias("objective_value"),
        p.alias("p"),
    )
    return out.select("trial", "objective_value", "p.*")


def read_trial_logs(spark: SparkSession, folder: str, token: str = "hpo_trials") -> DataFrame:
    """Every log in ``folder`` whose name contains ``token`` (a text
    file, or a folder of part files written by ``write_trial_log``), one row
    per non-empty line."""
    df = spark.read.text(f"{folder.rstrip('/')}/*{token}*")
    return df.select(F.col("value").alias("line")).where(F.length(F.trim("line")) > 0)


def write_trial_log(trials_lines: DataFrame, path: str) -> None:
    """K4: append the lines of a search to a log folder."""
    trials_lines.write.mode("append").text(path)
