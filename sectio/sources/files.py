"""File sources and sinks.

Sources name their schema (no inference) and rename columns once, at the
source. Sinks write directories of part files with Spark's writers: CSV with
a header, JSON lines, Parquet; appends carry a run id column instead of a
read-modify-write of one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectio.sources.schemas import MAPPING_RENAMES


def scan_text_corpus(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """One row per file with the given suffix (whole file as one
    string); the id is the file name without the suffix, cast to a number
    where it is one."""
    df = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), suffix.replace(".", "[.]") + "$", "")
    return df.select(stem.alias("file_id"), stem.try_cast("bigint").alias("study_id"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """CSV with header; quoted fields may span lines (labels hold
    newlines), so one file is one task: write large inputs as Parquet once.

    Columns are taken by name, in any order, after ``renames`` (file name ->
    schema name; the known spellings by default); further columns are left out
    and a missing one is an error. A value that is not of the column's type
    becomes null."""
    names = MAPPING_RENAMES if renames is None else renames
    raw = (spark.read.option("header", "true").option("inferSchema", "false").option("multiLine", "true")
           .option("escape", '"').csv(path))
    by_name: dict[str, str] = {}
    for c in raw.columns:
        by_name.setdefault(names.get(c.strip(), c.strip()), c)
    missing = [f.name for f in schema.fields if f.name not in by_name]
    if missing:
        raise ValueError(f"{path}: no column for {', '.join(missing)}; the file has {', '.join(raw.columns)}")
    return raw.select(*(F.col(f"`{by_name[f.name]}`").try_cast(f.dataType).alias(f.name) for f in schema.fields))


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """Report documents from every file matching a path glob, kept as
    text (``report``) for ``reportio.flatten_reports``. A file holds a JSON array
    of reports, or one report per line; a lone object over several lines counts
    as one report. ``parsed`` is false for text that is no JSON object."""
    whole = spark.read.option("recursiveFileLookup", "true").text(pattern, wholetext=True).select(F.trim(F.regexp_replace("value", "^\\s+|\\s+$", "")).alias("v")).where(F.length("v") > 0)
    first_line = F.trim(F.split("v", "[\r\n]+")[0])
    one = F.col("v").startswith("{") & ~first_line.endswith("}") & F.try_parse_json("v").isNotNull()
    rows = F.when(F.col("v").startswith("["), F.coalesce(F.from_json("v", "array<string>"), F.array("v"))).when(one, F.array("v")).otherwise(F.split("v", "[\\r\\n]+"))
    out = whole.select(F.explode(rows).alias("report")).where(F.length(F.trim("report")) > 0)
    return out.withColumn("parsed", F.trim("report").startswith("{") & F.try_parse_json("report").isNotNull())


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1/K5: header, no index column."""
    # The writer would otherwise trim the values.
    (df.write.mode(mode).option("header", "true").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))


def write_reports(df: DataFrame, path: str, run_id: str, mode: str = "append") -> None:
    """K2/K3: one report per line (``report`` column), in a folder of the run
    (``run_id=...``). Appending replaces the files of the same run, if there are
    any (a run that is written again after a failure counts once), and never
    touches other runs; ``overwrite`` replaces all runs."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    rows = df.select("report", F.lit(run_id).alias("run_id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if mode == "append" else "static").partitionBy("run_id").text(path)
