"""Readers and writers for panels, series, forecasts, ledgers and run summaries."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweave.functions.columns import month_label
from crossweave.operators.prep import month_keys


def load_panel(spark: SparkSession, path: str, columns: list[str], date: str = "eom") -> DataFrame:
    """Only the named columns of a Parquet panel, with month keys."""
    return month_keys(spark.read.parquet(path).select(*dict.fromkeys([*columns, date])), date)


def load_series(spark: SparkSession, path: str, value: str, date: str = "observation_date") -> DataFrame:
    """CSV of (date, text); text that is not a number becomes NULL."""
    raw = spark.read.schema(f"`{date}` date, `{value}` string").option("header", True).csv(path)
    return raw.select(date, F.expr(f"try_cast(`{value}` AS double)").alias(value))


def load_forecasts(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(permno, target_month, forecast); outcome columns in the file are never read."""
    return spark.read.parquet(path).select("permno", "target_month", F.col(column).alias("forecast"))


def write_holdings(df: DataFrame, path: str, by: str = "trial") -> None:
    """Parquet partitioned by trial; an overwrite replaces the written trials only."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def write_table(df: DataFrame, path: str) -> None:
    """CSV with header, for ledgers, exposures, checks and summaries."""
    df.write.mode("overwrite").option("header", True).csv(path)


def complete_trials(checkpoint: DataFrame, months: DataFrame, trial: str = "trial", month: str = "month") -> DataFrame:
    """Trials whose rows are exactly the expected months, once each."""
    expected = months.select(month).distinct()
    wanted = expected.agg(F.count(F.lit(1))).scalar()
    flagged = checkpoint.join(expected.withColumn("__known", F.lit(1)), month, "left")
    per_month = flagged.groupBy(trial, month).agg(F.count(F.lit(1)).alias("__n"), F.max("__known").alias("__known"))
    seen = per_month.groupBy(trial).agg(
        F.sum("__known").alias("__have"), F.count(F.lit(1)).alias("__months"), F.max("__n").alias("__max"))
    return seen.filter((F.col("__have") == wanted) & (F.col("__months") == wanted) & (F.col("__max") == 1)).select(trial)


def pending_trials(trials: DataFrame, checkpoint: DataFrame, months: DataFrame, failed: DataFrame | None = None,
                   trial: str = "trial", month: str = "month") -> DataFrame:
    """Trials still to run: neither complete in the checkpoint nor recorded as failed."""
    left = trials.join(complete_trials(checkpoint, months, trial, month), trial, "left_anti")
    return left.join(failed.select(trial), trial, "left_anti") if failed is not None else left


def usable_checkpoint(checkpoint: DataFrame, pending: DataFrame, trial: str = "trial") -> DataFrame:
    """Checkpoint rows to keep: partial rows of pending trials are dropped."""
    return checkpoint.join(pending.select(trial), trial, "left_anti")


RUN_JSON = "status string, experiment string, forecast string, prediction_sha256 string, months array<string>"


def run_number(run: Column) -> Column:
    """Number at the end of a run folder's name; a name without one counts as 0."""
    return F.coalesce(F.nullif(F.regexp_extract(run, "([0-9]+)$", 1), F.lit("")).cast("long"), F.lit(0))


def _folder() -> list[Column]:
    """Experiment and run of a file in <root>/<experiment>/outputs/<run>/."""
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "\\+", "%2B"))
    pattern = "([^/]+)/outputs/([^/]+)/"
    return [F.regexp_extract(path, pattern, 1).alias("experiment"), F.regexp_extract(path, pattern, 2).alias("run")]


def run_folders(spark: SparkSession, root: str) -> DataFrame:
    """One row per run folder with a run.json: experiment, run, run_number, status, forecast, prediction_hash, months, start, end.

    Experiment and run are names of folders, the rest is what the run wrote about itself; a file that is no JSON has nulls.
    """
    raw = spark.read.text(f"{root}/*/outputs/*/run.json", wholetext=True).select(*_folder(), F.from_json("value", RUN_JSON).alias("j"))
    months = F.sort_array("j.months")
    return raw.select("experiment", "run", run_number(F.col("run")).alias("run_number"), F.coalesce("j.status", F.lit("unknown")).alias("status"), "j.forecast",
                      F.col("j.prediction_sha256").alias("prediction_hash"), months.alias("months"),
                      F.try_element_at(months, F.lit(1)).alias("start"), F.try_element_at(months, F.lit(-1)).alias("end"))


def run_tables(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of the CSV `name` of all run folders, with experiment and run, by column name.

    Runs of different ages have different columns: files are read together with those of the same header, a column that a file lacks is NULL
    and one that `schema` does not name is left out. `has` lists the file's columns. The driver sees headers and paths, not rows.
    """
    wanted = T.StructType.fromDDL(schema)
    glob = f"{root}/*/outputs/*/{name}"
    first = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.element_at(F.split("value", "\r?\n", 2), 1).alias("header"))
    headers = first.where("header <> ''").groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    out = None
    for r in headers:
        names = next(csv.reader([r["header"]]))
        paths = [unquote(p) for p in r["paths"]]
        rows = spark.read.option("header", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(paths)
        cast = [F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in names else F.lit(None).cast(f.dataType) for f in wanted]
        part = rows.select(*_folder(), F.array(*map(F.lit, names)).alias("has"), *[c.alias(f.name) for c, f in zip(cast, wanted)])
        out = part if out is None else out.unionByName(part)
    empty = T.StructType.fromDDL(f"experiment string, run string, has array<string>, {schema}")
    return out if out is not None else spark.createDataFrame([], empty)


def run_comparison(spark: SparkSession, root: str, schema: str, needs: tuple[str, ...] = ("mean_one_way_turnover",)) -> DataFrame:
    """Summary rows of the last complete run per experiment, inputs and window. Runs whose summary lacks a column of `needs` were made
    under older rules and are left out before the last is picked."""
    runs = run_folders(spark, root).where("status = 'complete'").drop("months")
    rows = run_tables(spark, root, "summary.csv", schema).where(F.size(F.array_except(F.array(*map(F.lit, needs)), F.col("has"))) == 0).drop("has")
    both = rows.join(runs, ["experiment", "run"]).withColumn("__order", F.struct("run_number", "run"))
    return latest_runs(both, run="__order").drop("__order")


def latest_runs(summaries: DataFrame, keys=("experiment", "forecast", "prediction_hash", "start", "end"),
                run: str = "run", status: str = "status") -> DataFrame:
    """The last complete run per experiment, inputs and window."""
    w = W.partitionBy(*keys).orderBy(F.col(run).desc())
    return (summaries.filter(F.col(status) == "complete").withColumn("__n", F.row_number().over(w))
            .filter("__n = 1").drop("__n"))


def matching_runs(current: DataFrame, others: DataFrame, ledgers: DataFrame) -> DataFrame:
    """The current run's ledger plus, per other experiment, its newest complete run with equal
    forecast, input hash and month list.

    current: one row (experiment, run, forecast, prediction_hash), more or none are refused; others: run rows with
    status; ledgers: (experiment, run, month, ...).
    """
    if len(current.take(2)) != 1:
        raise ValueError("The current run is one row.")
    months = ledgers.groupBy("experiment", "run").agg(F.sort_array(F.collect_list("month")).alias("months"))
    mine = current.join(months, ["experiment", "run"]).select(
        F.col("experiment").alias("__e"), F.col("forecast").alias("__f"), F.col("prediction_hash").alias("__h"),
        F.col("months").alias("__m"))
    same = (others.filter("status = 'complete'").join(months, ["experiment", "run"])
            .join(F.broadcast(mine), (F.col("forecast") == F.col("__f")) & (F.col("prediction_hash") == F.col("__h"))
                  & (F.col("months") == F.col("__m")) & (F.col("experiment") != F.col("__e"))))
    newest = same.groupBy("experiment").agg(F.max("run").alias("run"))
    chosen = newest.unionByName(current.select("experiment", "run"))
    return ledgers.join(chosen, ["experiment", "run"], "left_semi")


def month_list(panel: DataFrame, mi: str = "mi") -> DataFrame:
    return panel.select(month_label(mi).alias("month")).distinct()
