"""Sources and sinks."""

import uuid

from pyspark.sql import functions as F

from checks.registry import near, query
from checks.views import FORECASTS, PANEL, label, r6, with_
from crossweave.functions.columns import month_label
from crossweave.session import stage_root
from crossweave.sources import demo_tables as D
from crossweave.sources import io


def scratch(spark, tag):
    return f"{stage_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


@query("a01_load_panel", """
SELECT strftime(l_shipdate, '%Y-%m') AS observed_month, strftime(l_shipdate + INTERVAL 1 MONTH, '%Y-%m') AS target_month,
  count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2""")
def load_panel(spark, sf):
    rows = io.load_panel(spark, f"{sf}/lineitem.parquet", ["l_suppkey", "l_quantity"], "l_shipdate")
    return rows.groupBy("observed_month", "target_month").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


@query("a02_load_series", f"""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS dt, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS level FROM orders GROUP BY 1)
SELECT strftime(dt, '%Y-%m') AS month, count(*) AS days, count(*) FILTER (day(dt) = 15) AS missing,
  {r6('min(CASE WHEN day(dt) <> 15 THEN level END)')} AS lowest, {r6('max(CASE WHEN day(dt) <> 15 THEN level END)')} AS highest FROM d GROUP BY 1""")
def load_series(spark, sf):
    path = scratch(spark, "levels-csv")
    text = F.when(F.dayofmonth("observation_date") == 15, F.lit(".")).otherwise(F.col("level").cast("string"))
    io.write_table(D.levels(spark, sf).select("observation_date", text.alias("LEVEL")), path)
    back = io.load_series(spark, path, "LEVEL")
    return back.groupBy(F.date_format("observation_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.col("LEVEL").isNull().cast("long")).alias("missing"),
        near(F.min("LEVEL")).alias("lowest"), near(F.max("LEVEL")).alias("highest"))


@query("a03_load_forecasts", with_(PANEL, FORECASTS) + f"""
SELECT permno, {label('target_mi')} AS target_month, {r6('alt_forecast')} AS forecast FROM forecasts""")
def load_forecasts(spark, sf):
    path = scratch(spark, "forecasts")
    D.forecasts(spark, sf).withColumn("target_month", month_label("target_mi")).write.parquet(path)
    return io.load_forecasts(spark, path, "alt_forecast").withColumn("forecast", near("forecast"))


@query("a04_write_holdings", with_(PANEL) + """
SELECT iid AS trial, month, count(*) AS names, CAST(sum(CAST(me AS DECIMAL(18,2))) AS DOUBLE) AS weight FROM panel GROUP BY 1, 2""")
def write_holdings(spark, sf):
    path = scratch(spark, "holdings")
    held = D.panel(spark, sf).select(F.col("iid").alias("trial"), "month", "permno", F.col("me").alias("weight"))
    io.write_holdings(held, path)
    io.write_holdings(held.filter("trial = 'O'"), path)  # replaces one partition, keeps the others
    return (spark.read.parquet(path).groupBy("trial", "month")
            .agg(F.count(F.lit(1)).alias("names"), F.sum(F.col("weight").cast("decimal(18,2)")).cast("double").alias("weight")))


CHECKPOINT_SQL = """
WITH ck AS (SELECT DISTINCT 'trial_' || (o_custkey // 50) AS trial, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
months AS (SELECT DISTINCT month FROM ck), trials AS (SELECT DISTINCT trial FROM ck),
done AS (SELECT trial FROM ck GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM months)),
failed AS (SELECT trial FROM trials WHERE trial LIKE '%3'),
pending AS (SELECT trial FROM trials WHERE trial NOT IN (SELECT trial FROM done) AND trial NOT IN (SELECT trial FROM failed))
"""


def checkpoint_tables(spark, sf):
    ck = (D.table(spark, sf, "orders").select(
        F.concat(F.lit("trial_"), F.floor(F.col("o_custkey") / 50).cast("string")).alias("trial"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct())
    trials = ck.select("trial").distinct()
    pending = io.pending_trials(trials, ck, ck.select("month").distinct(), trials.filter("trial LIKE '%3'"))
    return ck, pending


@query("a05_pending_trials", CHECKPOINT_SQL + "SELECT trial FROM pending")
def pending_trials(spark, sf):
    return checkpoint_tables(spark, sf)[1]


@query("a05_usable_checkpoint", CHECKPOINT_SQL + """
SELECT trial, count(*) AS months FROM ck WHERE trial NOT IN (SELECT trial FROM pending) GROUP BY 1""")
def usable_checkpoint(spark, sf):
    ck, pending = checkpoint_tables(spark, sf)
    return io.usable_checkpoint(ck, pending).groupBy("trial").agg(F.count(F.lit(1)).alias("months"))


RUNS_SQL = """
WITH o AS (SELECT *, o_custkey % 11 AS e, o_custkey // 50 AS r FROM orders),
runs AS (SELECT 'exp_' || e AS experiment, r AS run, 'f' || (r % 2) AS forecast, 'h' || (e % 3) AS prediction_hash,
    min(strftime(o_orderdate, '%Y')) AS start, max(strftime(o_orderdate, '%Y')) AS "end",
    CASE WHEN count(*) % 4 = 0 THEN 'failed' ELSE 'complete' END AS status, count(*) AS orders FROM o GROUP BY e, r),
led AS (SELECT DISTINCT 'exp_' || e AS experiment, r AS run, strftime(o_orderdate, '%Y') AS month FROM o)
"""


def run_tables(spark, sf):
    o = D.table(spark, sf, "orders").select(
        F.concat(F.lit("exp_"), (F.col("o_custkey") % 11).cast("string")).alias("experiment"),
        F.floor(F.col("o_custkey") / 50).alias("run"), F.date_format("o_orderdate", "yyyy").alias("month"),
        (F.col("o_custkey") % 11 % 3).alias("h"))
    runs = o.groupBy("experiment", "run", "h").agg(
        F.min("month").alias("start"), F.max("month").alias("end"), F.count(F.lit(1)).alias("orders"))
    runs = runs.select("experiment", "run", F.concat(F.lit("f"), (F.col("run") % 2).cast("string")).alias("forecast"),
                       F.concat(F.lit("h"), F.col("h").cast("string")).alias("prediction_hash"), "start", "end",
                       F.when(F.col("orders") % 4 == 0, "failed").otherwise("complete").alias("status"), "orders")
    return runs, o.select("experiment", "run", "month").distinct()


@query("a06_latest_runs", RUNS_SQL + """
SELECT * FROM runs WHERE status = 'complete'
QUALIFY row_number() OVER (PARTITION BY experiment, forecast, prediction_hash, start, "end" ORDER BY run DESC) = 1""")
def latest_runs(spark, sf):
    return io.latest_runs(run_tables(spark, sf)[0])


@query("a07_matching_runs", RUNS_SQL + """
, ml AS (SELECT experiment, run, list(month ORDER BY month) AS months FROM led GROUP BY 1, 2),
cur AS (SELECT runs.*, months FROM runs JOIN ml USING (experiment, run) WHERE experiment = 'exp_0' AND run = 0),
hit AS (SELECT runs.experiment, max(runs.run) AS run FROM runs JOIN ml USING (experiment, run) JOIN cur
  ON runs.forecast = cur.forecast AND runs.prediction_hash = cur.prediction_hash AND ml.months = cur.months AND runs.experiment <> cur.experiment
  WHERE runs.status = 'complete' GROUP BY 1 UNION ALL SELECT experiment, run FROM cur)
SELECT led.* FROM led JOIN hit USING (experiment, run)""")
def matching_runs(spark, sf):
    runs, ledgers = run_tables(spark, sf)
    current = runs.filter("experiment = 'exp_0' AND run = 0").select("experiment", "run", "forecast", "prediction_hash")
    return io.matching_runs(current, runs, ledgers)


#: Run folders that the queries write: experiment, run number, whether it is complete, whether its summary is of the older form.
RUN_FOLDERS = ((0, 2, True, False), (0, 10, True, False), (0, 11, False, False), (1, 3, True, True), (1, 1, True, False), (2, 7, True, False))
FOLDER_SQL = f"""
WITH f AS (SELECT * FROM (VALUES {', '.join(map(str, RUN_FOLDERS))}) f(e, r, complete, older)),
led AS (SELECT e, r, complete, older, strftime(o_orderdate, '%Y') AS target_month, count(*) AS orders,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM orders JOIN f ON o_custkey % 3 = e AND o_custkey % 7 <> r % 7 GROUP BY ALL)
"""


def written_runs(spark, sf):
    """Folders <root>/<experiment>/outputs/run_<n> as separate jobs leave them, made of the orders."""
    root = scratch(spark, "runs")
    orders = D.table(spark, sf, "orders")
    for e, r, complete, older in RUN_FOLDERS:
        folder = f"{root}/exp {e}/outputs/run_{r}"
        led = orders.where((F.col("o_custkey") % 3 == e) & (F.col("o_custkey") % 7 != r % 7)).groupBy(F.date_format("o_orderdate", "yyyy").alias("target_month")).agg(
            F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
        led = led.coalesce(1).cache()
        io.write_table(led if not older else led.select("total", "target_month"), f"{folder}/monthly_returns.csv")
        turnover = [] if older else [F.max("orders").alias("mean_one_way_turnover")]
        io.write_table(led.agg(F.sum("orders").alias("orders"), *turnover).coalesce(1), f"{folder}/summary.csv")
        meta = led.agg(F.collect_list("target_month").alias("months")).select(F.to_json(F.struct(
            F.lit("complete" if complete else "running").alias("status"), F.lit(f"exp {e}").alias("experiment"), F.lit("f").alias("forecast"),
            F.lit("abc").alias("prediction_sha256"), "months")).alias("value"))
        meta.coalesce(1).write.text(f"{folder}/run.json")
        led.unpersist()
    return root


@query("a06_run_folders", FOLDER_SQL + """
, s AS (SELECT e, r, complete, older, sum(orders) AS orders, max(orders) AS turnover, min(target_month) AS start, max(target_month) AS "end" FROM led GROUP BY ALL)
SELECT 'exp ' || e AS experiment, 'run_' || r AS run, CAST(r AS BIGINT) AS run_number, 'f' AS forecast, start, "end", CAST(orders AS BIGINT) AS orders, CAST(turnover AS DOUBLE) AS mean_one_way_turnover
FROM s WHERE complete AND NOT older QUALIFY row_number() OVER (PARTITION BY e, start, "end" ORDER BY r DESC) = 1""")
def run_folders(spark, sf):
    """The comparison table of written folders: an incomplete run and one of the older form do not count; 10 comes after 2."""
    made = io.run_comparison(spark, written_runs(spark, sf), "orders long, mean_one_way_turnover double")
    return made.drop("status", "prediction_hash")


@query("a07_run_ledgers", FOLDER_SQL + f"""
SELECT 'exp ' || e AS experiment, 'run_' || r AS run, complete, target_month, CASE WHEN NOT older THEN orders END AS orders, {r6('total')} AS total FROM led""")
def run_ledgers(spark, sf):
    """Monthly rows of all folders by column name; the older form lacks a column and has the others in another order."""
    root = written_runs(spark, sf)
    rows = io.run_tables(spark, root, "monthly_returns.csv", "target_month string, orders long, total double")
    return rows.join(io.run_folders(spark, root), ["experiment", "run"]).select(
        "experiment", "run", (F.col("status") == "complete").alias("complete"), "target_month", "orders", near("total").alias("total"))
