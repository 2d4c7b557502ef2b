"""Queries for the operators beside the named ones: each as SQL for both engines, or as a function."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import cells
from ..operators import series
from ..sources import ingest, simulate, warehouse
from . import forecast_run
from .named import dialect_text, rnd

QUERIES: dict[str, str] = {
    "asof_inventory": "SELECT run_id, store_id, product_id, on_hand, on_order, held FROM positions",
    "latest_inventory": "SELECT store_id, product_id, on_hand, on_order FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY snapshot_day DESC) AS rn FROM inventory_snapshots) s WHERE rn = 1",
    "fc_seasonal_naive": "SELECT run_id, store_id, product_id, target_day, yhat FROM forecasts",
    "backtest_folds": "SELECT run_id, store_id, product_id, h, y, naive, total / 28e0 AS moving_average FROM folds",
    "backtest_metrics": "SELECT run_id, store_id, product_id, model_name, mae, wape, bias FROM backtest_metrics",
    "select_model": "SELECT run_id, store_id, product_id, model_name, mae FROM backtest_metrics WHERE selected = 1",
    "backtest_coverage": f"SELECT run_id, {rnd('avg(CASE WHEN abs(y - naive) <= 5 THEN 1e0 ELSE 0e0 END)', 6)} AS coverage FROM folds GROUP BY run_id",
    "policy_reorder": f"SELECT run_id, store_id, product_id, {rnd('lead_time_demand', 6)} AS lead_time_demand, {rnd('safety_stock', 6)} AS safety_stock, {rnd('reorder_point', 6)} AS reorder_point, {rnd('order_up_to', 6)} AS order_up_to, order_qty, reason FROM replenishment_orders",
    "policy_pack_rounding": "SELECT o.run_id, count(*) AS n, CAST(sum(CASE WHEN o.order_qty % p.case_pack = 0 THEN 0 ELSE 1 END) AS BIGINT) AS broken FROM replenishment_orders o JOIN products p ON p.product_id = o.product_id GROUP BY o.run_id",
    "abc_as_of_cutoff": """
WITH sold AS (SELECT r.run_id, s.product_id, CAST(sum(s.revenue) AS DECIMAL(30, 4)) AS revenue FROM sales_daily s JOIN forecast_runs r ON s.day <= r.cutoff_day AND s.day > {days_before|r.cutoff_day|90} GROUP BY r.run_id, s.product_id),
shares AS (SELECT run_id, product_id, CAST(sum(revenue) OVER (PARTITION BY run_id ORDER BY revenue DESC, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / nullif(CAST(sum(revenue) OVER (PARTITION BY run_id) AS DOUBLE), 0) AS share FROM sold)
SELECT run_id, product_id, CASE WHEN share <= 7e-1 THEN 'A' WHEN share <= 9e-1 THEN 'B' ELSE 'C' END AS abc_class FROM shares""",
    "promo_sales_days": "SELECT s.store_id, s.product_id, s.day FROM sales_daily s WHERE EXISTS (SELECT 1 FROM promotions p WHERE p.product_id = s.product_id AND s.day BETWEEN p.start_day AND p.end_day AND (p.store_id IS NULL OR p.store_id = s.store_id))",
    "promo_lift_estimate": f"""
WITH marked AS (
  SELECT s.product_id, s.units_sold, CASE WHEN EXISTS (SELECT 1 FROM promotions p WHERE p.product_id = s.product_id AND s.day BETWEEN p.start_day AND p.end_day AND (p.store_id IS NULL OR p.store_id = s.store_id)) THEN 1 ELSE 0 END AS on_promo FROM sales_daily s),
sums AS (SELECT product_id, CAST(sum(on_promo) AS BIGINT) AS n, count(*) - CAST(sum(on_promo) AS BIGINT) AS m, CAST(sum(on_promo * units_sold) AS DOUBLE) AS a, CAST(sum((1 - on_promo) * units_sold) AS DOUBLE) AS b FROM marked GROUP BY product_id)
SELECT product_id, CASE WHEN n < 7 OR m = 0 OR b <= 0 THEN 1e0 ELSE {rnd("least(greatest(1 + ((a / nullif(n, 0)) / (b / nullif(m, 0)) - 1) * n / (n + 7), 1e0), 5e0)", 9)} END AS lift FROM sums""",
    "calendar_fill": "SELECT day, day_of_week FROM calendar",
    "fc_moving_average_level": "SELECT DISTINCT run_id, store_id, product_id, total / 28e0 AS level FROM folds",
    "residual_std": f"SELECT run_id, {rnd('sqrt((CAST(sum(CAST((y - naive) * (y - naive) AS BIGINT)) AS DOUBLE) - CAST(sum(y - naive) AS DOUBLE) * CAST(sum(y - naive) AS DOUBLE) / count(*)) / (count(*) - 1))', 6)} AS sigma FROM folds GROUP BY run_id",
    "interval_apply": "SELECT run_id, store_id, product_id, target_day, greatest(0e0, yhat - 2e0 * (1 + 1e-2 * (h - 1))) AS lower, yhat + 3e0 * (1 + 1e-2 * (h - 1)) AS upper FROM forecasts",
    "interval_empirical": f"""
WITH errors AS (SELECT run_id, store_id, h, CAST(y - naive AS DOUBLE) AS e FROM folds),
spread AS (
  SELECT run_id, store_id, count(*) AS n, {{quantile|e|0.1}} AS low, {{quantile|e|0.9}} AS high, CAST(sum(CASE WHEN h <= 7 THEN abs(e) ELSE 0e0 END) AS DOUBLE) AS near, CAST(sum(CASE WHEN h > 7 THEN abs(e) ELSE 0e0 END) AS DOUBLE) AS far
  FROM errors GROUP BY run_id, store_id)
SELECT run_id, store_id, {rnd("least(0e0, low)", 6)} AS low, {rnd("greatest(0e0, high)", 6)} AS high,
  CASE WHEN n < 20 OR near = 0 THEN 0e0 ELSE {rnd("least(greatest((far / nullif(near, 0) - 1) / 7, 0e0), 3e-2)", 6)} END AS growth FROM spread""",
    "interval_normal": f"""
WITH spread AS (
  SELECT run_id, store_id, count(*) AS n, CAST(sum((y - naive) * (y - naive)) AS DOUBLE) AS squares, CAST(sum(y - naive) AS DOUBLE) AS total FROM folds GROUP BY run_id, store_id),
widths AS (SELECT run_id, store_id, 12815515655446004e-16 * sqrt(greatest(0e0, squares - total * total / n) / nullif(n - 1, 0)) AS width FROM spread)
SELECT f.run_id, f.store_id, f.product_id, f.target_day, {rnd("greatest(0e0, f.yhat - w.width)", 6)} AS lower, {rnd("f.yhat + w.width", 6)} AS upper
FROM forecasts f JOIN widths w ON w.run_id = f.run_id AND w.store_id = f.store_id""",
    "promo_deflate": f"""
WITH marked AS (
  SELECT s.store_id, s.product_id, s.day, s.units_sold, CASE WHEN EXISTS (SELECT 1 FROM promotions p WHERE p.product_id = s.product_id AND s.day BETWEEN p.start_day AND p.end_day AND (p.store_id IS NULL OR p.store_id = s.store_id)) THEN 1 ELSE 0 END AS on_promo FROM sales_daily s),
sums AS (SELECT product_id, CAST(sum(on_promo) AS BIGINT) AS n, count(*) - CAST(sum(on_promo) AS BIGINT) AS m, CAST(sum(on_promo * units_sold) AS DOUBLE) AS a, CAST(sum((1 - on_promo) * units_sold) AS DOUBLE) AS b FROM marked GROUP BY product_id),
lifts AS (SELECT product_id, CASE WHEN n < 7 OR m = 0 OR b <= 0 THEN 1e0 ELSE least(greatest(1 + ((a / nullif(n, 0)) / (b / nullif(m, 0)) - 1) * n / (n + 7), 1e0), 5e0) END AS lift FROM sums)
SELECT k.store_id, k.product_id, k.day, k.on_promo, {rnd("CASE WHEN k.on_promo = 1 THEN k.units_sold / l.lift ELSE CAST(k.units_sold AS DOUBLE) END", 6)} AS base_units
FROM marked k JOIN lifts l ON l.product_id = k.product_id""",
    "policy_shelf_life": """
WITH sells AS (
  SELECT f.run_id, f.store_id, f.product_id, sum(CASE WHEN f.h <= p.shelf_life_days THEN f.yhat ELSE 0e0 END) AS units FROM forecasts f JOIN products p ON p.product_id = f.product_id
  WHERE p.shelf_life_days IS NOT NULL GROUP BY f.run_id, f.store_id, f.product_id),
capped AS (
  SELECT o.run_id, o.store_id, o.product_id, o.requested_qty, o.reason, p.shelf_life_days,
    CASE WHEN s.units IS NULL THEN o.requested_qty ELSE least(o.requested_qty, CAST(ceil(greatest(0e0, floor(s.units + 1e-9) - (o.on_hand + o.on_order)) / p.case_pack) AS BIGINT) * p.case_pack) END AS order_qty
  FROM replenishment_orders o JOIN products p ON p.product_id = o.product_id LEFT JOIN sells s ON s.run_id = o.run_id AND s.store_id = o.store_id AND s.product_id = o.product_id)
SELECT run_id, store_id, product_id, shelf_life_days, requested_qty, order_qty, CASE WHEN order_qty < requested_qty THEN reason || '; capped by shelf life' ELSE reason END AS reason FROM capped""",
    "runs_compared": """
WITH placed AS (SELECT run_id, CAST(sum(CASE WHEN order_qty > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_orders, CAST(sum(order_qty) AS BIGINT) AS units FROM replenishment_orders GROUP BY run_id)
SELECT r.run_id, p.n_orders, p.units, p.n_orders - lag(p.n_orders) OVER (ORDER BY r.run_id) AS orders_delta FROM forecast_runs r JOIN placed p ON p.run_id = r.run_id WHERE r.status = 'succeeded'""",
    "error_by_step": f"SELECT run_id, h, count(*) AS n, {rnd('avg(abs(y - naive))', 6)} AS mae, {rnd('avg(naive - y)', 6)} AS bias, {rnd('CAST(sum(abs(y - naive)) AS DOUBLE) / nullif(CAST(sum(abs(y)) AS DOUBLE), 0)', 6)} AS wape FROM folds GROUP BY run_id, h",
    "intermittent_series": "SELECT run_id, store_id, product_id, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_days, count(*) AS n_days, CASE WHEN 2 * sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) >= count(*) THEN 1 ELSE 0 END AS intermittent FROM folds GROUP BY run_id, store_id, product_id",
    "upsert_merge": """
WITH incoming AS (SELECT store_id, product_id, snapshot_day, on_hand + 1 AS on_hand, on_order FROM inventory_snapshots WHERE store_id % 2 = 0),
kept AS (SELECT o.* FROM inventory_snapshots o LEFT JOIN incoming i ON i.store_id = o.store_id AND i.product_id = o.product_id AND i.snapshot_day = o.snapshot_day WHERE i.store_id IS NULL)
SELECT store_id, product_id, snapshot_day, on_hand, on_order FROM kept UNION ALL SELECT store_id, product_id, snapshot_day, on_hand, on_order FROM incoming""",
    "ingest_dedup_first_wins": """
WITH file AS (SELECT * FROM (VALUES (2, 1, 'OSL'), (3, 2, 'BGO'), (4, 2, 'BG2'), (5, 3, 'TRD'), (6, 1, 'OS2')) AS v(row_no, store_id, store_code)),
numbered AS (SELECT *, min(row_no) OVER (PARTITION BY store_id) AS first_row FROM file)
SELECT row_no, store_id, store_code, first_row, CASE WHEN row_no > first_row THEN 1 ELSE 0 END AS rejected FROM numbered""",
    "integrity_check": """
SELECT 'units' AS rule, count(*) AS n FROM sales_daily WHERE NOT (units_sold >= 0) UNION ALL SELECT 'revenue', count(*) FROM sales_daily WHERE NOT (revenue >= 0)
UNION ALL SELECT 'store', count(*) FROM sales_daily s LEFT JOIN stores t ON t.store_id = s.store_id WHERE t.store_id IS NULL
UNION ALL SELECT 'promotion', count(*) FROM promotions WHERE NOT (end_day >= start_day AND discount_pct > 0 AND discount_pct < 1)""",
    "table_counts": "SELECT 'stores' AS table_name, count(*) AS n FROM stores UNION ALL SELECT 'products', count(*) FROM products UNION ALL SELECT 'sales_daily', count(*) FROM sales_daily UNION ALL SELECT 'promotions', count(*) FROM promotions",
    "fk_antijoin": "SELECT s.product_id, count(*) AS n FROM sales_daily s LEFT JOIN products p ON p.product_id = s.product_id WHERE p.product_id IS NULL GROUP BY s.product_id",
    "region_category_rollup": f"SELECT st.region, p.category, CAST(sum(s.units_sold) AS BIGINT) AS units, {rnd('sum(s.revenue)', 2)} AS revenue FROM sales_daily s JOIN stores st ON st.store_id = s.store_id JOIN products p ON p.product_id = s.product_id GROUP BY GROUPING SETS ((), (st.region), (p.category))",
}


def text(name: str, dialect: str) -> str:
    return dialect_text(QUERIES[name].strip(), dialect)


def retail_tables(spark: SparkSession, sf_dir: str, coarse: bool = False) -> dict[str, DataFrame]:
    """The retail tables of a star schema; coarse: regions as stores and categories as products, so that series are dense."""
    get = lambda name: warehouse.run(spark, sf_dir, f"SELECT * FROM {name}")
    tables = {n: get(n) for n in ("stores", "products", "sales_daily", "promotions", "inventory_snapshots")}
    if not coarse:
        return tables
    by_store = tables["stores"].select("store_id", F.dense_rank().over(_all("region")).cast("long").alias("s"))
    by_product = tables["products"].select("product_id", F.dense_rank().over(_all("category")).cast("long").alias("p"))
    moved = lambda df: df.join(F.broadcast(by_store), "store_id").join(F.broadcast(by_product), "product_id")
    key = [F.col("s").alias("store_id"), F.col("p").alias("product_id")]
    sales = moved(tables["sales_daily"]).groupBy(*key, "day").agg(F.sum("units_sold").alias("units_sold"), F.sum("revenue").alias("revenue"), F.max("stockout_flag").alias("stockout_flag"))
    stock = moved(tables["inventory_snapshots"]).groupBy(*key, "snapshot_day").agg(F.sum("on_hand").alias("on_hand"), F.sum("on_order").alias("on_order"))
    # a null store is all stores; any other becomes its coarse store
    placed = tables["promotions"].join(F.broadcast(by_product), "product_id").join(F.broadcast(by_store), "store_id", "left").filter("store_id IS NULL OR s IS NOT NULL")
    promos = placed.select("promo_id", F.col("p").alias("product_id"), F.col("s").alias("store_id"), "start_day", "end_day", "discount_pct")
    products = tables["products"].join(F.broadcast(by_product), "product_id").groupBy(F.col("p").alias("product_id")).agg(F.min("unit_cost").alias("unit_cost"), F.min("case_pack").alias("case_pack"), F.max("lead_time_days").alias("lead_time_days"), F.max("shelf_life_days").alias("shelf_life_days"))
    return {"stores": by_store.select(F.col("s").alias("store_id")).distinct(), "products": products, "sales_daily": sales, "promotions": promos, "inventory_snapshots": stock}


def _all(column: str):
    return Window.orderBy(column)  # over one row a store or product


def densify_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = retail_tables(spark, sf_dir, coarse=True)
    return series.densify(tables["sales_daily"], series.resolve_cutoff(tables["sales_daily"], None))


def promo_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every store, product and day of a promotion, once."""
    tables = retail_tables(spark, sf_dir)
    return series.promo_days(tables["promotions"], tables["stores"])


def evaluate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations of both runs by the operator that evaluates a store's runs."""
    tables = retail_tables(spark, sf_dir)
    forecasts = warehouse.run(spark, sf_dir, "SELECT * FROM forecasts")
    columns = "run_id store_id product_id model_name n_days mae wape bias coverage abs_error_sum actual_sum stockout_days".split()
    return forecast_run.evaluate(forecasts, tables["sales_daily"]).select(*columns)


def inventory_at_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of operator at the backdated run's cutoff."""
    tables = retail_tables(spark, sf_dir)
    cutoff = series.resolve_cutoff(tables["sales_daily"], None) - dt.timedelta(28)
    return series.inventory_as_of(tables["inventory_snapshots"], cutoff)


def abc_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class operator at the last day."""
    tables = retail_tables(spark, sf_dir)
    return series.abc_as_of(tables["sales_daily"], series.resolve_cutoff(tables["sales_daily"], None))


def ingest_reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the load of sales refuses, with reasons: sales as text cells, some of them spoilt by rule, some sent twice."""
    tables = retail_tables(spark, sf_dir)
    key = F.col("product_id")
    spoilt = lambda n, cell, fine: F.when(key % n == 0, F.lit(cell)).otherwise(fine.cast("string"))
    row = (F.col("store_id") * 100_000 + key) * 10_000 + F.datediff("day", F.lit(dt.date(1990, 1, 1)))
    sales = tables["sales_daily"].withColumn("row", row)
    sent = sales.unionByName(sales.filter(key % 50 == 0).withColumn("row", F.col("row") + 5_000))
    store = F.when(key % 43 == 0, F.lit("x1")).otherwise(spoilt(41, "99", F.col("store_id")))
    cells_ = sent.select("row", store.alias("store_id"), key.cast("string").alias("product_id"), spoilt(29, "01/02/1995", F.col("day")).alias("day"), spoilt(37, "-1", F.col("units_sold")).alias("units_sold"), F.lit(None).cast("string").alias("revenue"), spoilt(31, "2", F.col("stockout_flag")).alias("stockout_flag"))
    return ingest.validated(cells_, "sales_daily", tables).filter("reason IS NOT NULL").select("row", "product_id", "reason")


def calendar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load fills in for a day of the calendar."""
    days = retail_tables(spark, sf_dir)["sales_daily"].select("day").distinct()
    return days.select("day", *(c.cast("long").alias(n) for n, c in ingest.calendar_fields(F.col("day")).items()))


def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a whole run over the coarse series."""
    return forecast_run.frames(retail_tables(spark, sf_dir, coarse=True), forecast_run.RunConfig()).orders


def full_run_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_run.frames(retail_tables(spark, sf_dir, coarse=True), forecast_run.RunConfig()).forecasts


def full_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_run.frames(retail_tables(spark, sf_dir, coarse=True), forecast_run.RunConfig()).metrics


def budget_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_run.frames(retail_tables(spark, sf_dir, coarse=True), forecast_run.RunConfig(order_budget=50_000.0)).orders


def _forecast(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Forecasts of one model for all coarse series that are candidates for it."""
    tables = retail_tables(spark, sf_dir, coarse=True)
    return forecast_run.frames(tables, forecast_run.RunConfig(models=(name, "seasonal_naive"))).forecasts.filter(F.col("model_name") == name)


def simulate_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of a small generated dataset; needs no input tables."""
    config = simulate.SimConfig(3, 8, dt.date(2024, 1, 1), 120, 7)
    return simulate.draw(spark, config).select("store_id", "product_id", "day", "units_sold", "stockout_flag")


def cell_policy_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names and hostile cells under the safe policy."""
    rows = spark.sql("SELECT * FROM VALUES ('=1+1'), ('-2+3'), (' @x'), ('1-2'), ('a=b'), ('OSL'), ('') AS v(cell)")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("cell"))
    return rows.unionByName(parts).select("cell", cells.safe(F.col("cell")).alias("safe_cell"))


CELL_SQL = r"""
SELECT cell, CASE WHEN regexp_matches(cell, '^[\t\r\n]|^[\p{Cc}\p{Cf}\p{Z}]*[=+\-@]') THEN chr(39) || cell ELSE cell END AS safe_cell
FROM (SELECT * FROM (VALUES ('=1+1'), ('-2+3'), (' @x'), ('1-2'), ('a=b'), ('OSL'), ('')) v(cell) UNION ALL SELECT p_name FROM part) t"""


#: SQL twins of queries that go through DataFrame operators; DuckDB only.
FUNCTION_SQL: dict[str, str] = {
    "densify_series": """
WITH by_store AS (SELECT store_id, dense_rank() OVER (ORDER BY region) AS s FROM stores), by_product AS (SELECT product_id, dense_rank() OVER (ORDER BY category) AS p FROM products),
coarse AS (
  SELECT b.s AS store_id, c.p AS product_id, d.day, CAST(sum(d.units_sold) AS BIGINT) AS units FROM sales_daily d JOIN by_store b ON b.store_id = d.store_id JOIN by_product c ON c.product_id = d.product_id
  GROUP BY 1, 2, 3),
axis AS (SELECT store_id, product_id, CAST(unnest(generate_series(min(day), (SELECT max(day) FROM sales_daily), INTERVAL 1 DAY)) AS DATE) AS day FROM coarse GROUP BY store_id, product_id)
SELECT a.store_id, a.product_id, a.day, coalesce(c.units, 0) AS units FROM axis a LEFT JOIN coarse c ON c.store_id = a.store_id AND c.product_id = a.product_id AND c.day = a.day""",
    "promo_flags": """
WITH whole AS (SELECT s.store_id, p.product_id, p.start_day, p.end_day FROM promotions p JOIN stores s ON p.store_id IS NULL OR p.store_id = s.store_id)
SELECT DISTINCT store_id, product_id, CAST(unnest(generate_series(start_day, end_day, INTERVAL 1 DAY)) AS DATE) AS day FROM whole""",
    "ingest_reject_report": """
WITH numbered AS (SELECT (store_id * 100000 + product_id) * 10000 + (day - DATE '1990-01-01') AS row_no, store_id, product_id, day FROM sales_daily),
sent AS (SELECT *, row_no AS first_row FROM numbered UNION ALL SELECT row_no + 5000, store_id, product_id, day, row_no FROM numbered WHERE product_id % 50 = 0),
checked AS (
  SELECT CAST(row_no AS BIGINT) AS "row", product_id, CASE WHEN product_id % 43 = 0 THEN 'store_id must be an integer (got ''x1'')' WHEN product_id % 41 = 0 THEN 'unknown store_id 99'
    WHEN product_id % 29 = 0 THEN 'day must be an ISO date YYYY-MM-DD (got ''01/02/1995'')' WHEN product_id % 37 = 0 THEN 'units_sold must be >= 0 (got -1)' WHEN product_id % 31 = 0 THEN 'stockout_flag must be 0 or 1 (got ''2'')'
    WHEN row_no > first_row THEN 'duplicate key (store_id=' || store_id || ', product_id=' || product_id || ', day=' || day || ') first seen at row ' || first_row END AS reason FROM sent)
SELECT "row", product_id, reason FROM checked WHERE reason IS NOT NULL""",
    "calendar_fields": """
SELECT day, CAST(isodow(day) - 1 AS BIGINT) AS day_of_week, CAST(weekofyear(day) AS BIGINT) AS week_of_year, CAST(month(day) AS BIGINT) AS month, CAST(year(day) AS BIGINT) AS year, CAST(isodow(day) >= 6 AS BIGINT) AS is_weekend
FROM (SELECT DISTINCT day FROM sales_daily) d""",
    "evaluate_run": "SELECT run_id, store_id, product_id, model_name, n_days, mae, wape, bias, coverage, abs_error_sum, actual_sum, stockout_days FROM forecast_evaluations",
    "inventory_at_cutoff": """
SELECT store_id, product_id, on_hand, on_order FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY snapshot_day DESC) AS rn FROM inventory_snapshots
  WHERE snapshot_day <= (SELECT max(day) - 28 FROM sales_daily)) s WHERE rn = 1""",
    "abc_classes": """
WITH sold AS (SELECT product_id, sum(revenue) AS revenue FROM sales_daily WHERE day > (SELECT max(day) - 90 FROM sales_daily) GROUP BY product_id),
shares AS (SELECT product_id, CAST(sum(revenue) OVER (ORDER BY revenue DESC, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / nullif(CAST(sum(revenue) OVER () AS DOUBLE), 0) AS share FROM sold)
SELECT product_id, CASE WHEN share <= 7e-1 THEN 'A' WHEN share <= 9e-1 THEN 'B' ELSE 'C' END AS abc_class FROM shares""",
    "cell_policy_safe": CELL_SQL,
}


def functions() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"densify_series": densify_series, "promo_flags": promo_flags, "ingest_reject_report": ingest_reject_report, "calendar_fields": calendar_fields, "evaluate_run": evaluate_run, "inventory_at_cutoff": inventory_at_cutoff, "abc_classes": abc_classes, "full_run": full_run, "full_run_forecasts": full_run_forecasts, "full_run_metrics": full_run_metrics, "budget_allocation": budget_allocation, "simulate_sales": simulate_sales, "cell_policy_safe": cell_policy_safe} | {
        f"fc_{m}": partial(_forecast, name=m) for m in ("moving_average", "theta", "croston_sba", "holt_winters", "promo_theta")
    }
