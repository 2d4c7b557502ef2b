"""The retail tables as views over a star schema (nation, region, part, supplier, lineitem), in both SQL dialects.

Stores are the suppliers' nations and products the pairs of part type and brand. Promotions, snapshots and two runs are
made from keys; the runs' forecasts are seasonal naive, so that both engines make the same ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from ..plans.named import dialect_text

BASE = ("nation", "region", "part", "supplier", "lineitem")
HORIZON = 14
#: Table name -> SQL over the tables before it, in order.
TABLES: dict[str, str] = {
    "stores": """SELECT CAST(n_nationkey + 1 AS BIGINT) AS store_id, 'S' || CAST(n_nationkey AS STRING) AS store_code, n_name AS city, r_name AS region,
  CASE n_nationkey % 3 WHEN 0 THEN 'flagship' WHEN 1 THEN 'standard' ELSE 'express' END AS format, DATE '1990-01-01' AS opened_on
FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "products": """SELECT CAST(row_number() OVER (ORDER BY p_type, p_brand) AS BIGINT) AS product_id, p_type || '/' || p_brand AS sku, p_brand || ' ' || p_type AS name, p_type AS category,
  6e-1 * min(p_retailprice) AS unit_cost, min(p_retailprice) AS unit_price, CAST(1 + min(p_size) % 12 AS BIGINT) AS case_pack, CAST(count(*) % 21 AS BIGINT) AS lead_time_days,
  CASE WHEN count(*) % 3 = 0 THEN NULL ELSE CAST(5 + count(*) % 30 AS BIGINT) END AS shelf_life_days, p_type, p_brand
FROM part GROUP BY p_type, p_brand""",
    "sales_daily": """SELECT CAST(s_nationkey + 1 AS BIGINT) AS store_id, pr.product_id, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units_sold,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DECIMAL(24, 4)) AS revenue, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS stockout_flag
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN products pr ON pr.p_type = part.p_type AND pr.p_brand = part.p_brand GROUP BY 1, 2, 3""",
    "calendar": """SELECT day, {weekday|day} AS day_of_week FROM (SELECT DISTINCT day FROM sales_daily) d""",
    "promotions": """SELECT p.product_id * 10 + j AS promo_id, p.product_id, CASE WHEN p.product_id % 5 < 3 THEN NULL ELSE CAST(1 + p.product_id % 25 AS BIGINT) END AS store_id,
  DATE '1995-01-01' + CAST((p.product_id * 37 + j * 803) % 2500 AS INT) AS start_day, DATE '1995-01-01' + CAST((p.product_id * 37 + j * 803) % 2500 + 3 + p.product_id % 12 AS INT) AS end_day,
  (1 + p.product_id % 3) / 1e1 AS discount_pct
FROM products p CROSS JOIN (SELECT CAST(0 AS BIGINT) AS j UNION ALL SELECT CAST(1 AS BIGINT) UNION ALL SELECT CAST(2 AS BIGINT)) t""",
    "last_day": "SELECT max(day) AS last_day FROM sales_daily",
    "forecast_runs": f"""SELECT CAST(k AS BIGINT) AS run_id, 'succeeded' AS status, '2001-12-0' || CAST(k AS STRING) || 'T00:00:00' AS started_at, '2001-12-0' || CAST(k AS STRING) || 'T00:01:00' AS finished_at,
  {{days_before|last_day|28 * (2 - k)}} AS cutoff_day, CAST({HORIZON} AS BIGINT) AS horizon_days, (SELECT count(*) FROM (SELECT DISTINCT store_id, product_id FROM sales_daily) s) AS series_count, 8e-1 AS interval_level, '' AS notes
FROM last_day CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) t""",
    "series": """SELECT r.run_id, r.cutoff_day, s.store_id, s.product_id, min(s.day) AS first_day FROM sales_daily s JOIN forecast_runs r ON s.day <= r.cutoff_day GROUP BY r.run_id, r.cutoff_day, s.store_id, s.product_id""",
    "inventory_snapshots": """SELECT s.store_id, s.product_id, {days_before|l.last_day|7 * t.k} AS snapshot_day, (s.store_id * 31 + s.product_id * 17 + t.k * 13) % 60 AS on_hand, (s.store_id * 7 + s.product_id * 3) % 20 AS on_order
FROM (SELECT DISTINCT store_id, product_id FROM sales_daily) s CROSS JOIN last_day l CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 4 UNION ALL SELECT 5) t""",
    "steps": "SELECT CAST(a.k + 7 * b.k AS INT) AS h FROM (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) a CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) b",
    "last_week": """SELECT s.run_id, s.store_id, s.product_id, s.cutoff_day, d.h AS h, coalesce(x.units_sold, 0) AS units
FROM series s CROSS JOIN (SELECT h FROM steps WHERE h <= 7) d LEFT JOIN sales_daily x ON x.store_id = s.store_id AND x.product_id = s.product_id AND x.day = {days_after|s.cutoff_day|d.h - 7}""",
    "forecasts": """SELECT w.run_id, w.store_id, w.product_id, {days_after|w.cutoff_day|t.h} AS target_day, 'seasonal_naive' AS model_name, CAST(w.units AS DOUBLE) AS yhat,
  greatest(0e0, w.units - 5e0) AS yhat_lower, w.units + 5e0 AS yhat_upper, t.h AS h
FROM last_week w JOIN steps t ON (t.h - 1) % 7 + 1 = w.h""",
    "folds": """SELECT s.run_id, s.store_id, s.product_id, t.h, coalesce(a.units_sold, 0) AS y, coalesce(b.units_sold, 0) AS naive, coalesce(m.total, 0) AS total
FROM series s CROSS JOIN steps t
LEFT JOIN sales_daily a ON a.store_id = s.store_id AND a.product_id = s.product_id AND a.day = {days_after|s.cutoff_day|t.h - 14}
LEFT JOIN sales_daily b ON b.store_id = s.store_id AND b.product_id = s.product_id AND b.day = {days_after|s.cutoff_day|(t.h - 1) % 7 - 20}
LEFT JOIN (SELECT s.run_id, s.store_id, s.product_id, CAST(sum(x.units_sold) AS BIGINT) AS total FROM series s JOIN sales_daily x ON x.store_id = s.store_id AND x.product_id = s.product_id
  AND x.day > {days_before|s.cutoff_day|42} AND x.day <= {days_before|s.cutoff_day|14} GROUP BY s.run_id, s.store_id, s.product_id) m ON m.run_id = s.run_id AND m.store_id = s.store_id AND m.product_id = s.product_id""",
    "scores": """SELECT run_id, store_id, product_id, 'seasonal_naive' AS model_name, CAST(sum(28 * abs(y - naive)) AS BIGINT) AS err, CAST(sum(28 * (naive - y)) AS BIGINT) AS off, CAST(sum(28 * y) AS BIGINT) AS act FROM folds GROUP BY run_id, store_id, product_id
UNION ALL SELECT run_id, store_id, product_id, 'moving_average', CAST(sum(abs(28 * y - total)) AS BIGINT), CAST(sum(total - 28 * y) AS BIGINT), CAST(sum(28 * y) AS BIGINT) FROM folds GROUP BY run_id, store_id, product_id""",
    "backtest_metrics": """SELECT run_id, store_id, product_id, model_name, CAST(1 AS BIGINT) AS folds, err / 392e0 AS mae, CAST(err AS DOUBLE) / nullif(act, 0) AS wape, off / 392e0 AS bias, CAST(NULL AS DOUBLE) AS mase,
  CASE WHEN row_number() OVER (PARTITION BY run_id, store_id, product_id ORDER BY err, abs(off), model_name) = 1 THEN 1 ELSE 0 END AS selected FROM scores""",
    "needs": """SELECT f.run_id, f.store_id, f.product_id, r.cutoff_day, p.lead_time_days AS lead, p.case_pack AS pack, p.unit_cost,
  sum(CASE WHEN f.h <= p.lead_time_days THEN f.yhat ELSE 0e0 END) AS ltd, sum(CASE WHEN f.h <= p.lead_time_days + 7 THEN f.yhat ELSE 0e0 END) AS mu, sum(f.yhat) AS total
FROM forecasts f JOIN products p ON p.product_id = f.product_id JOIN forecast_runs r ON r.run_id = f.run_id GROUP BY f.run_id, f.store_id, f.product_id, r.cutoff_day, p.lead_time_days, p.case_pack, p.unit_cost""",
    "positions": """SELECT n.*, i.on_hand, i.on_order, i.on_hand + i.on_order AS held, 164e-2 * sqrt(CAST(n.lead + 7 AS DOUBLE)) AS safety FROM needs n
JOIN (SELECT r.run_id, s.store_id, s.product_id, s.on_hand, s.on_order, row_number() OVER (PARTITION BY r.run_id, s.store_id, s.product_id ORDER BY s.snapshot_day DESC) AS rn
  FROM inventory_snapshots s JOIN forecast_runs r ON s.snapshot_day <= r.cutoff_day) i ON i.run_id = n.run_id AND i.store_id = n.store_id AND i.product_id = n.product_id AND i.rn = 1""",
    "replenishment_orders": """SELECT run_id * 1000000000000 + store_id * 1000000 + product_id AS order_id, run_id, store_id, product_id, {days_after|cutoff_day|1} AS order_day, {days_after|cutoff_day|1 + lead} AS expected_arrival, on_hand, on_order,
  ltd AS lead_time_demand, safety AS safety_stock, ltd + safety AS reorder_point, mu + safety AS order_up_to,
  CASE WHEN held < ltd + safety THEN CAST(ceil((mu + safety - held) / pack) AS BIGINT) * pack ELSE CAST(0 AS BIGINT) END AS order_qty,
  CASE WHEN held < ltd + safety THEN CAST(ceil((mu + safety - held) / pack) AS BIGINT) * pack ELSE CAST(0 AS BIGINT) END AS requested_qty,
  CASE WHEN held < ltd + safety THEN 'inventory position below reorder point' ELSE 'inventory position above reorder point' END AS reason,
  CASE WHEN held < mu THEN 1e0 ELSE 0e0 END AS stockout_risk, greatest(0e0, mu - held) * unit_cost AS priority FROM positions""",
    "forecast_evaluations": """SELECT f.run_id, f.store_id, f.product_id, f.model_name, count(*) AS n_days, sum(abs(f.yhat - s.units_sold)) / count(*) AS mae, sum(abs(f.yhat - s.units_sold)) / nullif(CAST(sum(s.units_sold) AS DOUBLE), 0) AS wape,
  sum(f.yhat - s.units_sold) / count(*) AS bias, CAST(sum(CASE WHEN s.units_sold BETWEEN f.yhat_lower AND f.yhat_upper THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS coverage, sum(abs(f.yhat - s.units_sold)) AS abs_error_sum,
  CAST(sum(s.units_sold) AS DOUBLE) AS actual_sum, CAST(sum(s.stockout_flag) AS BIGINT) AS stockout_days, '2001-12-09T00:00:00' AS evaluated_at
FROM forecasts f JOIN sales_daily s ON s.store_id = f.store_id AND s.product_id = f.product_id AND s.day = f.target_day GROUP BY f.run_id, f.store_id, f.product_id, f.model_name""",
}


#: Tables that are written once for a session and star schema, and what their files are divided by.
BUILT: dict[str, tuple[str, ...]] = {
    "stores": (), "products": (), "sales_daily": (), "forecast_runs": (), "series": ("run_id",), "inventory_snapshots": (), "forecasts": ("run_id",), "folds": ("run_id",), "backtest_metrics": ("run_id",), "positions": ("run_id",),
    "replenishment_orders": ("run_id",), "forecast_evaluations": ("run_id",),
}
_roots: dict[tuple[str, str], str] = {}


def needed(sql: str) -> set[str]:
    """The tables that a query needs, with those that they need."""
    need, words = set(), set(re.findall(r"\w+", sql))
    for name in reversed(list(TABLES)):
        if name in words:
            need.add(name)
            words |= set(re.findall(r"\w+", TABLES[name]))
    return need


def with_tables(sql: str, dialect: str, there: Collection[str] = ()) -> str:
    """A query with the tables that it needs, as common table expressions before it; those in `there` are left out."""
    need, words = set(), set(re.findall(r"\w+", sql))
    for name in reversed(list(TABLES)):
        if name in words and name not in there:
            need.add(name)
            words |= set(re.findall(r"\w+", TABLES[name]))
    chain = ",\n".join(f"{n} AS (\n{dialect_text(TABLES[n], dialect)})" for n in TABLES if n in need)
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{chain},\n{body[len(head):]}" if chain else body
    return f"WITH {chain}\n{body}" if chain else body


def views(spark: SparkSession, sf_dir: str) -> None:
    """The base tables as temporary views."""
    for name in BASE:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query in Spark's SQL over the retail tables of a star schema.

    Of the tables that it needs, those in `BUILT` are written once for the session, in an order in which each is made from
    those before it, so that no query expands their chain of joins again; queries read the columns and runs they ask for.
    """
    views(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _roots:
        _roots[key] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/retail-{uuid.uuid4().hex}"
    root, there = _roots[key], set()
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    need = needed(sql)
    for name, by in BUILT.items():
        if name not in need:
            continue
        target = f"{root}/{name}"
        if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")):
            rows = spark.sql(with_tables(f"SELECT * FROM {name}", "spark", there))
            if name == "sales_daily":  # so that a span of days is in few files
                rows = rows.repartitionByRange("day").sortWithinPartitions("day")
            rows.write.mode("overwrite").partitionBy(*by).parquet(target)
        found = spark.read.parquet(target)
        if by:  # partition values come back as the last columns, and as int
            found = found.withColumn("run_id", found["run_id"].cast("long")).select("run_id", *(c for c in found.columns if c != "run_id"))
        found.createOrReplaceTempView(name)
        there.add(name)
    return spark.sql(with_tables(sql, "spark", there))
