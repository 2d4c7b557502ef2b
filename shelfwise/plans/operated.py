"""Queries whose rows come out of the engine's own operators (kernels, backtest, policy, store), and their SQL twins.

The twins are written from the definitions, not from the operators: recursions are folds over lists in DuckDB's SQL.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import backtest, models, replenish, series
from ..sources import warehouse
from ..sources.store import TableStore
from . import extra, forecast_run
from .named import dialect_text, rnd

HORIZON, FOLDS, LEVEL = 28, 4, 0.8
SERVICE, REVIEW, LEAST_ORDER, MOST_ORDER = 0.95, 7, 4, 60
BUDGET = 50_000.0


def half_up(x: float | None, digits: int) -> float | None:
    """Half away from zero, as in the queries' SQL."""
    return None if x is None else math.copysign(math.floor(abs(x) * 10**digits + 0.5) / 10**digits, x) if x else 0.0


def _per_series(rows: DataFrame, end: dt.date, work: Callable, schema: str, reach: int = HORIZON) -> DataFrame:
    """Applies `work(row, history, flags, future flags)` to each packed series of a batch; it yields result rows."""
    names = [part.split()[0] for part in schema.split(", ")]
    arrow = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}[part.split()[1]]) for n, part in zip(names, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            past, flags, future = forecast_run.histories(batch, end, reach)
            keep = [c for c in batch.schema.names if c not in ("sold", "promos")]
            keys = batch.select(keep).to_pylist()
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in work(keys, past, flags, future)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _coarse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dt.date]:
    tables = extra.retail_tables(spark, sf_dir, coarse=True)
    cutoff = series.resolve_cutoff(tables["sales_daily"])
    return series.packed(tables["sales_daily"], tables["promotions"], cutoff), cutoff


def _dated(found: DataFrame, cutoff: dt.date) -> DataFrame:
    return found.select("store_id", "product_id", F.date_add(F.lit(cutoff), F.col("h")).alias("target_day"), "yhat")


def model_forecast(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model's forecasts for every coarse series, by its kernel."""
    rows, cutoff = _coarse(spark, sf_dir)

    def work(keys, past, flags, future):
        for k, f in zip(keys, models.forecast(name, past, HORIZON, flags, future)):
            yield from ((k["store_id"], k["product_id"], h + 1, half_up(float(x), 4)) for h, x in enumerate(f))

    return _dated(_per_series(rows, cutoff, work, "store_id long, product_id long, h int, yhat double"), cutoff)


def naive_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal naive forecasts of both runs over all fine series."""
    tables = extra.retail_tables(spark, sf_dir)
    last, out = series.resolve_cutoff(tables["sales_daily"]), None

    def work(keys, past, flags, future):
        for k, f in zip(keys, models.seasonal_naive(past, warehouse.HORIZON)):
            yield from ((k["store_id"], k["product_id"], h + 1, float(x)) for h, x in enumerate(f))

    for run_id, cutoff in ((1, last - dt.timedelta(28)), (2, last)):
        found = _per_series(series.packed(tables["sales_daily"], tables["promotions"], cutoff), cutoff, work, "store_id long, product_id long, h int, yhat double")
        own = _dated(found, cutoff).select(F.lit(run_id).cast("long").alias("run_id"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def backtest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, intervals and the winner of two models for every coarse series, by the rolling-origin backtest."""
    rows, cutoff = _coarse(spark, sf_dir)
    names = ["seasonal_naive", "moving_average"]

    def work(keys, past, flags, future):
        for k, own in zip(keys, backtest.backtest(past, flags, [names] * len(past), HORIZON, FOLDS, LEVEL)):
            won = backtest.select(own) if own else None
            for s in own:
                numbers = (s.mae, s.wape, s.bias, s.mase, s.sigma, s.interval.low, s.interval.high, s.interval.growth, s.coverage)
                yield (k["store_id"], k["product_id"], s.model, s.folds, *(half_up(x, 6) for x in numbers), int(s is won))

    schema = "store_id long, product_id long, model_name string, folds long, mae double, wape double, bias double, mase double, sigma double, low double, high double, growth double, coverage double, selected int"
    return _per_series(rows, cutoff, work, schema)


def lift_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion signal, lift and intermittency of every fine series, by the models' helpers."""
    tables = extra.retail_tables(spark, sf_dir)
    cutoff = series.resolve_cutoff(tables["sales_daily"])

    def work(keys, past, flags, future):
        for k, y, f in zip(keys, past, flags):
            yield k["store_id"], k["product_id"], len(y), int(f.sum()) if f is not None else 0, int(models.has_promo_signal(f)), half_up(models.estimate_lift(y, f), 6) if f is not None else 1.0, int(models.is_intermittent(y))

    return _per_series(series.packed(tables["sales_daily"], tables["promotions"], cutoff), cutoff, work, "store_id long, product_id long, n_days long, promo_days long, signal int, lift double, intermittent int")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reorder policy's decision for every fine series, from a seasonal naive forecast and the last four weeks' spread."""
    tables = extra.retail_tables(spark, sf_dir)
    cutoff = series.resolve_cutoff(tables["sales_daily"])
    products = tables["products"].select("product_id", "lead_time_days", "case_pack", F.col("unit_cost").cast("double").alias("unit_cost"), "shelf_life_days")
    rows = series.packed(tables["sales_daily"], tables["promotions"], cutoff).join(products, "product_id").join(series.inventory_as_of(tables["inventory_snapshots"], cutoff), series.KEY)

    def work(keys, past, flags, future):
        for k, y in zip(keys, past):
            reach = max(k["lead_time_days"] + REVIEW, k["shelf_life_days"] or 0)
            forecast, recent = models.seasonal_naive([y], reach)[0], y[-28:]
            sigma = float(np.std(recent, ddof=1)) if len(recent) > 1 else 0.0
            d = replenish.decide(replenish.Need(forecast, sigma, k["on_hand"], k["on_order"], k["lead_time_days"], REVIEW, SERVICE, k["case_pack"], k["unit_cost"], k["shelf_life_days"], LEAST_ORDER, MOST_ORDER))
            yield k["store_id"], k["product_id"], *(half_up(x, 4) for x in (d.lead_time_demand, d.safety_stock, d.reorder_point, d.order_up_to)), d.order_qty, d.reason, *(half_up(x, 4) for x in (d.stockout_risk, d.priority)), k["unit_cost"]

    schema = "store_id long, product_id long, lead_time_demand double, safety_stock double, reorder_point double, order_up_to double, order_qty long, reason string, stockout_risk double, priority double, unit_cost double"
    return _per_series(rows, cutoff, work, schema)


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions' order book under a budget, by the operator that settles a run's orders."""
    lines = decisions(spark, sf_dir).filter("order_qty > 0").select("store_id", "product_id", "order_qty", "unit_cost", "priority")
    asked = [((r["store_id"], r["product_id"]), r["order_qty"], r["unit_cost"], r["priority"]) for r in lines.toLocalIterator()]
    got = replenish.allocate(asked, BUDGET)
    rows = [(*k, q, got[k], q > got[k]) for k, q, _, _ in asked]
    return spark.createDataFrame(rows, "store_id long, product_id long, requested_qty long, approved_qty long, deferred boolean")


def _scratch(spark: SparkSession) -> TableStore:
    """A store in a folder of its own beside the warehouse's tables, which goes with the application."""
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{uuid.uuid4().hex}"
    store = TableStore(spark, root)
    fs, path = store._fs(root)
    fs.deleteOnExit(path)
    return store


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of every other store are sent again with other counts to a table store, which merges them by key."""
    snapshots = extra.retail_tables(spark, sf_dir)["inventory_snapshots"]
    store = _scratch(spark)
    store.append("inventory_snapshots", snapshots)
    store.upsert("inventory_snapshots", snapshots.filter("store_id % 2 = 0").withColumn("on_hand", F.col("on_hand") + 1))
    return store.read("inventory_snapshots")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables of a store."""
    names, store = ("stores", "products", "sales_daily", "promotions"), _scratch(spark)
    for name in names:
        store.append(name, extra.retail_tables(spark, sf_dir)[name])
    counts = store.counts()
    return spark.createDataFrame([(n, counts[n]) for n in names], "table_name string, n long")


def violated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's own check of promotions and sales of which some were spoilt: rule by rule, how many rows break it."""
    tables, store = extra.retail_tables(spark, sf_dir), _scratch(spark)
    for name in ("stores", "products"):
        store.append(name, tables[name])
    store.append("promotions", tables["promotions"].withColumn("discount_pct", F.when(F.col("promo_id") % 7 == 0, 1.5).otherwise(F.col("discount_pct").cast("double"))).withColumn("store_id", F.when(F.col("promo_id") % 11 == 0, F.lit(99).cast("long")).otherwise(F.col("store_id"))))
    return store.violations().filter("table_name = 'promotions'")


# --- twins, DuckDB only

_COARSE = """
by_store AS (SELECT store_id, dense_rank() OVER (ORDER BY region) AS s FROM stores), by_product AS (SELECT product_id, dense_rank() OVER (ORDER BY category) AS p FROM products),
sold AS (SELECT b.s AS store_id, c.p AS product_id, d.day, CAST(sum(d.units_sold) AS BIGINT) AS units FROM sales_daily d JOIN by_store b ON b.store_id = d.store_id JOIN by_product c ON c.product_id = d.product_id GROUP BY 1, 2, 3),
offers AS (SELECT b.s AS store_id, c.p AS product_id, p.start_day, p.end_day FROM promotions p JOIN by_product c ON c.product_id = p.product_id LEFT JOIN by_store b ON b.store_id = p.store_id WHERE p.store_id IS NULL OR b.s IS NOT NULL)"""
_FINE = """
sold AS (SELECT store_id, product_id, day, units_sold AS units FROM sales_daily),
offers AS (SELECT store_id, product_id, start_day, end_day FROM promotions)"""
#: y by place i on the axis of each series; f: on promotion; the horizon's days follow with y NULL.
_AXIS = f"""
fin AS (SELECT max(day) AS fin FROM sold),
axis AS (SELECT store_id, product_id, min(day) AS first, CAST(fin - min(day) + 1 AS BIGINT) AS n FROM sold, fin GROUP BY store_id, product_id, fin),
dense AS (
  SELECT a.store_id, a.product_id, a.n, k.i, a.first + CAST(k.i AS INTEGER) AS day, CASE WHEN k.i < a.n THEN CAST(coalesce(x.units, 0) AS DOUBLE) END AS y
  FROM axis a, LATERAL (SELECT unnest(range(0, a.n + {HORIZON})) AS i) k LEFT JOIN sold x ON x.store_id = a.store_id AND x.product_id = a.product_id AND x.day = a.first + CAST(k.i AS INTEGER)),
promo_days AS (SELECT DISTINCT d.store_id, d.product_id, d.i FROM dense d JOIN offers o ON o.product_id = d.product_id AND (o.store_id IS NULL OR o.store_id = d.store_id) AND d.day BETWEEN o.start_day AND o.end_day),
flagged AS (SELECT d.*, CASE WHEN p.i IS NULL THEN 0 ELSE 1 END AS f FROM dense d LEFT JOIN promo_days p ON p.store_id = d.store_id AND p.product_id = d.product_id AND p.i = d.i),
lifts AS (
  SELECT store_id, product_id, n, sum(f) AS promo_days, CASE WHEN sum(f) < 7 OR sum(f) = n OR sum(y * (1 - f)) <= 0 THEN 1e0
    ELSE least(greatest(1 + (sum(y * f) / sum(f) / (sum(y * (1 - f)) / (n - sum(f))) - 1) * sum(f) / (sum(f) + 7), 1e0), 5e0) END AS lift
  FROM flagged WHERE i < n GROUP BY store_id, product_id, n)"""


def _future(yhat: str, source: str) -> str:
    return f"SELECT q.store_id, q.product_id, CAST(fin + CAST(h AS INTEGER) + 1 AS DATE) AS target_day, {rnd(yhat, 4)} AS yhat FROM {source}, fin, (SELECT unnest(range(0, {HORIZON})) AS h) steps"


def _theta_sql(promo: bool) -> str:
    y = "CASE WHEN d.f = 1 THEN d.y / l.lift ELSE d.y END" if promo else "d.y"
    lifted = f"* CASE WHEN (SELECT x.f FROM flagged x WHERE x.store_id = q.store_id AND x.product_id = q.product_id AND x.i = q.n + h) = 1 THEN q.lift ELSE 1e0 END" if promo else ""
    body = _future(f"greatest(0e0, (5e-1 * (q.start + q.slope * (q.n + h)) + 5e-1 * q.best.level) * q.ratios[CAST((q.n + h) % 7 AS INTEGER) + 1]) {lifted}", "chosen q")
    return f"""
WITH {_COARSE}, {_AXIS},
given AS (SELECT d.store_id, d.product_id, d.n, d.i, l.lift, {y} AS y FROM flagged d JOIN lifts l ON l.store_id = d.store_id AND l.product_id = d.product_id WHERE d.i < d.n),
means AS (SELECT store_id, product_id, avg(y) AS mean FROM given GROUP BY store_id, product_id),
weekday AS (SELECT g.store_id, g.product_id, g.i % 7 AS j, CASE WHEN any_value(g.n) >= 14 THEN least(greatest(avg(g.y) / any_value(m.mean), 1e-1), 1e1) ELSE 1e0 END AS ratio
  FROM given g JOIN means m ON m.store_id = g.store_id AND m.product_id = g.product_id GROUP BY g.store_id, g.product_id, g.i % 7),
even AS (SELECT g.store_id, g.product_id, g.n, g.i, g.lift, g.y / w.ratio AS x FROM given g JOIN weekday w ON w.store_id = g.store_id AND w.product_id = g.product_id AND w.j = g.i % 7),
line AS (SELECT store_id, product_id, regr_slope(x, CAST(i AS DOUBLE)) AS slope, regr_intercept(x, CAST(i AS DOUBLE)) AS start FROM even GROUP BY store_id, product_id),
bent AS (SELECT e.store_id, e.product_id, any_value(e.n) AS n, any_value(e.lift) AS lift, any_value(l.slope) AS slope, any_value(l.start) AS start, list({{'z': 2 * e.x - (l.start + l.slope * e.i), 'level': 2 * e.x - (l.start + l.slope * e.i), 'error': 0e0}} ORDER BY e.i) AS zs
  FROM even e JOIN line l ON l.store_id = e.store_id AND l.product_id = e.product_id GROUP BY e.store_id, e.product_id),
tried AS (SELECT b.*, alpha, list_reduce(zs, lambda a, e: {{'z': e.z, 'level': a.level + alpha * (e.z - a.level), 'error': a.error + (e.z - a.level) * (e.z - a.level)}}) AS best FROM bent b, (VALUES (1e-1), (2e-1), (3e-1), (5e-1)) v(alpha)),
ratios AS (SELECT store_id, product_id, list(ratio ORDER BY j) AS ratios FROM weekday GROUP BY store_id, product_id),
chosen AS (SELECT t.store_id, t.product_id, t.n, t.lift, t.slope, t.start, t.best, r.ratios FROM tried t JOIN ratios r ON r.store_id = t.store_id AND r.product_id = t.product_id
  QUALIFY row_number() OVER (PARTITION BY t.store_id, t.product_id ORDER BY t.best.error, alpha) = 1)
{body}"""


_CROSTON_SQL = f"""
WITH {_COARSE}, {_AXIS},
hits AS (SELECT store_id, product_id, i, y, CAST(i - coalesce(lag(i) OVER (PARTITION BY store_id, product_id ORDER BY i), -1) AS DOUBLE) AS gap FROM dense WHERE y > 0),
folded AS (SELECT store_id, product_id, list_reduce(list({{'size': y, 'gap': gap}} ORDER BY i), lambda a, e: {{'size': a.size + 1e-1 * (e.size - a.size), 'gap': a.gap + 1e-1 * (e.gap - a.gap)}}) AS s FROM hits GROUP BY store_id, product_id),
chosen AS (SELECT a.store_id, a.product_id, coalesce((1 - 1e-1 / 2) * f.s.size / greatest(f.s.gap, 1e-9), 0e0) AS rate FROM axis a LEFT JOIN folded f ON f.store_id = a.store_id AND f.product_id = a.product_id)
{_future("q.rate", "chosen q")}"""

_MOVING_SQL = f"""
WITH {_COARSE}, {_AXIS},
level AS (SELECT store_id, product_id, any_value(n) AS n, avg(y) FILTER (WHERE i >= n - 28) AS level, avg(y) FILTER (WHERE i >= n - 56) AS mean, least(any_value(n), 56) AS m FROM dense WHERE i < n GROUP BY store_id, product_id),
weekday AS (SELECT d.store_id, d.product_id, (d.i - (d.n - l.m)) % 7 AS j, avg(d.y) AS own FROM dense d JOIN level l ON l.store_id = d.store_id AND l.product_id = d.product_id WHERE d.i < d.n AND d.i >= d.n - l.m GROUP BY 1, 2, 3),
profile AS (SELECT store_id, product_id, list(own ORDER BY j) AS own, list_avg(list(own)) AS of_all FROM weekday GROUP BY store_id, product_id),
chosen AS (SELECT l.*, p.own, p.of_all FROM level l JOIN profile p ON p.store_id = l.store_id AND p.product_id = l.product_id)
{_future("greatest(0e0, q.level * CASE WHEN q.m >= 14 AND q.mean > 0 THEN q.own[CAST((q.m + h) % 7 AS INTEGER) + 1] / q.of_all ELSE 1e0 END)", "chosen q")}"""

_HOLT_SQL = f"""
WITH {_COARSE}, {_AXIS},
begun AS (SELECT store_id, product_id, any_value(n) AS n, avg(y) FILTER (WHERE i < 7) AS one, avg(y) FILTER (WHERE i BETWEEN 7 AND 13) AS two, list(y ORDER BY i) AS ys FROM dense WHERE i < n GROUP BY store_id, product_id),
tries AS (SELECT a, b, g, row_number() OVER (ORDER BY a, b, g) AS k FROM (VALUES (15e-2), (3e-1), (5e-1)) x(a), (VALUES (2e-2), (1e-1)) z(b), (VALUES (1e-1), (3e-1)) w(g)),
laid AS (
  SELECT s.*, t.*, list_prepend({{'y': 0e0, 'j': 0::BIGINT, 'level': one, 'trend': (two - one) / 7, 'season': list_transform(ys[1:7], lambda v: v - one), 'error': 0e0}},
    list_transform(range(0, n), lambda i: {{'y': ys[i + 1], 'j': i % 7, 'level': 0e0, 'trend': 0e0, 'season': []::DOUBLE[], 'error': 0e0}})) AS steps
  FROM begun s, tries t),
folded AS (
  SELECT store_id, product_id, n, k, list_reduce(steps, lambda s, x: {{'y': x.y - (s.level + 95e-2 * s.trend + s.season[x.j + 1]), 'j': x.j,
    'level': s.level + 95e-2 * s.trend + a * (x.y - (s.level + 95e-2 * s.trend + s.season[x.j + 1])),
    'trend': 95e-2 * s.trend + a * b * (x.y - (s.level + 95e-2 * s.trend + s.season[x.j + 1])),
    'season': list_transform(s.season, lambda v, p: CASE WHEN p = x.j + 1 THEN v + g * (1 - a) * (x.y - (s.level + 95e-2 * s.trend + v)) ELSE v END),
    'error': s.error + (x.y - (s.level + 95e-2 * s.trend + s.season[x.j + 1])) ** 2}}) AS s FROM laid),
chosen AS (SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY s.error, k) = 1)
{_future("greatest(0e0, q.s.level + q.s.trend * list_sum(list_transform(range(1, h + 2), lambda e: 95e-2 ** e)) + q.s.season[CAST((q.n + h) % 7 AS INTEGER) + 1])", "chosen q")}"""

_SCORES_SQL = f"""
WITH {_COARSE}, {_AXIS},
origins AS (SELECT store_id, product_id, n, k, n - {HORIZON} * (k + 1) AS o FROM axis, (SELECT unnest(range(0, {FOLDS})) AS k) t WHERE n - {HORIZON} * (k + 1) >= 56),
oldest AS (SELECT store_id, product_id, min(o) AS o, count(*) AS folds FROM origins GROUP BY store_id, product_id),
tested AS (SELECT g.*, h, d.y FROM origins g, (SELECT unnest(range(0, {HORIZON})) AS h) t JOIN dense d ON d.store_id = g.store_id AND d.product_id = g.product_id AND d.i = g.o + h),
levels AS (SELECT g.store_id, g.product_id, g.o, avg(d.y) FILTER (WHERE d.i >= g.o - 28) AS level, avg(d.y) AS mean FROM origins g JOIN dense d ON d.store_id = g.store_id AND d.product_id = g.product_id AND d.i >= g.o - 56 AND d.i < g.o GROUP BY 1, 2, 3),
weekday AS (SELECT g.store_id, g.product_id, g.o, (d.i - g.o + 56) % 7 AS j, avg(d.y) AS own FROM origins g JOIN dense d ON d.store_id = g.store_id AND d.product_id = g.product_id AND d.i >= g.o - 56 AND d.i < g.o GROUP BY 1, 2, 3, 4),
said AS (
  SELECT s.store_id, s.product_id, 'seasonal_naive' AS model_name, s.h, s.y, d.y AS p FROM tested s JOIN dense d ON d.store_id = s.store_id AND d.product_id = s.product_id AND d.i = s.o - 7 + s.h % 7
  UNION ALL SELECT s.store_id, s.product_id, 'moving_average', s.h, s.y, greatest(0e0, l.level * CASE WHEN l.mean > 0 THEN w.own / l.mean ELSE 1e0 END)
  FROM tested s JOIN levels l ON l.store_id = s.store_id AND l.product_id = s.product_id AND l.o = s.o JOIN weekday w ON w.store_id = s.store_id AND w.product_id = s.product_id AND w.o = s.o AND w.j = s.h % 7),
scale AS (SELECT d.store_id, d.product_id, avg(abs(d.y - e.y)) AS scale FROM dense d JOIN oldest o ON o.store_id = d.store_id AND o.product_id = d.product_id AND d.i < o.o JOIN dense e ON e.store_id = d.store_id AND e.product_id = d.product_id AND e.i = d.i - 7 GROUP BY 1, 2),
sums AS (
  SELECT store_id, product_id, model_name, avg(abs(y - p)) AS mae, CASE WHEN sum(abs(y)) > 0 THEN sum(abs(y - p)) / sum(abs(y)) END AS wape, avg(p - y) AS bias, stddev_samp(y - p) AS sigma,
    least(0e0, quantile_cont(y - p, 1e-1)) AS low, greatest(0e0, quantile_cont(y - p, 9e-1)) AS high,
    CASE WHEN avg(abs(y - p)) FILTER (WHERE h < 14) > 0 THEN least(greatest((avg(abs(y - p)) FILTER (WHERE h >= 14) / avg(abs(y - p)) FILTER (WHERE h < 14) - 1) / 14, 0e0), 3e-2) ELSE 0e0 END AS growth
  FROM said GROUP BY store_id, product_id, model_name),
inside AS (SELECT s.store_id, s.product_id, s.model_name, avg(CASE WHEN s.y BETWEEN greatest(0e0, s.p + m.low * (1 + m.growth * s.h)) AND s.p + m.high * (1 + m.growth * s.h) THEN 1e0 ELSE 0e0 END) AS coverage
  FROM said s JOIN sums m ON m.store_id = s.store_id AND m.product_id = s.product_id AND m.model_name = s.model_name GROUP BY 1, 2, 3)
SELECT m.store_id, m.product_id, m.model_name, o.folds, {rnd("m.mae", 6)} AS mae, {rnd("m.wape", 6)} AS wape, {rnd("m.bias", 6)} AS bias, {rnd("m.mae / nullif(c.scale, 0)", 6)} AS mase, {rnd("m.sigma", 6)} AS sigma,
  {rnd("m.low", 6)} AS low, {rnd("m.high", 6)} AS high, {rnd("m.growth", 6)} AS growth, {rnd("i.coverage", 6)} AS coverage,
  CAST(CASE WHEN row_number() OVER (PARTITION BY m.store_id, m.product_id ORDER BY m.mae, abs(m.bias), m.model_name) = 1 THEN 1 ELSE 0 END AS INTEGER) AS selected
FROM sums m JOIN oldest o ON o.store_id = m.store_id AND o.product_id = m.product_id JOIN inside i ON i.store_id = m.store_id AND i.product_id = m.product_id AND i.model_name = m.model_name
LEFT JOIN scale c ON c.store_id = m.store_id AND c.product_id = m.product_id"""

_LIFT_SQL = f"""
WITH {_FINE}, {_AXIS},
zeros AS (SELECT store_id, product_id, avg(CASE WHEN y = 0 THEN 1e0 ELSE 0e0 END) AS share FROM dense WHERE i < n GROUP BY store_id, product_id)
SELECT l.store_id, l.product_id, l.n AS n_days, CAST(l.promo_days AS BIGINT) AS promo_days, CAST(CASE WHEN l.promo_days >= 7 AND l.n - l.promo_days >= 28 THEN 1 ELSE 0 END AS INTEGER) AS signal, {rnd("l.lift", 6)} AS lift,
  CAST(CASE WHEN z.share >= 5e-1 THEN 1 ELSE 0 END AS INTEGER) AS intermittent
FROM lifts l JOIN zeros z ON z.store_id = l.store_id AND z.product_id = l.product_id"""

#: The upper tail of the normal distribution at k, by the series of its integral; beyond 6 deviations it is 0 or 1.
_TAIL = """CASE WHEN k > 6 THEN 0e0 WHEN k < -6 THEN 1e0 WHEN k = 0 THEN 5e-1 ELSE 5e-1 - exp(-k * k / 2) / sqrt(2 * pi()) * sign(k)
    * list_sum(list_transform(range(0, 90), lambda e: exp((2 * e + 1) * ln(abs(k)) + e * ln(2e0) + lgamma(e + 1) - lgamma(2 * e + 2)))) END"""
_DECISIONS = f"""{_FINE}, {_AXIS},
recent AS (SELECT store_id, product_id, any_value(n) AS n, list(y ORDER BY i) FILTER (WHERE i >= n - 7) AS week, avg(y) AS mean, CASE WHEN any_value(n) > 1 THEN stddev_samp(y) FILTER (WHERE i >= n - 28) ELSE 0e0 END AS sigma FROM dense WHERE i < n GROUP BY store_id, product_id),
held AS (SELECT store_id, product_id, on_hand, on_order FROM inventory_snapshots QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY snapshot_day DESC) = 1),
ahead AS (
  SELECT r.*, h.on_hand + h.on_order AS position, p.lead_time_days AS lead, p.case_pack AS pack, CAST(p.unit_cost AS DOUBLE) AS unit_cost, p.shelf_life_days AS shelf,
    list_transform(range(0, greatest(p.lead_time_days + {REVIEW}, coalesce(p.shelf_life_days, 0))), lambda e: CASE WHEN r.n >= 7 THEN r.week[CAST(e % 7 AS INTEGER) + 1] ELSE r.mean END) AS f
  FROM recent r JOIN products p ON p.product_id = r.product_id JOIN held h ON h.store_id = r.store_id AND h.product_id = r.product_id),
sums AS (
  SELECT *, coalesce(list_sum(f[1:lead]), 0e0) AS ltd, coalesce(list_sum(f[1:lead + {REVIEW}]), 0e0) AS mean_demand, sigma * sqrt(CAST(lead + {REVIEW} AS DOUBLE)) AS sd,
    greatest(0, floor(coalesce(list_sum(f[1:shelf]), 0e0) + 1e-9) - position) AS sells FROM ahead),
points AS (SELECT *, 1.6448536269514722e0 * sd AS safety, (position - mean_demand) / nullif(sd, 0) AS k FROM sums),
risky AS (SELECT *, CASE WHEN sd <= 0 THEN CASE WHEN position < mean_demand THEN 1e0 ELSE 0e0 END ELSE {_TAIL} END AS risk FROM points),
asked AS (SELECT *, position < ltd + safety AS below, CASE WHEN mean_demand + safety - position <= 0 THEN 0 ELSE ceil((mean_demand + safety - position) / pack - 1e-9) * pack END AS q0,
  ceil({LEAST_ORDER} / pack::DOUBLE - 1e-9) * pack AS least_order, floor({MOST_ORDER} / pack::DOUBLE + 1e-9) * pack AS most_order, CASE WHEN sells <= 0 THEN 0 ELSE ceil(sells / pack - 1e-9) * pack END AS shelf_most FROM risky),
raised AS (SELECT *, CASE WHEN 0 < q0 AND q0 < least_order THEN least_order ELSE q0 END AS q1 FROM asked),
capped AS (SELECT *, least(q1, most_order) AS q2 FROM raised),
decided AS (
  SELECT store_id, product_id, {rnd("ltd", 4)} AS lead_time_demand, {rnd("safety", 4)} AS safety_stock, {rnd("ltd + safety", 4)} AS reorder_point, {rnd("mean_demand + safety", 4)} AS order_up_to,
    CAST(CASE WHEN NOT below THEN 0 WHEN shelf IS NOT NULL AND q2 > shelf_most THEN shelf_most ELSE q2 END AS BIGINT) AS order_qty,
    CASE WHEN NOT below THEN 'inventory position above reorder point' ELSE 'inventory position below reorder point' || CASE WHEN q1 > q0 THEN '; raised to minimum order' ELSE '' END
      || CASE WHEN q2 < q1 THEN '; capped by maximum order' ELSE '' END || CASE WHEN shelf IS NOT NULL AND q2 > shelf_most THEN '; capped by shelf life' ELSE '' END END AS reason,
    {rnd("risk", 4)} AS stockout_risk,
    {rnd("CASE WHEN sd <= 0 THEN greatest(0e0, mean_demand - position) ELSE greatest(0e0, sd * (exp(-k * k / 2) / sqrt(2 * pi()) - k * risk)) END * unit_cost", 4)} AS priority, unit_cost FROM capped)"""

TWINS: dict[str, str] = {
    "fc_moving_average": _MOVING_SQL,
    "fc_theta": _theta_sql(False),
    "fc_promo_theta": _theta_sql(True),
    "fc_croston_sba": _CROSTON_SQL,
    "fc_holt_winters": _HOLT_SQL,
    "backtest_scores": _SCORES_SQL,
    "lift_estimates": _LIFT_SQL,
    "policy_decisions": f"WITH {_DECISIONS}\nSELECT * FROM decided",
    "budget_allocation": f"""
WITH RECURSIVE {_DECISIONS},
lines AS (SELECT store_id, product_id, order_qty, order_qty * unit_cost AS cost, row_number() OVER (ORDER BY priority DESC, store_id, product_id) AS k FROM decided WHERE order_qty > 0),
book AS (SELECT list(cost ORDER BY k) AS costs FROM lines),
spent AS (
  SELECT 0::BIGINT AS k, {BUDGET!r}e0 AS left_over, false AS fits
  UNION ALL SELECT s.k + 1, CASE WHEN b.costs[s.k + 1] <= s.left_over * (1 + 1e-9) + 1e-9 THEN greatest(0e0, s.left_over - b.costs[s.k + 1]) ELSE s.left_over END, b.costs[s.k + 1] <= s.left_over * (1 + 1e-9) + 1e-9
  FROM spent s, book b WHERE s.k < len(b.costs))
SELECT l.store_id, l.product_id, l.order_qty AS requested_qty, CASE WHEN s.fits THEN l.order_qty ELSE 0 END AS approved_qty, NOT s.fits AS deferred FROM lines l JOIN spent s ON s.k = l.k""",
    "store_violations": """
SELECT 'promotions' AS table_name, 'discount_pct > 0 AND discount_pct < 1' AS rule, count(*) AS n FROM promotions WHERE promo_id % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT 'promotions', 'store_id -> stores.store_id', count(*) FROM promotions WHERE promo_id % 11 = 0 HAVING count(*) > 0""",
}


def functions() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"fc_{m}": partial(model_forecast, name=m) for m in ("moving_average", "theta", "promo_theta", "croston_sba", "holt_winters")}
    return out | {
        "fc_seasonal_naive": naive_of_runs, "backtest_scores": backtest_scores, "lift_estimates": lift_estimates, "policy_decisions": decisions, "budget_allocation": budget,
        "upsert_merge": upserted, "table_counts": counted, "store_violations": violated,
    }
