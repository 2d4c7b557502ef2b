"""A forecast run: backtest, choice of a model, forecast with intervals, replenishment, budget, in one pass over series.

The series are one DataFrame row each; a kernel takes them a batch at a time, so that all folds of all series of a batch
are lanes of the same recursions. Results come back nested, one row a series, and are flattened by Catalyst.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import backtest, models, replenish, series

EPOCH = dt.date(1970, 1, 1)


@dataclasses.dataclass(frozen=True)
class RunConfig:
    horizon: int = 28
    cutoff: dt.date | None = None
    n_folds: int = 4
    min_history_days: int = 84
    criterion: str = "mae"
    interval_level: float = 0.8
    interval_method: str = "empirical"
    review_period_days: int = 7
    service_level: float = 0.95
    service_levels: tuple[tuple[str, float], ...] = ()
    models: tuple[str, ...] = ()
    order_budget: float | None = None
    abc_window: int = 90
    min_train: int = 56

    def __post_init__(self) -> None:
        checks = (
            (self.horizon >= 1, "horizon must be positive"),
            (self.n_folds >= 1, "n_folds must be positive"),
            (self.min_history_days >= 1, "min_history_days must be positive"),
            (self.criterion in backtest.CRITERIA, f"criterion must be one of {backtest.CRITERIA}"),
            (0 < self.interval_level < 1, "interval_level must be between 0 and 1"),
            (self.interval_method in backtest.INTERVALS, f"interval_method must be one of {backtest.INTERVALS}"),
            (self.review_period_days >= 1, "review_period_days must be positive"),
            (0.5 <= self.service_level < 1, "service_level must be in [0.5, 1)"),
            (self.order_budget is None or self.order_budget >= 0, "order_budget must not be negative"),
            (not set(self.models) - set(models.MODELS), f"models must be of {models.MODELS}"),
            (self.abc_window >= 1 and self.min_train >= 1, "windows must be positive"),
        )
        for fine, message in checks:
            if not fine:
                raise ValueError(message)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), default=str, sort_keys=True)


_F8, _I8, _STR = pa.float64(), pa.int64(), pa.string()
_SCORE = pa.struct([("model_name", _STR), ("folds", _I8), ("mae", _F8), ("wape", _F8), ("bias", _F8), ("mase", _F8), ("coverage", _F8), ("selected", pa.int32())])
_STEP = pa.struct([("h", pa.int32()), ("yhat", _F8), ("yhat_lower", _F8), ("yhat_upper", _F8), ("promo_flag", pa.int32())])
_ORDER = pa.struct([("lead_time_demand", _F8), ("safety_stock", _F8), ("reorder_point", _F8), ("order_up_to", _F8), ("order_qty", _I8), ("reason", _STR), ("stockout_risk", _F8), ("priority", _F8), ("service_level", _F8)])
_OUT = pa.schema([("store_id", _I8), ("product_id", _I8), ("n_days", _I8), ("model_name", _STR), ("scores", pa.list_(_SCORE)), ("steps", pa.list_(_STEP)), ("decision", _ORDER)])
RESULT = (
    "store_id long, product_id long, n_days long, model_name string,"
    "scores array<struct<model_name:string,folds:long,mae:double,wape:double,bias:double,mase:double,coverage:double,selected:int>>,"
    "steps array<struct<h:int,yhat:double,yhat_lower:double,yhat_upper:double,promo_flag:int>>,"
    "decision struct<lead_time_demand:double,safety_stock:double,reorder_point:double,order_up_to:double,order_qty:long,reason:string,stockout_risk:double,priority:double,service_level:double>"
)


def histories(batch: pa.RecordBatch, end: dt.date, reach: int) -> tuple[list[np.ndarray], list[np.ndarray | None], list[np.ndarray | None]]:
    """The daily axis of each packed series of a batch up to `end`, its promotion flags, and those of the `reach` days after.

    Sales are scattered into one array for the whole batch by the offsets of their Arrow list; a series without any
    promotion in sight has no flags.
    """
    days = lambda column: np.asarray(column.cast(pa.date32()).cast(pa.int32()))
    first, last = days(batch.column(batch.schema.get_field_index("first_day"))), (end - EPOCH).days
    sold = batch.column(batch.schema.get_field_index("sold"))
    n = last - first + 1
    starts = np.cumsum(n) - n
    offsets = np.asarray(sold.offsets)
    own = sold.values.slice(offsets[0], offsets[-1] - offsets[0])
    owner = np.repeat(np.arange(len(n)), np.diff(offsets))
    flat = np.bincount(starts[owner] + np.asarray(own.field("d")) - first[owner], np.asarray(own.field("u")), minlength=n.sum()).astype(float)
    past = np.split(flat, starts[1:])
    flags: list[np.ndarray | None] = []
    future: list[np.ndarray | None] = []
    stores, promos = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("store_id", "promos"))
    for i, offers in enumerate(promos):
        f = np.zeros(n[i] + reach)
        for p in offers or ():
            if p["store_id"] is None or p["store_id"] == stores[i]:
                f[max(0, p["a"] - first[i]) : max(0, p["b"] - first[i] + 1)] = 1
        flags.append(f[: n[i]] if f.any() else None)
        future.append(f[n[i] :] if f.any() else None)
    return past, flags, future


def _kernel(config: RunConfig, cutoff: dt.date, reach: int):
    levels = dict(config.service_levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            past, flags, future = histories(batch, cutoff, reach)
            rows = batch.select([c for c in batch.schema.names if c not in ("sold", "promos")]).to_pylist()
            names = [backtest.candidates(y, f, config.models) for y, f in zip(past, flags)]
            scores = backtest.backtest(past, flags, names, config.horizon, config.n_folds, config.interval_level, config.interval_method, config.min_train)
            won = [backtest.select(s, config.criterion) if s else None for s in scores]
            ahead: dict[int, np.ndarray] = {}
            for name in {w.model for w in won if w}:
                who = [i for i, w in enumerate(won) if w and w.model == name]
                ahead |= zip(who, models.forecast(name, [past[i] for i in who], reach, [flags[i] for i in who], [future[i] for i in who]))
            yield pa.RecordBatch.from_pylist([_result(r, past[i], future[i], scores[i], won[i], ahead[i]) for i, r in enumerate(rows) if won[i]], schema=_OUT)

    def _result(r: dict, y: np.ndarray, future: np.ndarray | None, scores: Sequence[backtest.Score], won: backtest.Score, forecast: np.ndarray) -> dict:
        low, high = won.interval.apply(forecast[: config.horizon])
        level = levels.get(r["abc_class"] or "C", config.service_level)
        d = replenish.decide(replenish.Need(forecast, won.sigma, r["on_hand"] or 0, r["on_order"] or 0, r["lead_time_days"], config.review_period_days, level, r["case_pack"] or 1, r["unit_cost"], r["shelf_life_days"]))
        return {
            "store_id": r["store_id"],
            "product_id": r["product_id"],
            "n_days": len(y),
            "model_name": won.model,
            "scores": [{"model_name": s.model, "folds": s.folds, "mae": s.mae, "wape": s.wape, "bias": s.bias, "mase": s.mase, "coverage": s.coverage, "selected": int(s is won)} for s in sorted(scores, key=lambda s: models.MODELS.index(s.model))],
            "steps": [{"h": h + 1, "yhat": forecast[h], "yhat_lower": low[h], "yhat_upper": high[h], "promo_flag": int(future is not None and future[h] > 0)} for h in range(config.horizon)],
            "decision": {k: getattr(d, k) for k in ("lead_time_demand", "safety_stock", "reorder_point", "order_up_to", "order_qty", "reason", "stockout_risk", "priority")} | {"service_level": level},
        }

    return run


@dataclasses.dataclass
class RunFrames:
    """The frames of a run; `results` holds one row a series and feeds the others."""

    config: RunConfig
    cutoff: dt.date
    results: DataFrame
    forecasts: DataFrame
    metrics: DataFrame
    orders: DataFrame


def frames(tables: dict[str, DataFrame], config: RunConfig, run_id: int = 1, keep=lambda df: df) -> RunFrames:
    """Plans a run over stores, products, sales_daily, promotions and inventory_snapshots. `keep` materialises results."""
    sales, products = tables["sales_daily"], tables["products"]
    cutoff = series.resolve_cutoff(sales, config.cutoff)
    lead = products.agg(F.max("lead_time_days")).first()[0] or 0
    reach = max(config.horizon, lead + config.review_period_days)
    need = max(config.min_history_days, config.horizon + config.min_train)  # a shorter series has no fold
    rows = series.packed(sales, tables["promotions"], cutoff).filter(F.datediff(F.lit(cutoff), "first_day") + 1 >= need)
    rows = rows.join(products.select("product_id", "lead_time_days", "case_pack", "unit_cost", "shelf_life_days"), "product_id")
    rows = rows.join(series.inventory_as_of(tables["inventory_snapshots"], cutoff), series.KEY, "left").join(series.abc_as_of(sales, cutoff, config.abc_window), "product_id", "left")
    columns = ["store_id", "product_id", "first_day", "sold", "promos", "lead_time_days", "case_pack", F.col("unit_cost").cast("double").alias("unit_cost"), "shelf_life_days", "on_hand", "on_order", "abc_class"]
    results = keep(rows.select(*columns).mapInArrow(_kernel(config, cutoff, reach), RESULT))
    run = F.lit(run_id).cast("long").alias("run_id")
    forecasts = results.select(run, *series.KEY, "model_name", F.explode("steps").alias("s")).select("run_id", *series.KEY, F.date_add(F.lit(cutoff), F.col("s.h")).alias("target_day"), "model_name", "s.yhat", "s.yhat_lower", "s.yhat_upper", "s.promo_flag")
    metrics = results.select(run, *series.KEY, F.explode("scores").alias("s")).select("run_id", *series.KEY, "s.*")
    stock = series.inventory_as_of(tables["inventory_snapshots"], cutoff)
    book = results.select(*series.KEY, "decision.*").join(stock, series.KEY, "left").join(products.select("product_id", "lead_time_days", F.col("unit_cost").cast("double").alias("unit_cost")), "product_id")
    orders = _orders(book, config, cutoff, run)
    return RunFrames(config, cutoff, results, forecasts, metrics, orders)


def _orders(book: DataFrame, config: RunConfig, cutoff: dt.date, run) -> DataFrame:
    """The order book. A budget is settled in order of priority: only lines with a quantity compete, as four columns each."""
    approved = F.col("order_qty")
    if config.order_budget is not None:
        lines = book.filter("order_qty > 0").select(*series.KEY, "order_qty", "unit_cost", "priority").toLocalIterator()
        got = replenish.allocate([((r["store_id"], r["product_id"]), r["order_qty"], r["unit_cost"], r["priority"]) for r in lines], config.order_budget)
        settled = book.sparkSession.createDataFrame([(*k, q) for k, q in got.items()], "store_id long, product_id long, approved long")
        book = book.join(settled, series.KEY, "left")
        approved = F.coalesce("approved", "order_qty")
    deferred = approved < F.col("order_qty")
    return book.select(
        run, *series.KEY, F.date_add(F.lit(cutoff), 1).alias("order_day"), F.date_add(F.lit(cutoff), (F.col("lead_time_days") + 1).cast("int")).alias("expected_arrival"),
        F.coalesce("on_hand", F.lit(0)).alias("on_hand"), F.coalesce("on_order", F.lit(0)).alias("on_order"), "lead_time_demand", "safety_stock", "reorder_point", "order_up_to",
        approved.alias("order_qty"), "service_level", F.when(deferred, F.concat("reason", F.lit(replenish.DEFERRED))).otherwise(F.col("reason")).alias("reason"), "stockout_risk", "priority", F.col("order_qty").alias("requested_qty"),
    )


def evaluate(forecasts: DataFrame, sales: DataFrame) -> DataFrame:
    """A row a series: errors, coverage and stock-outs of a run's forecasts over the days that have been realised."""
    both = forecasts.join(sales.select(*series.KEY, F.col("day").alias("target_day"), "units_sold", "stockout_flag"), [*series.KEY, "target_day"])
    error = F.abs(F.col("yhat") - F.col("units_sold"))
    inside = F.col("units_sold").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("int")
    sums = both.groupBy("run_id", *series.KEY, "model_name").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(error).alias("mae"), F.avg(F.col("yhat") - F.col("units_sold")).alias("bias"), F.avg(inside).alias("coverage"),
        F.sum(error).alias("abs_error_sum"), F.sum("units_sold").cast("double").alias("actual_sum"), F.sum("stockout_flag").cast("long").alias("stockout_days"),
    )
    return sums.withColumn("wape", F.col("abs_error_sum") / F.nullif(F.col("actual_sum"), F.lit(0.0)))


def execute(store, config: RunConfig) -> int:
    """Runs over a store's tables and writes the run: data first, the row that makes it visible last. Returns its id."""
    spark: SparkSession = store.spark
    tables = {n: store.read(n) for n in ("stores", "products", "sales_daily", "promotions", "inventory_snapshots")}
    cutoff = series.resolve_cutoff(tables["sales_daily"], config.cutoff)
    run_id = (store.read("forecast_runs").agg(F.max("run_id")).first()[0] or 0) + 1
    began = dt.datetime.now(dt.timezone.utc)
    row = {"run_id": run_id, "started_at": began.isoformat(timespec="seconds"), "finished_at": None, "cutoff_day": cutoff, "horizon_days": config.horizon, "series_count": 0, "status": "failed", "notes": "", "config_json": config.to_json(), "interval_level": config.interval_level}
    clock = time.time()
    try:
        plan = frames(tables, config, run_id, keep=lambda df: df.persist())
        store.append("forecasts", plan.forecasts)
        store.append("backtest_metrics", plan.metrics)
        store.append("replenishment_orders", plan.orders)
        row |= {"series_count": plan.results.count(), "status": "succeeded", "notes": f"elapsed {time.time() - clock:.1f} s"}
        plan.results.unpersist()
    except Exception as error:
        row |= {"notes": repr(error)[:500]}
        raise
    finally:
        row["finished_at"] = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        store.append("forecast_runs", spark.createDataFrame([row], store.schema("forecast_runs")))
    return run_id


def latest_run(store) -> int | None:
    return store.read("forecast_runs").filter("status = 'succeeded'").agg(F.max("run_id")).first()[0]
