"""Exports: runs as CSV or JSON for people (safe cells), the dataset as CSV for another load (raw cells)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cells
from .ingest import FIELDS, KEYS
from .store import TableStore

FORMATS = ("csv", "json")


def _write(rows: DataFrame, path: str, fmt: str, policy: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)} (got '{fmt}')")
    if fmt == "csv" and cells.check_policy(policy) == "safe":
        rows = rows.select(*(cells.safe(F.col(c)).alias(c) if kind == "string" else c for c, kind in rows.dtypes))
    writer = rows.coalesce(1).write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)
    return path


def export_orders(store: TableStore, run_id: int, path: str, fmt: str = "csv", policy: str = "safe") -> str:
    orders = store.read("replenishment_orders").filter(F.col("run_id") == run_id)
    named = orders.join(store.read("stores").select("store_id", "store_code"), "store_id").join(store.read("products").select("product_id", "sku", "name", "category", "unit_cost"), "product_id")
    return _write(named.withColumn("order_cost", F.round(F.col("order_qty") * F.col("unit_cost"), 2)).orderBy(F.desc("order_cost"), "store_id", "product_id"), path, fmt, policy)


def export_forecasts(store: TableStore, run_id: int, path: str, fmt: str = "csv", policy: str = "safe") -> str:
    rows = store.read("forecasts").filter(F.col("run_id") == run_id)
    return _write(rows.orderBy("store_id", "product_id", "target_day"), path, fmt, policy)


def export_metrics(store: TableStore, run_id: int, path: str, fmt: str = "csv", policy: str = "safe") -> str:
    rows = store.read("backtest_metrics").filter(F.col("run_id") == run_id)
    return _write(rows.orderBy("store_id", "product_id", "model_name"), path, fmt, policy)


def export_dataset(store: TableStore, folder: str) -> list[str]:
    """Each loadable table as a folder of CSV in key order; null is empty, cells are raw."""
    return [_write(store.read(t).select(*(f.name for f in FIELDS[t])).orderBy(*KEYS[t]), f"{folder}/{t}.csv", "csv", "raw") for t in FIELDS]
