"""A synthetic retail dataset: every series is drawn by its own seeded generator, in parallel."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F

from .ingest import calendar_fields
from .store import TableStore

CATEGORIES = ("Grocery", "Household", "Beverages", "Personal Care", "Toys")
REGIONS = ("South", "North", "West", "East")


@dataclass(frozen=True)
class SimConfig:
    stores: int = 10
    products: int = 40
    start: dt.date = dt.date(2024, 1, 1)
    days: int = 730
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.stores, self.products) < 1 or self.days < 28:
            raise ValueError("at least one store, one product and 28 days are needed")


def _demand(config: SimConfig):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s, p in zip(frame["store_id"], frame["product_id"]):
                draw = np.random.default_rng([config.seed, int(p), int(s)])
                item = np.random.default_rng([config.seed, int(p)])
                t = np.arange(config.days)
                base, slope = item.lognormal(1.5, 0.8), item.normal(0, 0.0004)
                week = np.exp(item.normal(0, 0.15, 7))
                promo = (t + 13 * int(p)) % 90 < 7
                mean = base * np.exp(slope * t) * week[t % 7] * (1 + 0.15 * np.sin(2 * np.pi * t / 365.25)) * np.where(promo, 1.6, 1.0) * draw.lognormal(0, 0.2)
                want = draw.poisson(draw.gamma(8, mean / 8))
                stock, sold, out = want[:28].sum() + 5, np.zeros(config.days, int), np.zeros(config.days, int)
                for day in range(config.days):  # weekly review up to four weeks of mean demand
                    if day % 7 == 0:
                        stock = max(stock, int(28 * base * item_factor(draw)))
                    sold[day] = min(stock, want[day])
                    out[day] = int(want[day] > stock)
                    stock -= sold[day]
                yield pd.DataFrame({"store_id": s, "product_id": p, "day": [config.start + dt.timedelta(int(d)) for d in t], "units_sold": sold, "stockout_flag": out, "on_hand": np.maximum(0, stock)})

    return run


def item_factor(draw: np.random.Generator) -> float:
    return float(draw.uniform(0.7, 1.3))


def draw(spark: SparkSession, config: SimConfig):
    """store_id, product_id, day, units_sold, stockout_flag and stock at the end, drawn series by series."""
    grid = spark.range(config.stores * config.products).select((F.floor(F.col("id") / config.products) + 1).alias("store_id"), (F.col("id") % config.products + 1).alias("product_id"))
    return grid.mapInPandas(_demand(config), "store_id long, product_id long, day date, units_sold long, stockout_flag int, on_hand long")


def generate(store: TableStore, config: SimConfig = SimConfig()) -> None:
    """Writes stores, products, calendar, promotions, sales and snapshots. Equal configurations give equal tables."""
    spark: SparkSession = store.spark
    pick = np.random.default_rng(config.seed)
    stores = [(i + 1, f"S{i + 1:03d}", f"City {i + 1}", REGIONS[i % 4], ("flagship", "standard", "express")[i % 3], dt.date(2018, 1, 1) + dt.timedelta(97 * i)) for i in range(config.stores)]
    products = []
    for i in range(config.products):
        cost, category = float(np.round(pick.uniform(10, 200), 2)), CATEGORIES[i % 5]
        products.append((i + 1, f"SKU-{category[:3].upper()}-{i + 1:04d}", f"{category} item {i + 1}", category, cost, float(np.round(cost * pick.uniform(1.2, 1.9), 2)), int(pick.choice([1, 6, 12])), int(pick.integers(1, 15)), None if i % 3 else int(pick.integers(7, 60))))
    store.overwrite("stores", spark.createDataFrame(stores, store.schema("stores")))
    store.overwrite("products", spark.createDataFrame(products, store.schema("products")))
    end = config.start + dt.timedelta(config.days - 1)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(config.start), F.lit(end + dt.timedelta(60)))).alias("day"))
    store.overwrite("calendar", days.select("day", *(c.alias(k) for k, c in calendar_fields(F.col("day")).items())))
    promos, n = [], 0
    for p in range(1, config.products + 1):
        for d in range(-90, config.days + 60):
            if (d + 13 * p) % 90 == 0 and d >= 0:
                n += 1
                promos.append((n, p, None, config.start + dt.timedelta(d), config.start + dt.timedelta(d + 6), 0.2))
    store.overwrite("promotions", spark.createDataFrame(promos, store.schema("promotions")))
    drawn = draw(spark, config)
    price = spark.createDataFrame([(r[0], r[5]) for r in products], "product_id long, unit_price double")
    store.overwrite("sales_daily", drawn.join(F.broadcast(price), "product_id").withColumn("revenue", F.round(F.col("units_sold") * F.col("unit_price"), 2)))
    store.overwrite("inventory_snapshots", drawn.filter(F.col("day") == F.lit(end)).select("store_id", "product_id", F.col("day").alias("snapshot_day"), "on_hand", F.lit(0).alias("on_order")))
