"""From sales rows to series: daily axis, promotion intervals, inventory as of a day, ABC classes as of a day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

KEY = ["store_id", "product_id"]


def resolve_cutoff(sales: DataFrame, cutoff: dt.date | None = None) -> dt.date:
    """The given day if sales cover it, else the last day of sales."""
    low, high = sales.agg(F.min("day"), F.max("day")).first()
    if high is None:
        raise ValueError("there are no sales")
    if cutoff is not None and not low <= cutoff <= high:
        raise ValueError(f"cutoff {cutoff} is outside {low} to {high}")
    return cutoff or high


def densify(sales: DataFrame, cutoff: dt.date) -> DataFrame:
    """store_id, product_id, day, units: each series from its own first day to the cutoff, 0 where nothing was sold."""
    past = sales.filter(F.col("day") <= F.lit(cutoff)).select(*KEY, "day", "units_sold")
    axis = past.groupBy(*KEY).agg(F.min("day").alias("first")).select(*KEY, F.explode(F.sequence("first", F.lit(cutoff))).alias("day"))
    return axis.join(past, [*KEY, "day"], "left").select(*KEY, "day", F.coalesce("units_sold", F.lit(0)).alias("units"))


def promo_days(promotions: DataFrame, stores: DataFrame) -> DataFrame:
    """store_id, product_id, day of all promotions: overlaps once, a null store for all stores. Stores are the small side."""
    every = promotions.filter("store_id IS NULL").drop("store_id").crossJoin(F.broadcast(stores.select("store_id")))
    own = promotions.filter("store_id IS NOT NULL")
    both = own.select("store_id", "product_id", "start_day", "end_day").unionByName(every.select("store_id", "product_id", "start_day", "end_day"))
    return both.select(*KEY, F.explode(F.sequence("start_day", "end_day")).alias("day")).distinct()


def inventory_as_of(snapshots: DataFrame, day: dt.date) -> DataFrame:
    """The last snapshot of each series up to a day: one partial aggregate, no window."""
    last = snapshots.filter(F.col("snapshot_day") <= F.lit(day)).groupBy(*KEY).agg(F.max_by(F.struct("on_hand", "on_order"), "snapshot_day").alias("s"))
    return last.select(*KEY, "s.on_hand", "s.on_order")


def abc_as_of(sales: DataFrame, day: dt.date, window: int = 90) -> DataFrame:
    """product_id and class by the running share of revenue in the window up to a day; ties by product."""
    recent = sales.filter((F.col("day") <= F.lit(day)) & (F.col("day") > F.date_sub(F.lit(day), window)))
    sums = recent.groupBy("product_id").agg(F.sum(F.col("revenue").cast("decimal(24,4)")).alias("revenue"))  # one row a product from here on
    order = Window.orderBy(F.col("revenue").desc(), "product_id").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.sum("revenue").over(order).cast("double") / F.nullif(F.sum("revenue").over(total).cast("double"), F.lit(0.0))
    return sums.select("product_id", F.when(share <= 0.7, "A").when(share <= 0.9, "B").otherwise("C").alias("abc_class"))


def packed(sales: DataFrame, promotions: DataFrame, cutoff: dt.date) -> DataFrame:
    """One row a series: first day, its sales as (day, units) pairs and its product's promotions. Kernels lay out the axis."""
    past = sales.filter(F.col("day") <= F.lit(cutoff))
    rows = past.groupBy(*KEY).agg(F.min("day").alias("first_day"), F.collect_list(F.struct(F.datediff("day", F.lit(dt.date(1970, 1, 1))).alias("d"), F.col("units_sold").cast("double").alias("u"))).alias("sold"))
    epoch = F.lit(dt.date(1970, 1, 1))
    promos = promotions.groupBy("product_id").agg(F.collect_list(F.struct("store_id", F.datediff("start_day", epoch).alias("a"), F.datediff("end_day", epoch).alias("b"))).alias("promos"))
    return rows.join(promos, "product_id", "left")
