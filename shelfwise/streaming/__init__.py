"""Streaming loads: validated sales rows are merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.ingest import FIELDS, validated
from ..sources.store import TableStore


def stream_sales(store: TableStore, folder: str, checkpoint: str):
    """A streaming query over the CSV files that arrive in a folder; each batch is validated and upserted into sales_daily."""
    spark = store.spark
    names = [f.name for f in FIELDS["sales_daily"]]
    lines = spark.readStream.option("header", True).schema(", ".join(f"{n} string" for n in names)).csv(folder)

    def merge(batch: DataFrame, _: int) -> None:
        cells = batch.select(*(F.nullif(F.trim(n), F.lit("")).alias(n) for n in names), F.monotonically_increasing_id().alias("row"))
        good = validated(cells, "sales_daily", {"stores": store.read("stores"), "products": store.read("products")}).filter("reason IS NULL")
        price = store.read("products").select("product_id", "unit_price")
        rows = good.join(price, "product_id").withColumn("revenue", F.coalesce("revenue", F.round(F.col("units_sold") * F.col("unit_price"), 2)))
        store.upsert("sales_daily", rows.select(*names))

    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
