"""A folder of Parquet tables with declared schemas, keys and constraints.

Run tables are partitioned by run_id, so a run is written beside the others and replaced without touching them. Upserts
write the new state beside the old and swap the folders, as Parquet has no update in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    schema: str
    key: tuple[str, ...]
    checks: tuple[str, ...] = ()
    references: tuple[tuple[str, str], ...] = ()  # (column, table.column)
    by_run: bool = False


#: All tables; checks are SQL that each row must meet (null passes).
TABLES: dict[str, Table] = {
    "stores": Table("store_id long, store_code string, city string, region string, format string, opened_on date", ("store_id",), ("format IN ('flagship', 'standard', 'express')", "store_id >= 1")),
    "products": Table("product_id long, sku string, name string, category string, unit_cost double, unit_price double, case_pack long, lead_time_days long, shelf_life_days long", ("product_id",), ("unit_cost > 0", "unit_price >= unit_cost", "case_pack >= 1", "lead_time_days >= 0", "shelf_life_days > 0")),
    "calendar": Table("day date, day_of_week int, week_of_year int, month int, year int, is_weekend int, holiday_name string", ("day",), ("day_of_week BETWEEN 0 AND 6",)),
    "promotions": Table("promo_id long, product_id long, store_id long, start_day date, end_day date, discount_pct double", ("promo_id",), ("end_day >= start_day", "discount_pct > 0 AND discount_pct < 1"), (("product_id", "products.product_id"), ("store_id", "stores.store_id"))),
    "sales_daily": Table("store_id long, product_id long, day date, units_sold long, revenue double, stockout_flag int", ("store_id", "product_id", "day"), ("units_sold >= 0", "revenue >= 0", "stockout_flag IN (0, 1)"), (("store_id", "stores.store_id"), ("product_id", "products.product_id"), ("day", "calendar.day"))),
    "inventory_snapshots": Table("store_id long, product_id long, snapshot_day date, on_hand long, on_order long", ("store_id", "product_id", "snapshot_day"), ("on_hand >= 0", "on_order >= 0"), (("store_id", "stores.store_id"), ("product_id", "products.product_id"))),
    "forecast_runs": Table("run_id long, started_at string, finished_at string, cutoff_day date, horizon_days long, series_count long, status string, notes string, config_json string, interval_level double", ("run_id",), ("horizon_days > 0", "status IN ('running', 'succeeded', 'failed')")),
    "forecasts": Table("run_id long, store_id long, product_id long, target_day date, model_name string, yhat double, yhat_lower double, yhat_upper double, promo_flag int", ("run_id", "store_id", "product_id", "target_day"), ("yhat >= 0", "yhat_lower >= 0"), by_run=True),
    "backtest_metrics": Table("run_id long, store_id long, product_id long, model_name string, folds long, mae double, wape double, bias double, mase double, coverage double, selected int", ("run_id", "store_id", "product_id", "model_name"), by_run=True),
    "replenishment_orders": Table("run_id long, store_id long, product_id long, order_day date, expected_arrival date, on_hand long, on_order long, lead_time_demand double, safety_stock double, reorder_point double, order_up_to double, order_qty long, service_level double, reason string, stockout_risk double, priority double, requested_qty long", ("run_id", "store_id", "product_id"), ("order_qty >= 0",), by_run=True),
    "forecast_evaluations": Table("run_id long, store_id long, product_id long, model_name string, n_days long, mae double, wape double, bias double, coverage double, abs_error_sum double, actual_sum double, stockout_days long, evaluated_at string", ("run_id", "store_id", "product_id"), ("n_days > 0", "coverage BETWEEN 0 AND 1"), by_run=True),
    "data_loads": Table("loaded_at string, source string, table_name string, mode string, rows_inserted long, rows_updated long, rows_rejected long, notes string", ("loaded_at", "source", "table_name")),
}


class TableStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def schema(self, name: str) -> StructType:
        return StructType.fromDDL(TABLES[name].schema)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, name: str) -> bool:
        fs, path = self._fs(self.path(name))
        return fs.exists(path)

    def read(self, name: str) -> DataFrame:
        """A table with its declared columns; columns that older files lack are null. A table never written is empty."""
        schema = self.schema(name)
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name)).select(*schema.names)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema(name)))

    def append(self, name: str, rows: DataFrame) -> None:
        writer = self._shaped(name, rows).write.mode("append")
        (writer.partitionBy("run_id") if TABLES[name].by_run else writer).parquet(self.path(name))

    def replace_run(self, name: str, rows: DataFrame) -> None:
        """Replaces the runs that the rows belong to, and no others."""
        self._shaped(name, rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self.path(name))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows with new keys are added; rows with known keys take the place of the old ones, whole."""
        key = list(TABLES[name].key)
        rows = self._shaped(name, rows)
        merged = self.read(name).join(rows.select(*key), key, "left_anti").unionByName(rows)
        self._swap(name, merged)

    def overwrite(self, name: str, rows: DataFrame) -> None:
        self._swap(name, self._shaped(name, rows))

    def _swap(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.path(name) + ".next")
        fs, old = self._fs(self.path(name))
        _, new = self._fs(self.path(name) + ".next")
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"could not publish {name}")

    def views(self) -> None:
        for name in TABLES:
            table = self.read(name)
            if name == "replenishment_orders":
                table = table.withColumn("order_id", F.xxhash64("run_id", "store_id", "product_id"))
            table.createOrReplaceTempView(name)

    def counts(self) -> dict[str, int]:
        return {name: self.read(name).count() for name in TABLES}

    def violations(self) -> DataFrame:
        """table, rule and number of rows for each broken check, key and reference."""
        out = self.spark.createDataFrame([], "table_name string, rule string, n long")
        for name, spec in TABLES.items():
            if not self.exists(name):
                continue
            rows = self.read(name)
            parts = [(check, rows.filter(f"NOT ({check})").agg(F.count(F.lit(1)).alias("n"))) for check in spec.checks]
            parts.append((f"unique {', '.join(spec.key)}", rows.groupBy(*spec.key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n"))))
            for column, target in spec.references:
                other, _, far = target.partition(".")
                parts.append((f"{column} -> {target}", rows.filter(F.col(column).isNotNull()).join(self.read(other).select(F.col(far).alias(column)), column, "left_anti").agg(F.count(F.lit(1)).alias("n"))))
            for rule, n in parts:
                out = out.unionByName(n.filter("n > 0").select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "n"))
        return out
