"""All queries of the engine and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .plans import extra, named, operated
from .sources import warehouse

#: Parameters with which the registered queries run.
PARAMETERS = {"run_id": 2, "store_id": 1, "product_id": 1}
#: Queries over realised days look at the backdated run.
BACKDATED = {"forecast_vs_actual", "evaluation_summary", "forecast_bias_by_category"}


def bound(sql: str, name: str) -> str:
    for key, value in (PARAMETERS | ({"run_id": 1} if name in BACKDATED else {})).items():
        sql = sql.replace(f":{key}", f"CAST({value} AS BIGINT)")
    return sql


def _run(spark: SparkSession, sf_dir: str, name: str, text: Callable[[str], str]) -> DataFrame:
    return warehouse.run(spark, sf_dir, bound(text("spark"), name))


def _texts() -> dict[str, Callable[[str], str]]:
    return {name: partial(named.text, name) for name in named.QUERIES} | {name: partial(extra.text, name) for name in extra.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: partial(_run, name=name, text=text) for name, text in _texts().items()}
    return out | extra.functions() | operated.functions()


def oracle_sql() -> dict[str, str]:
    return {name: warehouse.with_tables(bound(text("duckdb"), name), "duckdb") for name, text in _texts().items()} | {name: warehouse.with_tables(sql, "duckdb") for name, sql in (extra.FUNCTION_SQL | operated.TWINS).items()}
