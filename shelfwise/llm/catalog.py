"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, lm, minhash, mixing, quality, secrets, sharding, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_mixing": mixing.op2_mixing,
        "op3_minhash": minhash.op3_minhash,
        "op4_quality": quality.op4_quality,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_urls": urls.op6_urls,
        "op7_licenses": licenses.op7_licenses,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_sharding": sharding.op9_sharding,
        "op10_lm": lm.op10_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.OP2_SQL, "op7_licenses": licenses.OP7_SQL}
