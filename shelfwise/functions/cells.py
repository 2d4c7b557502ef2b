"""Spreadsheet-safe cells: text that a spreadsheet could run as a formula gets an apostrophe before it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POLICIES = ("safe", "raw")
#: A leading tab, return or line break; or a formula sign after nothing but control, format and separator characters.
UNSAFE = r"^[\t\r\n]|^[\p{Cc}\p{Cf}\p{Z}]*[=+\-@]"


def is_unsafe(cell: Column) -> Column:
    return F.coalesce(cell.rlike(UNSAFE), F.lit(False))


def safe(cell: Column) -> Column:
    """Idempotent; null stays null."""
    return F.when(is_unsafe(cell), F.concat(F.lit("'"), cell)).otherwise(cell)


def check_policy(policy: str) -> str:
    if policy not in POLICIES:
        raise ValueError(f"cells must be one of {', '.join(POLICIES)} (got '{policy}')")
    return policy
