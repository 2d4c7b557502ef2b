"""CSV loads with validation, as DataFrame expressions: the first broken rule of a row, in column order, is its reason."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import TableStore

MODES = ("insert", "upsert", "replace")
MAX_ERRORS = 20
MAX_CALENDAR_DAYS = 36_600
FORMATS = ("flagship", "standard", "express")


@dataclass(frozen=True)
class Field:
    """A column of a loadable table. low: '>' or '>=' and a bound; high: '<' and a bound."""

    name: str
    kind: str = "text"  # int, float, text, date or flag
    required: bool = True
    low: tuple[str, float] | None = None
    high: tuple[str, float] | None = None
    choices: tuple[str, ...] = ()
    default: object = None
    refers: str = ""


_STORE, _PRODUCT = Field("store_id", "int", refers="stores"), Field("product_id", "int", refers="products")
_ONE, _ZERO, _ABOVE = (">=", 1), (">=", 0), (">", 0)
FIELDS: dict[str, tuple[Field, ...]] = {
    "stores": (Field("store_id", "int", low=_ONE), Field("store_code"), Field("city"), Field("region"), Field("format", choices=FORMATS), Field("opened_on", "date")),
    "products": (Field("product_id", "int", low=_ONE), Field("sku"), Field("name"), Field("category"), Field("unit_cost", "float", low=_ABOVE), Field("unit_price", "float"), Field("case_pack", "int", False, _ONE, default=1), Field("lead_time_days", "int", low=_ZERO), Field("shelf_life_days", "int", False, _ABOVE)),
    "calendar": (Field("day", "date"), *(Field(n, "int", False) for n in ("day_of_week", "week_of_year", "month", "year", "is_weekend")), Field("holiday_name", required=False)),
    "promotions": (Field("promo_id", "int"), _PRODUCT, Field("store_id", "int", False, refers="stores"), Field("start_day", "date"), Field("end_day", "date"), Field("discount_pct", "float", low=_ABOVE, high=("<", 1))),
    "sales_daily": (_STORE, _PRODUCT, Field("day", "date"), Field("units_sold", "int", low=_ZERO), Field("revenue", "float", False, _ZERO), Field("stockout_flag", "flag", False, default=0)),
    "inventory_snapshots": (_STORE, _PRODUCT, Field("snapshot_day", "date"), Field("on_hand", "int", low=_ZERO), Field("on_order", "int", False, _ZERO, default=0)),
}
KEYS = {"stores": ("store_id",), "products": ("product_id",), "calendar": ("day",), "promotions": ("promo_id",), "sales_daily": ("store_id", "product_id", "day"), "inventory_snapshots": ("store_id", "product_id", "snapshot_day")}
UNIQUE = {"stores": "store_code", "products": "sku"}
TYPES = {"int": "long", "float": "double", "text": "string", "date": "date", "flag": "int"}
SAYS = {"int": "an integer", "float": "a number", "date": "an ISO date YYYY-MM-DD", "flag": "0 or 1"}


class IngestError(ValueError):
    """A strict load met rejected rows."""


@dataclass
class LoadReport:
    table: str
    mode: str
    dry_run: bool
    rows_read: int = 0
    inserted: int = 0
    updated: int = 0
    rejected: int = 0
    calendar_added: int = 0
    errors: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


def parsed(kind: str, cell: Column) -> Column:
    """The typed value of a trimmed cell; null if it is none. Integers may be written 12.0 or 1_000."""
    number = F.regexp_replace(cell, r"(?<=\d)_(?=\d)", "")
    if kind == "int":
        return F.when(number.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(number, r"\.0*$", "").try_cast("long"))
    if kind == "float":
        value = number.try_cast("double")
        return F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & (F.abs(value) < float("inf")), value)
    if kind == "date":
        return F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}$"), cell.try_cast("date"))
    if kind == "flag":
        return F.when(cell.isin("0", "1"), cell.cast("int"))
    return cell


def _problem(f: Field, cell: Column, value: Column) -> Column:
    """The reason why a cell is refused, else null."""
    got = F.concat(F.lit(" (got '"), cell, F.lit("')"))
    out = F.when(cell.isNull(), F.lit(f"{f.name} is required")) if f.required else F.when(cell.isNull(), F.lit(None))
    if f.kind != "text":
        out = out.when(value.isNull(), F.concat(F.lit(f"{f.name} must be {SAYS[f.kind]}"), got))
    if f.choices:
        out = out.when(~cell.isin(*f.choices), F.concat(F.lit(f"{f.name} must be one of {', '.join(f.choices)}"), got))
    bounds = [b for b in (f.low, f.high) if b]
    if bounds:
        fine = F.lit(True)
        for sign, bound in bounds:
            fine = fine & {">": value > bound, ">=": value >= bound, "<": value < bound}[sign]
        out = out.when(~fine, F.concat(F.lit(f"{f.name} must be {' and '.join(f'{s} {b}' for s, b in bounds)} (got "), value.cast("string"), F.lit(")")))
    return out


def read_cells(spark, path: str, table: str) -> DataFrame:
    """All cells as trimmed text (empty is null) with the row's number in the file; headers in any case, others ignored."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    missing = [f.name for f in FIELDS[table] if f.required and f.name not in names]
    if missing:
        raise ValueError(f"{path}: missing required column(s): {', '.join(missing)}")
    cells = [(F.nullif(F.trim(F.col(f"`{names[f.name]}`")), F.lit("")) if f.name in names else F.lit(None).cast("string")).alias(f.name) for f in FIELDS[table]]
    return _numbered(raw.select(*cells))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds `row`: 2 for the first data row. Partitions are counted; no rows move."""
    tagged = rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    counts = sorted((r["__p"], r["count"]) for r in tagged.groupBy("__p").count().collect())
    start, total = {}, 0
    for p, n in counts:
        start[p], total = total, total + n
    if not start:
        return rows.withColumn("row", F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in start.items() for x in pair)), F.col("__p"))
    return tagged.withColumn("row", (F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33) + offset + 2).cast("long")).drop("__p", "__i")


def validated(cells: DataFrame, table: str, lookups: dict[str, DataFrame], stored: DataFrame | None = None) -> DataFrame:
    """Typed columns, row and reason (null for good rows): column rules in order, references, row rules, repeated keys, and
    values of unique columns that another key has, in the `stored` rows of the table or earlier in the file."""
    rows = cells
    problems = []
    for f in FIELDS[table]:
        value = parsed(f.kind, F.col(f.name))
        problems.append(_problem(f, F.col(f.name), value))
        if f.refers:
            known = lookups[f.refers].select(F.col(f.name).alias(f"__{f.name}")).distinct()
            rows = rows.join(known, value == F.col(f"__{f.name}"), "left")
            problems.append(F.when(value.isNotNull() & F.col(f"__{f.name}").isNull(), F.concat(F.lit(f"unknown {f.name} "), value.cast("string"))))
    typed = rows.select("row", F.coalesce(*problems).alias("reason"), *(F.coalesce(parsed(f.kind, F.col(f.name)), F.lit(f.default).cast(TYPES[f.kind])).alias(f.name) for f in FIELDS[table]))
    if table == "products":
        typed = _also(typed, F.when(F.col("unit_price") < F.col("unit_cost"), F.concat(F.lit("unit_price must be >= unit_cost (got "), F.col("unit_price").cast("string"), F.lit(" < "), F.col("unit_cost").cast("string"), F.lit(")"))))
    if table == "promotions":
        typed = _also(typed, F.when(F.col("end_day") < F.col("start_day"), F.concat(F.lit("end_day must be >= start_day (got "), F.col("end_day").cast("string"), F.lit(" < "), F.col("start_day").cast("string"), F.lit(")"))))
    if table == "calendar":
        for name, own in calendar_fields(F.col("day")).items():
            if name != "week_of_year":
                typed = _also(typed, F.when(F.col(name) != own, F.concat(F.lit(f"{name} does not match day "), F.col("day").cast("string"))))
            typed = typed.withColumn(name, F.coalesce(name, own))
    key = list(KEYS[table])
    # the first good row of a key stands; good rows only compete with good rows
    alone = F.when(F.col("reason").isNotNull(), F.col("row"))  # bad rows, whose keys may all be null, are dealt one by one
    first = F.min(F.when(F.col("reason").isNull(), F.col("row"))).over(Window.partitionBy(*key, alone))
    shown = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in key))
    typed = typed.withColumn("__first", first)
    typed = _also(typed, F.when(F.col("row") > F.col("__first"), F.concat(F.lit("duplicate key ("), shown, F.lit(") first seen at row "), F.col("__first").cast("string")))).drop("__first")
    if table in UNIQUE:
        name = UNIQUE[table]
        if stored is not None:
            used = stored.select(F.col(name).alias("__name"), F.col(key[0]).alias("__by"))
            typed = typed.join(used, (F.col(name) == F.col("__name")) & (F.col(key[0]) != F.col("__by")), "left")
            typed = _also(typed, F.when(F.col("__by").isNotNull(), F.concat(F.lit(f"{name} '"), F.col(name), F.lit(f"' is already used by {key[0]} "), F.col("__by").cast("string")))).drop("__name", "__by")
        typed = typed.withColumn("__first", F.min(F.when(F.col("reason").isNull(), F.col("row"))).over(Window.partitionBy(name, alone)))
        typed = _also(typed, F.when(F.col("row") > F.col("__first"), F.concat(F.lit(f"duplicate {name} '"), F.col(name), F.lit("' first seen at row "), F.col("__first").cast("string")))).drop("__first")
    return typed


def _also(rows: DataFrame, problem: Column) -> DataFrame:
    return rows.withColumn("reason", F.coalesce("reason", problem))


def calendar_fields(day: Column) -> dict[str, Column]:
    return {"day_of_week": F.weekday(day), "week_of_year": F.weekofyear(day), "month": F.month(day), "year": F.year(day), "is_weekend": (F.weekday(day) >= 5).cast("int")}


def fill_calendar(store: TableStore, low: dt.date, high: dt.date, dry_run: bool = False) -> int:
    """Adds the days from low to high that the calendar lacks."""
    if (high - low).days > MAX_CALENDAR_DAYS:
        raise ValueError(f"days from {low} to {high} are more than {MAX_CALENDAR_DAYS}")
    days = store.spark.range(1).select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("day"))
    new = days.join(store.read("calendar").select("day"), "day", "left_anti")
    n = new.count()
    if n and not dry_run:
        store.append("calendar", new.select("day", *(c.alias(k) for k, c in calendar_fields(F.col("day")).items())))
    return n


def load_csv(store: TableStore, table: str, path: str, mode: str = "insert", dry_run: bool = False, strict: bool = False) -> LoadReport:
    """Loads a file: good rows go in, others are counted with their reasons (the first `MAX_ERRORS` by row are shown)."""
    if table not in FIELDS:
        raise ValueError(f"'{table}' is not loadable; choose one of {', '.join(FIELDS)}")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)} (got '{mode}')")
    rows = validated(read_cells(store.spark, path, table), table, {"stores": store.read("stores"), "products": store.read("products")}, store.read(table))
    key = list(KEYS[table])
    known = store.read(table).select(*key).withColumn("__known", F.lit(True))
    rows = rows.join(known, key, "left")
    shown = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in key))
    if mode == "insert":
        rows = _also(rows, F.when(F.col("__known"), F.concat(F.lit("key ("), shown, F.lit(") already exists"))))
    if table == "sales_daily":
        price = store.read("products").select("product_id", "unit_price")
        rows = rows.join(price, "product_id", "left").withColumn("revenue", F.coalesce("revenue", F.round(F.col("units_sold") * F.col("unit_price"), 2))).drop("unit_price")
    rows = rows.persist()
    good = rows.filter("reason IS NULL")
    report = LoadReport(table, mode, dry_run)
    report.rows_read, report.rejected, report.updated = rows.agg(F.count(F.lit(1)), F.count("reason"), F.count(F.when(F.col("reason").isNull() & F.col("__known"), 1))).first()
    report.inserted = report.rows_read - report.rejected - report.updated
    report.errors = [f"row {r['row']}: {r['reason']}" for r in rows.filter("reason IS NOT NULL").orderBy("row").limit(MAX_ERRORS).collect()]
    try:
        if strict and report.rejected:
            raise IngestError(f"{table}: {report.rejected} of {report.rows_read} rows rejected (strict mode); {'; '.join(report.errors)}")
        if table in ("sales_daily",) and report.rejected < report.rows_read:
            report.calendar_added = fill_calendar(store, *good.agg(F.min("day"), F.max("day")).first(), dry_run=dry_run)
        if not dry_run:
            names = [f.name for f in FIELDS[table]]
            (store.append if mode == "insert" else store.upsert)(table, good.select(*names))
            now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
            load = [(now, path, table, mode, report.inserted, report.updated, report.rejected, "")]
            store.append("data_loads", store.spark.createDataFrame(load, store.schema("data_loads")))
    finally:
        rows.unpersist()
    return report


def load_dataset(store: TableStore, folder: str, **options) -> list[LoadReport]:
    """The files of a folder that are there, in the order of references."""
    found = [(t, f"{folder}/{t}.csv") for t in FIELDS]
    out = []
    for table, path in found:
        fs, target = store._fs(path)
        if fs.exists(target):
            out.append(load_csv(store, table, path, **options))
    if not out:
        raise ValueError(f"{folder}: no file of {', '.join(f'{t}.csv' for t in FIELDS)}")
    return out
