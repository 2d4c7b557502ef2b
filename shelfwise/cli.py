"""Command line: init, run, runs, query, load, evaluate, export, dashboard, stats over a store's folder."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession, functions as F

from .plans import dashboard, forecast_run, named
from .sources import export, ingest, simulate
from .sources.store import TableStore


def session() -> SparkSession:
    return SparkSession.builder.appName("shelfwise").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelfwise")
    p.add_argument("--store", default="warehouse", help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init", help="write a synthetic dataset")
    for name, kind in (("stores", int), ("products", int), ("days", int), ("seed", int)):
        init.add_argument(f"--{name}", type=kind)
    run = sub.add_parser("run", help="forecast and replenish")
    for name, kind in (("horizon", int), ("n-folds", int), ("criterion", str), ("interval-method", str), ("interval-level", float), ("service-level", float), ("order-budget", float), ("min-history-days", int)):
        run.add_argument(f"--{name}", type=kind)
    run.add_argument("--cutoff", type=dt.date.fromisoformat)
    run.add_argument("--models")
    run.add_argument("--service-levels")
    sub.add_parser("runs", help="list runs").add_argument("--limit", type=int, default=20)
    query = sub.add_parser("query", help="a named query")
    query.add_argument("name", nargs="?")
    query.add_argument("--list", action="store_true")
    query.add_argument("--param", action="append", default=[])
    query.add_argument("--limit", type=int, default=50)
    query.add_argument("--explain", action="store_true")
    load = sub.add_parser("load", help="load CSV files")
    load.add_argument("--dir")
    load.add_argument("--table")
    load.add_argument("--file")
    load.add_argument("--mode", default="insert", choices=ingest.MODES)
    load.add_argument("--strict", action="store_true")
    load.add_argument("--dry-run", action="store_true")
    sub.add_parser("evaluate", help="score a run against sales").add_argument("--run-id", type=int)
    out = sub.add_parser("export", help="write orders, forecasts, metrics or the dataset")
    out.add_argument("what", choices=("orders", "forecasts", "metrics", "dataset"))
    out.add_argument("path")
    out.add_argument("--run-id", type=int)
    out.add_argument("--format", default="csv", choices=export.FORMATS)
    out.add_argument("--cells", default="safe", choices=("safe", "raw"))
    page = sub.add_parser("dashboard", help="write an HTML page")
    page.add_argument("path")
    page.add_argument("--run-id", type=int)
    sub.add_parser("stats", help="rows of each table")
    return p


def _given(args: argparse.Namespace, *names: str) -> dict:
    return {n: v for n in names if (v := getattr(args, n)) is not None}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    store = TableStore(session(), args.store)
    try:
        return _dispatch(store, args)
    except (ValueError, KeyError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


def _run_id(store: TableStore, given: int | None) -> int:
    run_id = given if given is not None else forecast_run.latest_run(store)
    if run_id is None:
        raise ValueError("there is no successful run")
    return run_id


def _dispatch(store: TableStore, args: argparse.Namespace) -> int:
    if args.command == "init":
        if store.exists("sales_daily"):
            raise ValueError("the store has data already")
        simulate.generate(store, simulate.SimConfig(**_given(args, "stores", "products", "days", "seed")))
    elif args.command == "run":
        config = _given(args, "horizon", "n_folds", "criterion", "interval_method", "interval_level", "service_level", "order_budget", "min_history_days", "cutoff")
        if args.models:
            config["models"] = tuple(args.models.split(","))
        if args.service_levels:
            config["service_levels"] = tuple(forecast_run.replenish.parse_service_levels(args.service_levels).items())
        run_id = forecast_run.execute(store, forecast_run.RunConfig(**config))
        print(json.dumps(store.read("forecast_runs").filter(F.col("run_id") == run_id).first().asDict(), default=str))
    elif args.command == "runs":
        for r in store.read("forecast_runs").orderBy(F.desc("run_id")).limit(args.limit).collect():
            print(json.dumps(r.asDict(), default=str))
    elif args.command == "query":
        if args.list or not args.name:
            print("\n".join(f"{n} {' '.join(':' + p for p in named.parameters(n))}".strip() for n in named.QUERIES))
            return 0
        store.views()
        params = {k: _value(v) for k, _, v in (x.partition("=") for x in args.param)}
        if "run_id" in named.parameters(args.name) and "run_id" not in params:
            params["run_id"] = _run_id(store, None)
        if args.explain:
            print(named.explain(store.spark, args.name, **params))
            return 0
        rows = named.run(store.spark, args.name, **params)
        for r in (rows.limit(args.limit) if args.limit else rows).toLocalIterator():
            print(json.dumps(r.asDict(), default=str))
    elif args.command == "load":
        options = {"mode": args.mode, "strict": args.strict, "dry_run": args.dry_run}
        reports = ingest.load_dataset(store, args.dir, **options) if args.dir else [ingest.load_csv(store, args.table, args.file, **options)]
        print(json.dumps([r.to_dict() for r in reports]))
    elif args.command == "evaluate":
        run_id = _run_id(store, args.run_id)
        found = forecast_run.evaluate(store.read("forecasts").filter(F.col("run_id") == run_id), store.read("sales_daily"))
        if found.isEmpty():
            raise ValueError(f"no day of run {run_id} has been realised")
        store.replace_run("forecast_evaluations", found.withColumn("evaluated_at", F.lit(dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"))))
        store.views()
        for r in named.run(store.spark, "evaluation_summary", run_id=run_id).collect():
            print(json.dumps(r.asDict(), default=str))
    elif args.command == "export":
        if args.what == "dataset":
            export.export_dataset(store, args.path)
        else:
            getattr(export, f"export_{args.what}")(store, _run_id(store, args.run_id), args.path, args.format, args.cells)
    elif args.command == "dashboard":
        with open(args.path, "w", encoding="utf-8") as out:
            out.write(dashboard.render(store, _run_id(store, args.run_id)))
    else:
        print(json.dumps(store.counts()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
