"""Helpers shared by the training-data operators: shared-storage tables, row keys and skew-proof joins."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of anything but these six characters; as a Java regex and as an RE2 regex.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application.

    That is the folder in `spark.checkpoint.dir`, or one given to `SparkContext.setCheckpointDir`. Where neither is set, a
    session on a local master gets a temporary folder, as its executors are the driver; any other session is refused.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-"))
        named = context.getCheckpointDir()
    return f"{named}/{context.applicationId}"


#: Folders that `materialise` wrote, of each operator call that has not ended, the innermost last.
_written: list[set[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    folder = work_dir(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].add(path)
    _filesystem(spark, folder).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_by(df: DataFrame) -> set[str]:
    """The folders that the plan of `df` reads."""
    out = set()
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(k).toString() for k in range(roots.size())}
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by `materialise` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for path in _read_by(df):
            if spark.sparkContext.applicationId in path:
                _filesystem(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that, when it has made its result's plan, deletes the intermediate tables that the plan doesn't read.

    Those that the plan reads go with the application.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _written.append(set())
        kept: set[str] = set()
        spark = None
        try:
            out = operator(*args, **kwargs)
            spark = out.sparkSession
            name = lambda path: path.rstrip("/").rpartition("/")[2]
            read = {name(x) for x in _read_by(out)}
            kept = {x for x in _written[-1] if name(x) in read}
            return out
        finally:
            own = _written.pop()
            if _written:
                _written[-1].update(kept)
            if spark is not None:
                for path in own - kept:
                    _filesystem(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)

    return run


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each made longer until no column of `df` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers are kept between tasks, beside one another."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives back its worker's memory when it ends."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return inner


def bound_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Keep the session's Arrow batches small from here on: texts are long, and results that are read later are planned then.

    Lower settings of the session stand.
    """
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    units = {"b": 0, "k": 10, "m": 20, "g": 30}
    for name, most in names.items():
        now = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(name).lower())
        held = int(now[1]) << units[now[2] or "b"] if now and int(now[1]) > 0 else 0
        if not 0 < held <= most:
            spark.conf.set(name, str(most))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> Iterator[None]:
    """Arrow batches of few rows while a block runs: sets and texts are long, and tasks hold several batches at a time."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def unit_bucket(key: Column) -> Column:
    """doc_id's remainder by five, as the contracts of the learning operators ask for it; null stays null."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % F.lit(5)


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row; columns that hold maps, which have no hash, are left out."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()))


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left") -> DataFrame:
    """Join `left` (many rows a key) with `right` (one row a key, `weight` rows on the left).

    Keys that hold a hundredth of all rows or more are at most a hundred: these are broadcast, whatever the data's
    size, and their rows stay where they are. All others meet in an ordinary shuffled join. Null keys match nothing.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    names = [c for c in right.columns if c != key]
    hot = right.filter(F.col(weight) * 100 >= F.lit(total)).select(key, *(F.col(c).alias(f"__hot_{c}") for c in names))
    marked = left.join(F.broadcast(hot), key, "left")
    seen = F.col(f"__hot_{weight}").isNotNull()
    here = marked.filter(seen).select(*left.columns, *(F.col(f"__hot_{c}").alias(c) for c in names))
    rest = right.filter(F.col(weight) * 100 < F.lit(total))
    there = marked.filter(~seen).select(*left.columns).join(rest, key, how).select(*left.columns, *names)
    return here.unionByName(there)
