"""Mixing sources to target weights as a time-varying curriculum.

A source has a target (the words the mix takes of it) and a weight schedule over the training run: a piecewise linear
function of training time in [0, 1]. The integral of the schedule, scaled to the target, is the cumulative demand
D(t) of the source. Documents of a source stand in a fixed pseudo-random order; the word that lies at u of the source's
taken words is due at the time t with D(t) = u. Inverting D so gives every copy of a document its training position, and
a range sort by position gives the training order.

Nothing but a table of one row a source is ever ordered as a whole. Running totals inside a source are taken over slices
of the hash order (about `SLICE_ROWS` documents each) and then inside a slice, so a hot source is spread over many tasks.

Defined results: null text and text without words have size 0 and are taken 0 times; a null source is a source of its
own and the last one; equal rows are rows of their own, each with its own copies; ties in the hash order are broken by
doc_id, size and a hash of the whole row; an empty table gives an empty mix; further columns of the input may have any
name and are kept by `mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, documents, free_names, materialise, row_hash, tidy

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix has 150 % of all words
MAX_EPOCHS = 2
ROUNDS = 3
SLICE_ROWS = 20_000
SLICES = 64
#: Up to so many sources, tables of a row a source are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: A row that has more copies than the larger of this and a thousandth of all copies is spread over several tasks.
HOT_COPIES = 1_000
#: Schedules by a source's place in the cycle of weights: (time, relative weight) knots.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 0.5), (0.7, 1.0), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (0.7, 1.0), (1.0, 0.5)),
)


def words_in(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, hash order and row key of every document."""
    return docs.select(
        "doc_id",
        "source",
        words_in("text").alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")).cast("binary")).alias("place"),
        row_hash(docs).alias("row_key"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, rank, weight, source_size, target: shares by weight, each at most `MAX_EPOCHS` times the source's size.

    Sources are filled in the order of their limit over their weight: once the level `total / weight` that the others
    reach is no higher than the next source's limit, no target is above its limit any more. That is what resharing the
    excess again and again ends with. All of it is a running sum over one row a source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = own.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*map(F.lit, WEIGHTS))
    ranked = ranked.withColumn("weight", F.get(cycle, F.col("rank") % len(WEIGHTS)).cast("long")).withColumn("most", MAX_EPOCHS * F.col("source_size"))
    order = Window.orderBy((F.col("most") / F.col("weight")), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ranked.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("num", SHARE[0] * F.sum("source_size").over(all_rows) - SHARE[1] * F.col("full"))
        .withColumn("den", SHARE[1] * F.col("left_weight"))
        .withColumn("fits", F.col("num") * F.col("weight") <= F.col("most") * F.col("den"))
    )
    pick = level.withColumn("k", F.row_number().over(order)).withColumn("pick", F.min(F.when(F.col("fits"), F.struct("k", "num", "den"))).over(all_rows))
    share = F.col("weight").cast("double") * (F.col("pick.num").cast("double") / F.col("pick.den").cast("double"))
    return pick.select("source", "rank", "weight", "source_size", "n_docs", F.when(F.col("k") < F.col("pick.k"), F.col("most").cast("double")).otherwise(share).alias("target"))


def running(rows: DataFrame, slices: int, **totals: str) -> DataFrame:
    """Adds a column for each of `totals`: the sum of the named one over the rows of the same source that stand earlier in hash order."""
    cut = rows.withColumn("slice", (F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * slices / F.lit(1 << 32)).cast("int"))
    sums = cut.groupBy("source", "slice").agg(*(F.sum(value).alias(f"in_{name}") for name, value in totals.items()))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("source", "slice", *(F.coalesce(F.sum(f"in_{name}").over(earlier), F.lit(0)).alias(f"to_{name}") for name in totals))
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("*", *(F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(f"in_{name}") for name, value in totals.items()))
    joined = cut.alias("c").join(start.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.slice") == F.col("s.slice")))
    return joined.select("c.*", *((F.col(f"c.in_{name}") + F.col(f"s.to_{name}")).alias(name) for name in totals)).drop("slice", *(f"in_{name}" for name in totals))


def invert_demand(share: Column, rank: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The time at which a source's cumulative demand, integrated from its schedule, reaches `share` of its target."""

    def one(knots: Sequence[tuple[float, float]]) -> Column:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        total, done, out = sum(areas), 0.0, F.lit(None).cast("double")
        pieces = []
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            need, slope = share * total - done, (w1 - w0) / (t1 - t0)
            # w0 x + slope x^2 / 2 = need, in the form that is stable for a slope near 0
            pieces.append((done + area, F.lit(t0) + 2 * need / (w0 + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * need)))))
            done += area
        out = pieces[-1][1]
        for end, value in reversed(pieces[:-1]):
            out = F.when(share * total <= end, value).otherwise(out)
        return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))

    result = one(schedules[-1])
    for k in range(len(schedules) - 2, -1, -1):
        result = F.when(rank % len(schedules) == k, one(schedules[k])).otherwise(result)
    return result


def _of_source(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """Joins rows with a table of one row a source; the table's columns come last."""
    right = table.select(F.col("source").alias("of_source"), *(c for c in table.columns if c != "source"))
    return rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def mix(docs: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs, first_position, row_key of every row, and what `curriculum` needs.

    A source takes each document floor(target / size of the source) times; what is left of the target goes, once more,
    to the documents first in hash order that end within it (never beyond), and then, to come nearer, to those of the
    others in that order whose running total still fits what is left, twice. Positions are the times of the copies.
    """
    rows = materialise(sized(docs), "mix-sizes")
    targets = source_targets(rows)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    plan = materialise(plan, "mix-targets")
    n_sources, most = plan.agg(F.count(F.lit(1)), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    few, slices = n_sources <= BROADCAST_SOURCES, max(SLICES, -(-most // SLICE_ROWS))
    state = rows.withColumns({"extra": F.lit(False), "extra_before": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    need = plan.select("source", "rest", F.lit(0).cast("long").alias("used"))
    for k in range(ROUNDS):
        open_ = F.when(~F.col("extra") & (F.col("size") <= F.col("rest")), F.col("size")).otherwise(F.lit(0))
        totals = {"at": "open"} | ({"words": "size"} if k == 0 else {})
        summed = running(_of_source(state, need, few).withColumn("open", open_), slices, **totals)
        new = ~F.col("extra") & (F.col("size") > 0) & (F.col("open") == F.col("size")) & (F.col("at") + F.col("open") <= F.col("rest"))
        state = summed.select(
            "doc_id", "source", "size", "place", "row_key", (F.col("extra") | new).alias("extra"),
            F.when(new, F.col("used") + F.col("at")).otherwise(F.col("extra_before")).alias("extra_before"), F.col("words" if k == 0 else "before").alias("before"),
        )
        state = materialise(state, "mix-taken")
        used = state.filter("extra").groupBy("source").agg(F.sum("size").alias("sum"))
        got = plan.alias("p").join(used.alias("u"), F.col("p.source").eqNullSafe(F.col("u.source")), "left")
        need = materialise(got.select("p.source", (F.col("p.rest") - F.coalesce("u.sum", F.lit(0))).alias("rest"), F.coalesce("u.sum", F.lit(0)).alias("used")), "mix-need")
    taken = plan.alias("p").join(need.alias("n"), F.col("p.source").eqNullSafe(F.col("n.source")))
    taken = taken.select("p.source", "rank", "source_size", "target", "whole", (F.col("whole") * F.col("source_size") + F.col("n.used")).alias("source_taken"))
    epochs = F.col("whole") + F.col("extra").cast("long")
    joined = _of_source(state, taken, few).withColumn("epochs", epochs)
    first = F.when(F.col("epochs") > 0, invert_demand(_share(F.lit(0)), F.col("rank"), schedules))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "epochs", first.alias("first_position"),
        "row_key", "rank", "whole", "before", "extra_before", "source_taken",
    )


def _share(epoch: Column) -> Column:
    """The share of a source's taken words that stand before a copy: whole passes come first, the extra copies after them."""
    words = F.when(epoch < F.col("whole"), epoch * F.col("source_size") + F.col("before")).otherwise(F.col("whole") * F.col("source_size") + F.col("extra_before"))
    return F.least(F.lit(1.0), words / F.greatest(F.col("source_taken"), F.lit(1)))


def curriculum(mixed: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """One row a copy, range-sorted by training position: doc_id, epoch, position and the columns of `mixed`.

    The copies of a source fill its demand pass by pass: each lies at the share of the source's taken words before it.
    """
    copies = mixed.filter(F.col("epochs") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    placed = copies.withColumn("position", invert_demand(_share(F.col("epoch")), F.col("rank"), schedules))
    return placed.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id", "epoch")


@tidy
def taken_in(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs and first position of every document, read off its placed copies in the curriculum."""
    mixed = materialise(mix(docs).withColumn("row", F.monotonically_increasing_id()), "mix-plan")
    copies = materialise(curriculum(mixed).select("row", "size", "position"), "mix-curriculum")
    counted = copies.groupBy("row").agg(F.sum("size").alias("placed"), F.count("position").alias("copies"), F.min("position").alias("first"))
    number = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    every = mixed.select("row", "doc_id", "size", "source_size", "target")
    return every.join(counted, "row", "left").select("doc_id", "size", "source_size", "target", number(F.col("placed"), "taken"), number(F.col("copies"), "epochs"), F.col("first").alias("first_position"))


@tidy
def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, range-sorted by training position.

    Copies are joined to the rows by the hash of the whole row: of equal rows one stands for all, and their copies are
    those of all of them. A row of many copies is dealt over several tasks.
    """
    key, salt, own_key, own_salt, position, copies_in = free_names(docs, "row_key", "salt", "own_key", "own_salt", "position", "copies_in")
    plan = materialise(mix(docs).filter("epochs > 0").select("doc_id", "size", "row_key", "epochs", "rank", "whole", "source_size", "before", "extra_before", "source_taken"), "mix-plan")
    total = plan.agg(F.coalesce(F.sum("epochs"), F.lit(0))).first()[0]
    least = max(HOT_COPIES, total // 1000)  # so at most a thousand rows are hot
    hot = plan.groupBy("row_key").agg(F.sum("epochs").alias("n")).filter(F.col("n") > least).select(F.col("row_key").alias("hot_key"), F.ceil(F.col("n") / least).cast("int").alias("parts"))
    hot = materialise(hot, "mix-hot")
    copies = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))).withColumn("position", invert_demand(_share(F.col("epoch")), F.col("rank")))
    dealt = copies.join(F.broadcast(hot), F.col("row_key") == F.col("hot_key"), "left")
    dealt = dealt.select(F.col("row_key").alias(key), F.coalesce(F.pmod(F.xxhash64("position"), F.col("parts")).cast("int"), F.lit(0)).alias(salt), F.col("position").alias(position))
    rows = docs.withColumn(own_key, row_hash(docs)).join(F.broadcast(hot.select(F.col("hot_key").alias(key), F.col("parts").alias(copies_in))), F.col(own_key) == F.col(key), "left")
    rows = rows.withColumn(own_salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(copies_in), F.lit(1)) - 1))).select(own_key, own_salt, *(docs[c] for c in docs.columns))
    once = rows.dropDuplicates([own_key, own_salt])
    joined = dealt.join(once, (F.col(key) == F.col(own_key)) & (F.col(salt) == F.col(own_salt)))
    return joined.repartitionByRange(F.col(position), F.col(key)).sortWithinPartitions(position, key).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its target, the words taken, its copies and its first place in training (0 to 1; null if it has none)."""
    return taken_in(documents(spark, sf_dir))


def _sql_inverse(share: str, rank: str) -> str:
    """The inverted demand in SQL, written from the schedules."""

    def one(knots: Sequence[tuple[float, float]]) -> str:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        total, done, cases, last = sum(areas), 0.0, "", ""
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            need, slope = f"({share} * {total!r}e0 - {done!r}e0)", (w1 - w0) / (t1 - t0)
            last = f"({t0!r}e0 + 2 * {need} / ({w0!r}e0 + sqrt(greatest(0e0, {w0 * w0!r}e0 + {2 * slope!r}e0 * {need}))))"
            done += area
            cases += f" WHEN {share} * {total!r}e0 <= {done!r}e0 THEN {last}"
        cut = cases.rindex(" WHEN ")
        body = f"CASE{cases[:cut]} ELSE {last} END" if cases[:cut] else last
        return f"least(greatest({body}, 0e0), 1e0)"

    whens = "".join(f" WHEN {k} THEN {one(knots)}" for k, knots in enumerate(SCHEDULES))
    return f"CASE {rank} % {len(SCHEDULES)}{whens} END"


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS place
  FROM documents),
own AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
capped AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM own),
filled AS (
  SELECT *, row_number() OVER o AS k,
         3 * (SELECT sum(source_size) FROM own) - 2 * coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
         2 * ((SELECT sum(weight) FROM capped) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS den
  FROM capped WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / weight, rank)),
pick AS (SELECT k, num, den FROM filled WHERE num * weight <= most * den ORDER BY k LIMIT 1),
plan AS (
  SELECT f.source, f.source_size, f.rank,
         CASE WHEN f.k < p.k THEN CAST(f.most AS DOUBLE) ELSE CAST(f.weight AS DOUBLE) * (CAST(p.num AS DOUBLE) / CAST(p.den AS DOUBLE)) END AS target
  FROM filled f, pick p),
need0 AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(floor(target) AS BIGINT) - CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END * source_size AS rest
  FROM plan),
s0 AS (
  SELECT d.*, n.source_size, n.target, n.rank, n.whole, n.rest AS rest0, CASE WHEN d.size <= n.rest THEN d.size ELSE 0 END AS open0
  FROM sized d JOIN need0 n ON d.source IS NOT DISTINCT FROM n.source),
r0 AS (
  SELECT *, coalesce(sum(open0) OVER o, 0) AS at0, coalesce(sum(size) OVER o, 0) AS words_before
  FROM s0 WINDOW o AS (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t0 AS (SELECT *, size > 0 AND open0 = size AND at0 + open0 <= rest0 AS e0 FROM r0),
s1 AS (SELECT *, coalesce(sum(CASE WHEN e0 THEN size END) OVER (PARTITION BY source), 0) AS used0 FROM t0),
o1 AS (SELECT *, CASE WHEN NOT e0 AND size <= rest0 - used0 THEN size ELSE 0 END AS open1 FROM s1),
r1 AS (SELECT *, coalesce(sum(open1) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at1 FROM o1),
t1 AS (SELECT *, NOT e0 AND size > 0 AND open1 = size AND at1 + open1 <= rest0 - used0 AS e1 FROM r1),
s2 AS (SELECT *, used0 + coalesce(sum(CASE WHEN e1 THEN size END) OVER (PARTITION BY source), 0) AS used1 FROM t1),
o2 AS (SELECT *, CASE WHEN NOT e0 AND NOT e1 AND size <= rest0 - used1 THEN size ELSE 0 END AS open2 FROM s2),
r2 AS (SELECT *, coalesce(sum(open2) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at2 FROM o2),
t2 AS (SELECT *, NOT e0 AND NOT e1 AND size > 0 AND open2 = size AND at2 + open2 <= rest0 - used1 AS e2 FROM r2),
s3 AS (SELECT *, whole * source_size + used1 + coalesce(sum(CASE WHEN e2 THEN size END) OVER (PARTITION BY source), 0) AS source_taken, whole + CAST(e0 OR e1 OR e2 AS BIGINT) AS epochs FROM t2),
shares AS (
  SELECT *, least(1e0, CAST(CASE WHEN whole > 0 THEN words_before WHEN e0 THEN at0 WHEN e1 THEN used0 + at1 ELSE used1 + at2 END AS DOUBLE) / CAST(greatest(source_taken, 1) AS DOUBLE)) AS share FROM s3)
SELECT doc_id, size, source_size, target, size * epochs AS taken, epochs, CASE WHEN epochs > 0 THEN @INVERSE@ END AS first_position FROM shares
""".replace("@INVERSE@", _sql_inverse("share", "rank"))
