"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form a group that stays together. A partial partition is a list of k subset sizes; differencing
takes the two partial partitions with the largest spread and adds the largest subset of one to the smallest of the other,
and so on, until one partition is left. Groups are dealt by hash into parts of about `PART_GROUPS`; every part is
differenced in a task of its own. The k sums that a part ends with are a partial partition again: these are differenced in
the same way, about `FAN` of them a task, level by level, until one is left. So no task and no driver holds more than a
level's share, and where a group goes is found by joining the levels' tables downwards. Parts are cut by the hash of a
group, so no part grows with a single hot text, and a hot group is one item whatever its number of rows.

Defined results: null text has no bytes and each of its rows is a group of its own, empty texts are one group; repeated rows
are rows of the same group, each with its own slot; ties are broken by the group's hash, so reruns agree for rows with a
text; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import documents, join_hot, materialise, tidy

SHARDS = 24
PART_GROUPS = 20_000
FAN = 1_000
SLOT_ROWS = 20_000
OVERHEAD = 8


def difference(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differencing of n partial partitions into k subsets each; sizes: (n, k).

    Returns sums (k,) and place (n, k): the final subset of every subset of every partial partition.
    """
    n, k = sizes.shape
    if n == 0:
        return np.zeros(k), np.zeros((0, k), dtype=np.int64)
    order = np.argsort(-sizes, axis=1, kind="stable")
    sums = np.take_along_axis(sizes, order, axis=1).astype(np.float64)  # each node's subset sums, descending
    node_sums = list(sums)
    below: list[tuple[int, np.ndarray, int, np.ndarray] | None] = [None] * n
    heap = [(-(s[0] - s[-1]), i) for i, s in enumerate(node_sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joint = node_sums[a] + node_sums[b][::-1]
        turn = np.argsort(-joint, kind="stable")
        node_sums.append(joint[turn])
        node_sums[a] = node_sums[b] = None
        below.append((a, turn, b, k - 1 - turn))
        top = node_sums[-1]
        heapq.heappush(heap, (-(top[0] - top[-1]), len(below) - 1))
    root = heap[0][1]
    final: list[np.ndarray | None] = [None] * len(below)  # by node: final subset of its i-th largest subset
    final[root] = np.arange(k)
    for node in range(len(below) - 1, n - 1, -1):
        a, of_a, b, of_b = below[node]
        mine = final[node]
        final[a], final[b] = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
        final[a][of_a] = mine
        final[b][of_b] = mine
        final[node] = None
    place = np.empty((n, k), dtype=np.int64)
    for i in range(n):
        place[i, order[i]] = final[i]
    return node_sums[root], place


def _part(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "group"], ascending=[False, True], kind="stable")
        sizes = np.zeros((len(rows), k))
        sizes[:, 0] = rows["bytes"]
        _, place = difference(sizes)
        return pd.DataFrame({"part": rows["part"], "group": rows["group"], "bytes": rows["bytes"], "rows": rows["rows"], "local": place[:, 0].astype(np.int32)})

    return run


def _level(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, node = np.unique(rows["part"].to_numpy(), return_inverse=True)
        sizes = np.zeros((len(names), k))
        sizes[node, rows["local"]] = rows["bytes"]
        _, place = difference(sizes)
        return pd.DataFrame({"parent": rows["parent"], "part": rows["part"], "local": rows["local"], "bytes": rows["bytes"], "place": place[node, rows["local"]].astype(np.int32)})

    return run


def joined_parts(local: DataFrame, parts: int, shards: int, fan: int | None = None) -> DataFrame:
    """part, local, shard: the shard of each subset of each part, by differencing the parts' sums level by level."""
    fan = fan or FAN
    levels = []
    sums = local.groupBy("part", "local").agg(F.sum("bytes").alias("bytes"))
    while True:
        parents = max(1, -(-parts // fan))
        dealt = sums.withColumn("parent", F.pmod(F.xxhash64("part", F.lit(len(levels))), F.lit(parents)).cast("int"))
        levels.append(materialise(dealt.groupBy("parent").applyInPandas(_level(shards), "parent int, part int, local int, bytes long, place int"), "shard-level"))
        if parents == 1:
            break
        sums, parts = levels[-1].groupBy(F.col("parent").alias("part"), F.col("place").alias("local")).agg(F.sum("bytes").alias("bytes")), parents
    out = levels[-1].select("part", "local", F.col("place").alias("shard"))
    for level in reversed(levels[:-1]):
        above = out.select(F.col("part").alias("parent"), F.col("local").alias("place"), "shard")
        out = materialise(level.join(above, ["parent", "place"]).select("part", "local", "shard"), "shard-places")
    return out


@tidy
def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document.

    Slots count a shard's rows without a gap: first by slice of the documents' hash, then inside a slice.
    """
    text = F.col("text")
    lone = F.concat(F.lit("null:"), F.monotonically_increasing_id().cast("string"))
    rows = materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.when(text.isNull(), lone).otherwise(F.md5(F.encode(text, "UTF-8"))).alias("group"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    groups = materialise(groups, "shard-groups")
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    parts = max(1, -(-n_groups // PART_GROUPS))
    parted = groups.withColumn("part", F.pmod(F.xxhash64("group"), F.lit(parts)).cast("int"))
    local = materialise(parted.groupBy("part").applyInPandas(_part(shards), "part int, group string, bytes long, rows long, local int"), "shard-local")
    placed = local.join(joined_parts(local, parts, shards), ["part", "local"]).select("group", "rows", "shard")
    placed = materialise(placed, "shard-placed")
    dealt = join_hot(rows, placed, "group", "rows", "inner")
    slices = max(16, -(-n_rows // (SLOT_ROWS * shards)))
    dealt = materialise(dealt.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice")), "shard-dealt")
    counts = dealt.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The digest of an assignment. The law of the shards is `bytes`: sizes are as near equal as whole groups allow."""
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
