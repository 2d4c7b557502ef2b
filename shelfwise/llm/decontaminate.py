"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters and digits. A document and a benchmark item meet when they share a seed: five
tokens in a row, compared by a Karp-Rabin hash that rolls over the hashes of tokens. For each such pair the longest common
run of unmarked tokens is marked again and again, down to `MIN_MATCH` tokens, so that an item whose passages were reordered
or split is still covered. A document is contaminated by an item of which the tiles cover `THRESHOLD` or more.

Documents are read once, whatever the benchmark's size, and their texts are never shuffled. A sieve of fixed size
(`SIEVE_BITS` bits of a seed's hash) is broadcast; what passes it leaves the scan as narrow rows (document, place, hash)
and meets the seeds of the items in a hash join. Each pair is then tiled by itself.

Items of fewer than `MIN_MATCH` tokens have no seed: such an item matches a document only if that is all that the document
says. Defined results: null and empty texts and items have no tokens and match nothing; repeated documents get equal rows;
repeated items count as items of their own; empty tables give no matches; equal tiles are marked from the document's
beginning; further columns, whatever their names, are kept by `clean`, which judges every row by its own text.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, documents, free_names, frugal, materialise, tidy
from .tokens import Words, mix, powers, signed, words

MIN_MATCH = 5
THRESHOLD = 0.5
SIEVE_BITS = 22
#: Keys of contaminated texts are broadcast up to so many (some 50 MB); beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_WIDTH = np.uint64(0x9E3779B97F4A7C15)
MATCHES = "doc_id long, item_id long, item_tokens long, covered_tokens long, coverage double, tiles string"


def tokens(column: pa.Array) -> Iterator[Words]:
    """Hashed tokens of a string column, some documents at a time."""
    plain = pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), pattern=r"[^\p{L}\p{N}]+", replacement=" ")
    return words(plain)


def windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and Karp-Rabin hash of all windows of `width` tokens; a shorter document is one window of its own width."""
    h = w.hashes
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    power, inverse = powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)])
    n = np.where(w.count >= width, w.count - width + 1, np.minimum(w.count, 1))
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, size = w.bound[:-1][doc] + place, np.minimum(w.count, width)[doc]
    rolled = (sums[at + size] - sums[at]) * inverse[at]
    return doc, place, mix(rolled ^ (size.astype(np.uint64) * _WIDTH))


def tile(seeds: Iterable[tuple[int, int]], width: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Greedy tiling of a document and an item from the places (p, j) of their common windows.

    Seeds on one diagonal join to maximal runs; the longest unmarked one is marked each time. Returns the tokens of the
    item that are covered, and the tiles (place in the document, place in the item, length).
    """
    diagonals: dict[int, list[int]] = defaultdict(list)
    for p, j in seeds:
        diagonals[p - j].append(j)
    heap = []
    for d, starts in diagonals.items():
        starts.sort()
        begin = last = starts[0]
        for j in [*starts[1:], None]:
            if j is None or j != last + 1:
                heap.append((-(last - begin + width), begin + d, begin))
                begin = j
            last = j
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while heap:
        n, p, j = heapq.heappop(heap)
        free = [k for k in range(-n) if p + k not in in_doc and j + k not in in_item]
        if len(free) == -n:
            in_doc.update(range(p, p - n))
            in_item.update(range(j, j - n))
            tiles.append((p, j, -n))
            continue
        begin = None
        for k in [*free, None]:  # what is left of the run, if long enough, competes again
            if begin is None:
                begin = last = k
            elif k is None or k != last + 1:
                if last - begin + 1 >= width:
                    heapq.heappush(heap, (-(last - begin + 1), p + begin, j + begin))
                begin = k
            last = k
    return len(in_item), sorted(tiles)


def _seeds(min_match: int):
    """item, item_id, item_tokens, j and hash of all windows of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, item_id = np.asarray(batch.column(0)), batch.column(1)
            for w in tokens(batch.column(2)):
                doc, place, hashes = windows(w, min_match)
                at = pa.array(w.first + doc)
                yield pa.RecordBatch.from_arrays([pa.array(item[w.first + doc]), item_id.take(at), pa.array(w.count[doc]), pa.array(place), pa.array(signed(hashes))], names=["item", "item_id", "item_tokens", "j", "hash"])

    return run


def _sifted(shared, min_match: int):
    """row, key, p and hash of the documents' windows that pass the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for batch in batches:
            row, key = np.asarray(batch.column(0)), batch.column(1)
            for w in tokens(batch.column(2)):
                doc, place, hashes = windows(w, min_match)
                bucket = hashes >> np.uint64(64 - SIEVE_BITS)
                hit = np.flatnonzero(sieve[(bucket >> np.uint64(6)).astype(np.int64)] >> (bucket & np.uint64(63)) & np.uint64(1))
                at = w.first + doc[hit]
                yield pa.RecordBatch.from_arrays([pa.array(row[at]), key.take(pa.array(at)), pa.array(place[hit]), pa.array(signed(hashes[hit]))], names=["row", "key", "p", "hash"])

    return run


def _tiled(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, tiles = [], []
            for size, pairs in zip(batch.column(4).to_pylist(), batch.column(5)):
                pairs = np.asarray(pairs.values)
                n, found = tile(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()), min(min_match, size))
                covered.append(n)
                tiles.append(",".join(f"{p}:{j}:{n}" for p, j, n in found))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(covered, pa.int64()), pa.array(tiles, pa.string())], names=["row", "key", "item", "item_id", "item_tokens", "covered_tokens", "tiles"])

    return run


def _matches(keyed: DataFrame, items: DataFrame, least: float, min_match: int) -> DataFrame:
    """row, key, item, item_id, item_tokens, covered_tokens, coverage and tiles of all pairs that share a seed and whose
    tiles cover `least` or more. keyed: row, key and text; rows with equal row and key must have equal texts."""
    spark = keyed.sparkSession
    bound_batches(spark)
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    seeds = materialise(numbered.mapInArrow(frugal(_seeds(min_match)), "item long, item_id long, item_tokens long, j long, hash long"), "tiling-seeds")
    bucket = f"shiftrightunsigned(hash, {64 - SIEVE_BITS})"
    masks = seeds.groupBy(F.expr(f"{bucket} div 64").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, CAST({bucket} % 64 AS INT)))").alias("mask"))
    sieve = np.zeros(1 << SIEVE_BITS - 6, dtype=np.uint64)
    for r in masks.toLocalIterator():  # 65,536 rows at most
        sieve[r["at"]] = r["mask"] & 0xFFFFFFFFFFFFFFFF
    found = keyed.select("row", "key", "text").mapInArrow(frugal(_sifted(spark.sparkContext.broadcast(sieve), min_match)), "row long, key long, p long, hash long")
    found = materialise(found, "tiling-windows").dropDuplicates()
    met = found.join(seeds, "hash").groupBy("row", "key", "item", "item_id", "item_tokens")
    pairs = met.agg(F.collect_list(F.shiftleft("p", 32) + F.col("j")).alias("pairs"), F.count_distinct("j").alias("seeds"))
    # a seed covers `min_match` tokens at most
    may = pairs.filter(F.col("seeds") * min_match >= least * F.col("item_tokens")).drop("seeds")
    done = may.mapInArrow(frugal(_tiled(min_match)), "row long, key long, item long, item_id long, item_tokens long, covered_tokens long, tiles string")
    return done.withColumn("coverage", F.col("covered_tokens") / F.col("item_tokens")).filter(F.col("coverage") >= least)


@tidy
def matches(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, least: float = 0.0) -> DataFrame:
    """One row for each document and item that share a seed: how much of the item the tiles cover (`least` or more), and the tiles."""
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("key"), "text")
    found = _matches(keyed, items, least, min_match)
    return found.select(F.col("key").alias("doc_id"), "item_id", "item_tokens", "covered_tokens", "coverage", "tiles")


@tidy
def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH) -> DataFrame:
    """doc_id and the most covered item of every document that an item contaminates."""
    hit = matches(docs, items, min_match, threshold)
    best = F.max_by(F.struct("item_id", "coverage"), F.struct("coverage", -F.col("item_id")))
    return hit.groupBy("doc_id").agg(best.alias("best"), F.count_distinct("item_id").alias("n_items")).select(
        "doc_id", F.col("best.item_id").alias("item_id"), F.col("best.coverage").alias("coverage"), "n_items"
    )


@tidy
def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH) -> DataFrame:
    """The documents, with all their columns, that no item contaminates. A text decides for itself, whatever its doc_id."""
    row, key, hit_row, hit_key = free_names(docs, "row", "key", "hit_row", "hit_key")
    # two hashes and the length of a text stand for it
    one, two = F.xxhash64("text"), F.shiftleft(F.hash("text").cast("long"), 32) + F.coalesce(F.length("text"), F.lit(0))
    hit = _matches(docs.select(one.alias("row"), two.alias("key"), "text"), items, threshold, min_match)
    hit = materialise(hit.select(F.col("row").alias(hit_row), F.col("key").alias(hit_key)).distinct(), "contaminated")
    few = hit.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    keyed = docs.withColumns({row: one, key: two})
    same = (F.col(row) == F.col(hit_row)) & (F.col(key) == F.col(hit_key))
    return keyed.join(F.broadcast(hit) if few else hit, same, "left_anti").select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and an item that it contaminates, with the coverage and the tiles."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return matches(documents(spark, sf_dir), items, least=THRESHOLD)
