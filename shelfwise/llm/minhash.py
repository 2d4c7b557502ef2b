"""Near-duplicates by b-bit MinHash.

A document's set are the hashes of its five-word shingles. `BANDS` times `ROWS` minima of the set under as many hash
functions are found; each band of minima is a bucket key, and of each minimum the lowest `BITS` bits are kept, packed into
64-bit words. Documents with equal sets are one class from there on. Classes that share a bucket are candidates; the bits
in which their signatures agree give, corrected for chance agreement, an estimate of their similarity, and pairs that
may reach the threshold are confirmed on the full sets. Linked classes are joined to components.

A bucket never makes all its pairs. First each class is paired with the one class that comes first in most of its buckets;
from there on pairs are needed only between components. In buckets that hold several, members stand in order and each is
paired with the first and with the `NEAR` before it, if of another component: small buckets are complete so. In larger
ones that still hold several components, members are compared, in blocks, with all members of other components by an upper
bound of the similarity, and only pairs that may reach the threshold leave the comparison. That is exact for any bucket.

Probability of a common bucket: 1 - (1 - s**5)**32, which is 0.9998 for s = 0.75 and 0.999997 for s = 0.8.

Defined results: null and empty texts and texts without words have an empty set and are linked with nothing; fewer than
five words are one shingle; rows with a null doc_id are not linked (their component is null, and they are kept); repeated
rows share their component, and `deduplicate` keeps one of them; rows that share a doc_id but not a text are judged each by
its text; an empty table gives an empty result; other columns are ignored by `link` and kept by `deduplicate`, whatever
their names. Buckets of any size are dealt out: the counts and the first class of a bucket are partial aggregates, hot
buckets meet them by a broadcast of at most a hundred rows, and neighbours are looked for in parts of `BLOCK` classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import documents, free_names, frugal, join_hot, materialise, small_batches, tidy
from .tokens import mix, shingles, signed, words

BANDS, ROWS, BITS = 32, 5, 4
PERCENT = 75
NEAR = 4
BLOCK = 256
#: Pairs whose estimate is below are not confirmed: five standard deviations of the estimate below the threshold.
LEAST_ESTIMATE = 0.56
_HASHES = BANDS * ROWS
_SEED = np.random.default_rng(20240229)
_MULTIPLY = (_SEED.integers(0, 1 << 32, _HASHES, dtype=np.uint32) | np.uint32(1))
_FLIP = _SEED.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
_PER_WORD = 64 // BITS
SIGNATURE = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, signature array<long>"


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each hash function; sets of any size, a bounded block at a time."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(_HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), 2048):
        block = (low[k : k + 2048, None] ^ _FLIP) * _MULTIPLY
        np.minimum(out, (block ^ (block >> np.uint32(15))).min(axis=0), out=out)
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """The lowest bits of each row of minima, packed into 64-bit words."""
    bits = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), -1, _PER_WORD)
    return (bits << (np.arange(_PER_WORD, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures: agreeing groups of bits, corrected for chance agreement."""
    odd = a ^ b
    for shift in (1, 2):
        odd = odd | (odd >> np.uint64(shift))
    lanes = np.uint64(int("1" * _PER_WORD, 16))
    match = 1 - np.bitwise_count(odd & lanes).sum(axis=-1) / _HASHES
    chance = 2.0**-BITS
    return (match - chance) / (1 - chance)


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each document of a batch."""
    for w in words(batch.column(column)):
        every, bound = shingles(w)
        for d in range(len(w.count)):
            yield w.first + d, np.unique(every[bound[d] : bound[d + 1]])


def _key(own: np.ndarray) -> bytes:
    """128 bits for a set: two independent sums over its avalanche-mixed elements."""
    one = mix(own).sum(dtype=np.uint64)
    two = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    turn = np.array([2 * k + 3 for k in range(ROWS)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        n = batch.num_rows
        count, keys, least = np.zeros(n, dtype=np.int64), [b""] * n, np.zeros((n, _HASHES), dtype=np.uint32)
        for row, own in _sets(batch, 2):
            count[row] = len(own)
            if len(own):
                keys[row] = _key(own)
                least[row] = minima(own)
        bands = mix((mix(least.reshape(n, BANDS, ROWS).astype(np.uint64) + turn) * turn).sum(axis=2, dtype=np.uint64) + salt)
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(signed(np.ascontiguousarray(m).reshape(-1))))
        columns = [batch.column(0), batch.column(1), pa.array(count), pa.array(keys, pa.binary()), lists(bands), lists(pack(least))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "set_key", "bands", "signature"])


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(frugal(_sign), SIGNATURE)


def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    return pd.Series(similarity(np.stack(a.to_numpy()).view(np.uint64), np.stack(b.to_numpy()).view(np.uint64)))


def _confirm(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
    return pd.Series(out)


def shared_buckets(classes: DataFrame) -> DataFrame:
    """key, cls, first (the least class of the bucket) and n (its classes) of all buckets of two classes or more."""
    rows = classes.select(F.explode("bands").alias("key"), "cls")
    whole = rows.groupBy("key").agg(F.min("cls").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return join_hot(rows, materialise(whole, "minhash-shared"), "key", "n", "inner")


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """For each class the one pair with the class that comes first in most of its buckets."""
    ways = buckets.filter("first < cls").groupBy("cls", "first").agg(F.count(F.lit(1)).alias("ways"))
    return ways.groupBy(F.col("cls").alias("b")).agg(F.max_by("first", F.struct("ways", -F.col("first"))).alias("a")).select("a", "b")


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their components, of those buckets that hold several components."""
    rows = buckets.join(labels, buckets["cls"] == labels["node"], "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("component"))
    rows = materialise(rows, "minhash-placed")
    several = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    several = materialise(several.filter("low != high").select("key", "members"), "minhash-several")
    return join_hot(rows, several, "key", "members", "inner").drop("members")


def _part(n: Column) -> tuple[Column, Column]:
    """The number of parts of a bucket of n classes, and the part of a class."""
    parts = F.ceil(n / BLOCK).cast("int")
    return parts, F.pmod(F.xxhash64("cls"), parts).cast("int")


def near_pairs(buckets: DataFrame) -> DataFrame:
    """a < b of different components: each member of a part of a bucket with the first of it and with the `NEAR` before it."""
    order = Window.partitionBy("key", "part").orderBy("cls")
    who = F.struct("cls", "component")
    others = F.array(F.first(who).over(order.rowsBetween(Window.unboundedPreceding, 0)), *(F.lag(who, k).over(order) for k in range(1, NEAR + 1)))
    listed = buckets.withColumn("part", _part(F.col("n"))[1]).select("cls", "component", others.alias("others"))
    fit = F.filter("others", lambda x: x.isNotNull() & (x["cls"] < F.col("cls")) & (x["component"] != F.col("component")))
    return listed.select(F.explode(F.array_distinct(F.transform(fit, lambda x: x["cls"]))).alias("a"), F.col("cls").alias("b")).dropDuplicates(["a", "b"])


def _blocks(buckets: DataFrame) -> DataFrame:
    """Pairs of blocks of buckets: rows key, cls, n, component, small, each for all the pairs that its block is in."""
    parts, part = _part(F.col("n"))
    dealt = buckets.withColumn("blocks", parts).withColumn("block", part)
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "cls", "component", "small")


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different components that may be similar, by an upper bound: elements that agree in their first 16 bits."""
    cls, comp, block = (rows[c].to_numpy() for c in ("cls", "component", "block"))
    small = [np.frombuffer(x, dtype=np.uint16) for x in rows["small"]]
    size = np.array([len(x) for x in small])
    one, two = (np.flatnonzero(block == rows[c].iloc[0]) for c in ("one", "two"))
    same = rows["one"].iloc[0] == rows["two"].iloc[0]
    there = np.zeros(1 << 16, dtype=bool)
    joint = np.concatenate([small[j] for j in two])
    edge = np.concatenate([[0], np.cumsum(size[two])])[:-1]
    found = []
    for i in one:
        there[small[i]] = True
        both = np.minimum(np.add.reduceat(there[joint].astype(np.int64), edge), size[i])
        there[small[i]] = False
        may = (100 * both >= PERCENT * (size[i] + size[two] - both)) & (comp[two] != comp[i])
        if same:
            may &= cls[two] > cls[i]
        found += [(min(cls[i], c), max(cls[i], c)) for c in cls[two[may]]]
    return pd.DataFrame(found, columns=["a", "b"])


class Linker:
    """Estimates and confirms candidate pairs of classes."""

    def __init__(self, docs: DataFrame, classes: DataFrame) -> None:
        self.docs, self.classes = docs, classes

    def estimated(self, pairs: DataFrame) -> DataFrame:
        sig = self.classes.select("cls", "signature")
        estimate = F.pandas_udf(_estimate, "double")
        both = pairs.join(sig.select(F.col("cls").alias("a"), F.col("signature").alias("x")), "a").join(sig.select(F.col("cls").alias("b"), F.col("signature").alias("y")), "b")
        return both.filter(estimate("x", "y") >= LEAST_ESTIMATE).select("a", "b")

    def sets(self, names: DataFrame) -> DataFrame:
        """cls, own and small of the named classes: full sets, made again from the texts of the classes' first documents."""
        keys = names.join(self.classes.select("cls", F.col("set_key").alias("want")), "cls")
        texts = self.docs.select(F.col("doc_id").cast("long").alias("cls"), "text").join(keys, "cls")
        return materialise(texts.select("cls", "text", "want").mapInArrow(frugal(_full), "cls long, own binary, small binary").dropDuplicates(["cls"]), "minhash-sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs that are similar on their full sets."""
        if sets is None:
            sets = self.sets(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct())
        confirm = F.pandas_udf(_confirm, "boolean")
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("own").alias("y")), "b")
        return both.filter(confirm("x", "y")).select("a", "b")


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows_of(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["cls", "own", "small"])

    for batch in batches:
        rows = []
        want, names = batch.column(2), batch.column(0)
        for row, hashes in _sets(batch, 1):
            if _key(hashes) == want[row].as_py():  # another text may have the same doc_id
                rows.append((names[row].as_py(), hashes.tobytes(), (hashes >> np.uint64(48)).astype(np.uint16).tobytes()))
                if len(rows) >= 256:
                    yield rows_of(rows)
                    rows = []
        yield rows_of(rows)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached over the edges (a, b).

    Every round takes the least label among a node and its neighbours, and then that label's own label.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        one = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("after"))
        two = materialise(one.join(jump, "next", "left").select("node", "component", F.least("next", "after").alias("next")), "labels")
        changed = not two.filter(F.col("next") != F.col("component")).isEmpty()
        labels = two.select("node", F.col("next").alias("component"))
        if not changed:
            return labels


@tidy
def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    with small_batches(docs.sparkSession):
        return _link(docs).drop("text_key")


def _link(docs: DataFrame) -> DataFrame:
    """What `link` returns, and a hash of each document's text."""
    signed_rows = materialise(signatures(docs), "minhash-signatures")
    some = signed_rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    first = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands", "signature")).alias("m"), F.count(F.lit(1)).alias("n_rows"))
    classes = materialise(first.select("set_key", F.col("m.doc_id").alias("cls"), F.col("m.bands").alias("bands"), F.col("m.signature").alias("signature"), "n_rows"), "minhash-classes")
    linker = Linker(docs, classes)
    buckets = materialise(shared_buckets(classes), "minhash-buckets")
    # the hubs' links span most of each component; after them only pairs across components are needed
    edges = materialise(linker.confirmed(materialise(linker.estimated(hub_pairs(buckets)), "minhash-candidates")), "minhash-edges")
    labels = components(edges)
    several = materialise(open_buckets(buckets, labels), "minhash-open")
    sets = linker.sets(several.select("cls").distinct())
    near = materialise(linker.estimated(near_pairs(several)), "minhash-candidates")
    if not near.isEmpty():
        edges = edges.unionByName(materialise(linker.confirmed(near, sets), "minhash-edges"))
        labels = components(edges)
    large = open_buckets(several.filter(F.col("n") > NEAR + 1).drop("component"), labels).join(sets.select("cls", "small"), "cls")
    more = _blocks(large).groupBy("key", "one", "two").applyInPandas(_compare, "a long, b long").dropDuplicates(["a", "b"])
    rest = materialise(more.join(near, ["a", "b"], "left_anti"), "minhash-candidates")
    if not rest.isEmpty():
        edges = edges.unionByName(materialise(linker.confirmed(rest, sets), "minhash-edges"))
        labels = components(edges)
    final = classes.join(labels, classes["cls"] == labels["node"], "left").select("set_key", "n_rows", F.coalesce("component", "cls").alias("component_id"))
    linked = join_hot(some.select("doc_id", "text_key", "n_shingles", "set_key"), final, "set_key", "n_rows", "inner").select("doc_id", "text_key", "n_shingles", "component_id")
    alone = signed_rows.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select("doc_id", "text_key", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


@tidy
def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, one of each component: that of the least doc_id, and one row of it."""
    key, text_key, keep_key = free_names(docs, "id", "text_key", "keep_key")
    with small_batches(docs.sparkSession):
        linked = _link(docs).filter(F.col("kept") & F.col("doc_id").isNotNull())
        keep = materialise(linked.select(F.col("doc_id").alias(key), F.col("text_key").alias(keep_key)).distinct(), "minhash-kept")
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn(text_key, F.xxhash64("text"))
    chosen = named.join(keep, (F.col("doc_id").cast("long") == F.col(key)) & (F.col(text_key) == F.col(keep_key)), "left_semi")
    return chosen.dropDuplicates(["doc_id", text_key]).select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))
