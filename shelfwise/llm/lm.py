"""Language-model scoring with a log-frequency Bloom filter.

Counts are exact and cover all training documents. Words are 64-bit hashes, counted as hashes: every task writes, for each
chunk of documents, one row for each segment of the hash space with its sorted hashes and counts as bytes, so a shuffle
moves few large rows and a segment is merged by NumPy. No segment grows with a hot word: a word comes once from a chunk.

The model is a bigram model with Dirichlet smoothing towards unigrams, p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU) with
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), whose counts come from the filter. A count c is stored as its level
1 + floor(log(c) / log(BASE)): the key is set once for each level up to it, with `PROBES` bits a level, and read by probing
level after level up to the first miss. The filter is blocked by the key's segment; a segment has the bits that its entries need, up to its
share of `FILTER_BYTES`, so what is broadcast has a fixed bound. Where a segment has more entries than its share of bits
holds, the bigrams of the lowest levels move to a second block, which stays with the segment's exact counts, is as large as
its entries need and is never broadcast. A bigram that misses the broadcast block of such a segment is dealt to the segment
and probed there, so but for false hits a score is the same however much was broadcast,
and what the model holds grows with the text. Words
always stay in the broadcast block: beyond some 50 million distinct ones, `FILTER_BYTES` has to grow with the vocabulary.

The base score needs the exact count of each word of each document. Words with at least N / FREQUENT occurrences, at most
`FREQUENT` of them, are broadcast; the other words of the documents are dealt by segment to the exact counts.

Defined results: null and empty texts are one end token; a null doc_id has no remainder, counts as training text and is
not held out; repeated rows are counted and scored as rows of their own; no training token gives N = 0, V = 0 and scores
from the smoothing alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, materialise, small_batches, unit_bucket
from .tokens import mix, words

FREQUENT = 1 << 17
FILTER_BYTES = 64 << 20
PROBES = 5
BASE = 2.0
MU = 40.0
SEGMENT_TOKENS = 1_000_000
#: Rows whose sums travel together; ids of rows are cut here.
BLOCK = 4096
#: A place in a block comes of a product of two numbers below 2 ** 32.
MOST_BITS = (1 << 32) - 64
#: The hash of the end token and the factor that makes a bigram's hash of its words'.
END = np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.uint64(0xD1342543DE82EF95)
PARTS = "kind int, segment int, hashes binary, counts binary"


def _with_ends(w) -> tuple[np.ndarray, np.ndarray]:
    """Words of consecutive documents with an end after each, and where each document's tokens begin."""
    n = w.count + 1
    bound = np.concatenate([[0], np.cumsum(n)])
    out = np.full(bound[-1], END, dtype=np.uint64)
    keep = np.ones(bound[-1], dtype=bool)
    keep[bound[1:] - 1] = False
    out[keep] = w.hashes
    return out, bound


def bigrams(tokens: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A key for each token and the one before it; the first of a document follows an end."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bound[:-1]] = END
    return mix(before * _PAIR + tokens)


def _segment(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def _cut(kind: int, hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Sorted hashes and their counts, cut by segment: the segments are ranges of the hash."""
    edges = np.searchsorted(_segment(hashes, bits), np.arange((1 << bits) + 1))
    for s in np.flatnonzero(np.diff(edges)):
        own = slice(edges[s], edges[s + 1])
        yield kind, int(s), hashes[own].tobytes(), counts[own].astype(np.uint32).tobytes()


def _count(bits: int, flush: int = 3_000_000):
    """Counts of the words and of the bigrams of about `flush` tokens at a time, cut by segment."""

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for kind in (1, 2):
            rows += _cut(kind, *np.unique(np.concatenate([x[kind - 1] for x in held]), return_counts=True), bits)
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for w in words(batch.column(0)):
                tokens, bound = _with_ends(w)
                held.append((tokens, bigrams(tokens, bound)))
                n += len(tokens)
                if n >= flush:
                    yield counted(held)
                    held, n = [], 0
        if held:
            yield counted(held)

    return run


def _rows(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["kind", "segment", "hashes", "counts"])


def _merge(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by hash, sorted by hash."""
    h = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in hashes])
    c = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in counts]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE(count))."""
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


#: What a level stands for: the middle of its counts, for a falling law of counts.
def level_count(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, np.where(level == 1, 1.0, BASE ** (level - 1) * 1.35), 0.0)


def _bit(keys: np.ndarray, level: int, probe: int, size: int | np.ndarray) -> np.ndarray:
    """The bit of a key at a level under one of the probes, in a block of `size` bits."""
    h = mix(keys ^ np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((h >> np.uint64(32)) * size) >> np.uint64(32)


def build_block(keys: np.ndarray, level: np.ndarray, most_bits: int, keep: np.ndarray | None = None) -> tuple[bytes, int]:
    """The bits of one segment of the filter, and the least level that it holds. keep: keys that stay whatever the space."""
    least = 1
    keep = np.zeros(len(keys), dtype=bool) if keep is None else keep
    while True:
        own = keep | (level >= least)
        size = int(level[own].sum() * PROBES / math.log(2))
        if size <= most_bits or not (own & ~keep).any():
            break
        least += 1
    size = max(64, min(size, most_bits) // 64 * 64)
    bits = np.zeros(size, dtype=bool)
    k, n = keys[own], level[own]
    for at in range(1, int(n.max(initial=0)) + 1):
        k, n = k[n >= at], n[n >= at]
        for probe in range(PROBES):
            bits[_bit(k, at, probe, np.uint64(size))] = True
    return np.packbits(bits, bitorder="little").tobytes(), least


class Filter:
    """All segments of the filter, side by side."""

    def __init__(self, blocks: dict[int, bytes], bits: int) -> None:
        self.bits = bits
        parts = [blocks.get(s, b"\0" * 8) for s in range(1 << bits)]
        self.sizes = np.array([8 * len(p) for p in parts], dtype=np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.uint64)
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: levels are probed from the first on, up to the first miss."""
        segment = _segment(keys, self.bits)
        start, size = self.starts[segment], self.sizes[segment]
        out = np.zeros(len(keys), dtype=np.int64)
        live = np.arange(len(keys))
        k = keys
        for at in range(1, 64):
            for probe in range(PROBES):
                place = start + _bit(k, at, probe, size)
                hit = (self.data[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                live, k, start, size = live[hit], k[hit], start[hit], size[hit]
                if not len(live):
                    return out
            out[live] = at
        return out


class Model:
    """Exact totals, exact counts of frequent words, the filter, and whether bigrams of a segment are held outside of it."""

    def __init__(self, tokens: int, distinct: int, frequent: np.ndarray, counts: np.ndarray, table: Filter, moved: np.ndarray) -> None:
        self.tokens, self.distinct = tokens, distinct
        self.frequent, self.counts, self.table, self.moved = frequent, counts, table, moved

    def exact(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a token is frequent, and its count."""
        if not len(self.frequent):
            return np.zeros(len(tokens), dtype=bool), np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        known = self.frequent[at] == tokens
        return known, np.where(known, self.counts[at], 0)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def score(self, tokens: np.ndarray, bound: np.ndarray, known: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """log10 of p(token | token before it) by the filter; where a segment has to be asked too, the token's place, the
        bigram's key, the word's count and the most that the bigram's can be."""
        uni = np.where(known, exact, 0).astype(np.float64)
        rare = np.flatnonzero(~known)
        uni[rare] = level_count(self.table.level(tokens[rare]))
        before = np.empty_like(uni)
        before[1:] = uni[:-1]
        ends = self.exact(np.array([END], dtype=np.uint64))[1][0]
        before[bound[:-1]] = ends
        # a bigram is at most as frequent as its words: only where both were seen can it be there
        pair = np.zeros(len(tokens))
        may = np.flatnonzero((uni > 0) & (before > 0))
        keys = bigrams(tokens, bound)[may]
        pair[may] = level_count(self.table.level(keys))
        most = np.minimum(uni, before)
        pair = np.minimum(pair, most)
        open_ = np.flatnonzero((pair[may] == 0) & self.moved[_segment(keys, self.table.bits)])
        asked = may[open_], keys[open_], uni[may[open_]].astype(np.float32), most[may[open_]].astype(np.float32)
        return np.log10((pair + MU * self.unigram(uni)) / (before + MU)), asked


SCORED = "kind int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, segment int, hashes binary, docs binary, words binary, most binary"


def _asked(kind: int, bits: int, keys: np.ndarray, docs: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """One row for each segment: its keys, the rows they come from, and what else goes with a key."""
    order = np.argsort(keys, kind="stable")
    keys, docs, *more = (x[order] for x in (keys, docs, *more))
    edges = np.searchsorted(_segment(keys, bits), np.arange((1 << bits) + 1))
    own = np.flatnonzero(np.diff(edges))
    m = len(own)
    cut = lambda x: pa.array([x[edges[s] : edges[s + 1]].tobytes() for s in own], pa.binary())
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    rest = [cut(x) for x in more] or [pa.nulls(m, pa.binary())] * 2
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), *(pa.nulls(m, k) for k in kinds), pa.array(own.astype(np.int32)), cut(keys), cut(docs), *rest], names=_NAMES)


def _score(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            row_ids = np.asarray(batch.column(3))
            for w in words(batch.column(2)):
                tokens, bound = _with_ends(w)
                n = len(w.count)
                known, counts = model.exact(tokens)
                logs = np.where(known, np.log10(model.unigram(counts)), 0.0)
                at = slice(w.first, w.first + n)
                none = pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(4))
                scores, (place, *asked) = model.score(tokens, bound, known, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(n, np.int32)), pa.array(row_ids[at]), batch.column(0)[at], batch.column(1)[at], pa.array(np.diff(bound)),
                        pa.array(np.add.reduceat((known & (counts > 0)).astype(np.int64), bound[:-1])), pa.array(np.add.reduceat(logs, bound[:-1])),
                        pa.array(np.add.reduceat(scores, bound[:-1])), *none,
                    ],
                    names=_NAMES,
                )
                owner = row_ids[w.first + np.repeat(np.arange(n), np.diff(bound))]
                yield _asked(1, bits, tokens[~known], owner[~known])
                if len(place):
                    yield _asked(2, bits, asked[0], owner[place], *asked[1:])

    return run


_NAMES = [x.split()[0] for x in SCORED.split(", ")]


def _joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=kind) for x in column]) if len(column) else np.empty(0, kind)


def _lookup(tokens: int, distinct: int):
    """Sums of what the rare words and the moved bigrams of a segment add to their rows, packed by block of rows."""
    weight = tokens + 0.5 * (distinct + 1)

    def run(asked: pd.DataFrame, exact: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"block": pd.Series([], dtype=np.int64), "rows": [], "known": [], "parts": [], "gains": []})
        single, pairs = asked[asked["kind"] == 1], asked[asked["kind"] == 2]
        keys, rows = _joined(single["hashes"], np.uint64), _joined(single["docs"], np.int64)
        count = np.zeros(len(keys), dtype=np.int64)
        gain, pair_rows = np.empty(0), _joined(pairs["docs"], np.int64)
        if len(exact):
            h = np.frombuffer(exact["hashes"].iloc[0], dtype=np.uint64)
            c = np.frombuffer(exact["counts"].iloc[0], dtype=np.uint32)
            if len(h):
                at = np.minimum(np.searchsorted(h, keys), len(h) - 1)
                count = np.where(h[at] == keys, c[at].astype(np.int64), 0)
            level = Filter({0: exact["rest"].iloc[0]}, 0).level(_joined(pairs["hashes"], np.uint64))
            uni, most = (_joined(pairs[x], np.float32).astype(np.float64) for x in ("words", "most"))
            gain = np.log10(1 + np.minimum(level_count(level), most) / (MU * (uni + 0.5) / weight))
        part = np.log10((count + 0.5) / weight)
        row, where = np.unique(np.concatenate([rows, pair_rows]), return_inverse=True)
        own, other = where[: len(rows)], where[len(rows) :]
        sums = ("rows", row), ("known", np.bincount(own, count > 0, len(row)).astype(np.int64)), ("parts", np.bincount(own, part, len(row))), ("gains", np.bincount(other, gain, len(row)))
        edges = np.flatnonzero(np.diff(row // BLOCK, prepend=-1))
        cuts = [slice(i, j) for i, j in zip(edges, [*edges[1:], len(row)])]
        return pd.DataFrame({"block": row[edges] // BLOCK, **{name: [x[c].tobytes() for c in cuts] for name, x in sums}})

    return run


def _sum_block(blobs: pd.DataFrame) -> pd.DataFrame:
    """The sums of one block's rows over all segments."""
    rows, known = (_joined(blobs[c], np.int64) for c in ("rows", "known"))
    row, where = np.unique(rows, return_inverse=True)
    part, gain = (np.bincount(where, _joined(blobs[c], np.float64), len(row)) for c in ("parts", "gains"))
    return pd.DataFrame({"row": row, "known": np.bincount(where, known, len(row)).astype(np.int64), "part": part, "gain": gain})


def _reduce(bits: int, most_bits: int):
    """A segment's words with their exact counts, its totals, its block of the filter, and the block of the bigrams that don't fit."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        segment = int(rows["segment"].iloc[0])
        uni, bi = rows[rows["kind"] == 1], rows[rows["kind"] == 2]
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        h, c = _merge(list(uni["hashes"]), list(uni["counts"])) if len(uni) else none
        k, n = _merge(list(bi["hashes"]), list(bi["counts"])) if len(bi) else none
        level = levels(n)
        block, least = build_block(np.concatenate([h, k]), np.concatenate([levels(c), level]), most_bits, np.arange(len(h) + len(k)) < len(h))
        rest = build_block(k[level < least], level[level < least], MOST_BITS)[0]
        return pd.DataFrame({"segment": [segment], "tokens": [int(c.sum())], "distinct": [len(h)], "hashes": [h.tobytes()], "counts": [c.astype(np.uint32).tobytes()], "block": [block], "least": [least], "rest": [rest]})

    return run


def train(docs: DataFrame, n_tokens: int, filter_bytes: int = FILTER_BYTES) -> tuple[Model, DataFrame, int]:
    """The model, the exact counts by segment, and the bits of a segment's number."""
    bits = min(16, max(4, math.ceil(math.log2(max(1, n_tokens / SEGMENT_TOKENS)))))
    most = filter_bytes * 8 >> bits
    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count(bits), PARTS)
    counted = materialise(parts.groupBy("segment").applyInPandas(_reduce(bits, most), "segment int, tokens long, distinct long, hashes binary, counts binary, block binary, least int, rest binary"), "lm-counts")
    tokens, distinct = (x or 0 for x in counted.agg(F.sum("tokens"), F.sum("distinct")).first())
    blocks, moved = {}, np.zeros(1 << bits, dtype=bool)
    for r in counted.select("segment", "block", "least").toLocalIterator():  # `filter_bytes` at most
        blocks[r["segment"]], moved[r["segment"]] = bytes(r["block"]), r["least"] > 1
    least = max(2, tokens // FREQUENT)  # so at most FREQUENT words are that frequent
    found = counted.select("hashes", "counts").mapInPandas(_frequent(least), "hash long, n long").toPandas()
    frequent = found["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    return Model(tokens, distinct, frequent[order], found["n"].to_numpy(np.int64)[order], Filter(blocks, bits), moved), counted.select("segment", "hashes", "counts", "rest"), bits


def _frequent(least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for h, c in zip(frame["hashes"], frame["counts"]):
                c = np.frombuffer(c, dtype=np.uint32)
                own = c >= least
                yield pd.DataFrame({"hash": np.frombuffer(h, dtype=np.uint64)[own].view(np.int64), "n": c[own].astype(np.int64)})

    return run


def score(docs: DataFrame, held_out: int = 1, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; `filter_bytes` is what is broadcast at most."""
    with small_batches(docs.sparkSession, rows=2000):
        return _scored(docs, held_out, filter_bytes)


def _scored(docs: DataFrame, held_out: int, filter_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(unit_bucket(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out"), "text")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model, counted, bits = train(keyed.filter(~F.col("held_out")), size // 6, filter_bytes)
    shared = spark.sparkContext.broadcast(model)
    rows = keyed.withColumn("row", F.monotonically_increasing_id())
    both = materialise(rows.mapInArrow(_score(shared, bits), SCORED), "lm-scored")
    rare = both.filter("kind > 0").select("segment", "kind", "hashes", "docs", "words", "most").groupBy("segment").cogroup(counted.groupBy("segment"))
    blobs = rare.applyInPandas(_lookup(model.tokens, model.distinct), "block long, rows binary, known binary, parts binary, gains binary")
    parts = blobs.groupBy("block").applyInPandas(_sum_block, "row long, known long, part double, gain double")
    own = both.filter("kind = 0").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
    joined = own.join(materialise(parts, "lm-rare"), "row", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("part", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
