"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give scores and offsets.

Labels mark documents, so tokens are labelled first: a feature of words (a word, or its beginning of some length) is an
indicator if training documents that are toxic hold it far more often than the others do, and in different places, not in
a passage that these documents share; in toxic training documents the tokens with an indicator are labelled toxic, all other tokens are labelled clean. Words that
stand beside such tokens far more often than elsewhere are features of their neighbours. On these labels
the field, of two states with weights for token features and for transitions, is fitted by penalised maximum likelihood:
the gradient takes the expected features and the expected pairs of neighbouring states from forward-backward.

Forward-backward gives each token's marginal. A document's score is a logistic function, fitted on the training
documents, of its largest marginal and of the sum of its marginals. Runs of tokens with a marginal of a half and more are
the offending spans (code points, end exclusive).

Training takes the labelled documents with the least hashes, at most `SAMPLE` toxic and `SAMPLE` others, and of each of
the two kinds, in that order, those that together have at most `SAMPLE_BYTES` of text: that bound is what keeps the model's
cost and the driver's memory fixed. The field is fitted on the whole texts of all of them. Scoring covers whole texts of
all documents.

Defined results: null and empty texts have no tokens and get the score of a document without toxic tokens; with no
toxic or no clean training document all scores are 0; null labels are not used; a document with several labels counts as
often as it has them, with the least of its texts if rows share its doc_id; null doc_ids are never held out; repeated rows
are scored alike; an empty table gives an empty result; other columns are ignored by `score` and kept by `clean`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bound_batches, documents, frugal, materialise, tidy, unit_bucket

SAMPLE = 1200
SAMPLE_BYTES = 4 << 20
PREFIXES = (4, 5, 6, 7, 8)
#: An indicator is so many times likelier in toxic documents, with at least this log-likelihood ratio (G squared).
LEAST_RATIO, LEAST_G = 5.0, 16.0
#: An indicator must be found in so many different places (other words up to `APART` before it), and a word that is a feature of its neighbours so often beside toxic tokens.
LEAST_FOUND = 8
APART = 5
LEAST_BESIDE = 20
HELD_OUT = 0
_TOKEN = re.compile(r"[^\W_]+")
RESULT = "doc_id long, held_out boolean, score double, predicted int, spans string"


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return ["w:" + word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n)]


def forward_backward(emit: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Marginal of state 1 for a stream of tokens; begin marks the first token of each document.

    emit: what state 1 has over state 0; move: (2, 2) transition weights. The stream is cut into columns that are worked
    off side by side: each column's product of transfer matrices is found first, then the messages that enter it.
    With `pairs`, also the (2, 2) expected numbers of neighbouring states inside documents.
    """
    n = len(emit)
    if not n:
        return (np.empty(0), np.zeros((2, 2))) if pairs else np.empty(0)
    width = max(1, int(np.sqrt(n)))
    length = -(-n // width)
    pad = length * width - n
    up = np.exp(np.clip(np.concatenate([emit, np.zeros(pad)]), -30, 30)).reshape(width, length).T  # (length, width)
    new = np.concatenate([begin, np.ones(pad, dtype=bool)]).reshape(width, length).T
    m = np.exp(move)
    # messages are kept as the two states' values; a new document forgets what was before
    m00, m01, m10, m11 = (np.where(new, 1.0, x) for x in m.reshape(-1))

    def ahead_step(x0: np.ndarray, x1: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        y0, y1 = x0 * m00[t] + x1 * m10[t], (x0 * m01[t] + x1 * m11[t]) * up[t]
        total = y0 + y1
        return y0 / total, y1 / total

    def back_step(x0: np.ndarray, x1: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        x1 = x1 * up[t]
        y0, y1 = x0 * m00[t] + x1 * m01[t], x0 * m10[t] + x1 * m11[t]
        total = y0 + y1
        return y0 / total, y1 / total

    def through(step, order: range) -> np.ndarray:
        """Each column's transfer matrix, up to a factor: rows by the state that enters."""
        rows = np.array([[np.ones(width), np.zeros(width)], [np.zeros(width), np.ones(width)]])
        scale = np.zeros((2, width))  # of each row, in logarithms: steps norm each row by itself
        for t in order:
            for r in range(2):
                x0, x1 = rows[r]
                if step is ahead_step:
                    y0, y1 = x0 * m00[t] + x1 * m10[t], (x0 * m01[t] + x1 * m11[t]) * up[t]
                else:
                    x1 = x1 * up[t]
                    y0, y1 = x0 * m00[t] + x1 * m01[t], x0 * m10[t] + x1 * m11[t]
                total = y0 + y1
                rows[r] = y0 / total, y1 / total
                scale[r] += np.log(total)
        return rows * np.exp(scale - scale.max(axis=0))[:, None, :]

    ahead, behind = np.empty((2, length, width)), np.empty((2, length, width))
    whole = through(ahead_step, range(length))
    enter, now = np.empty((2, width)), np.full(2, 0.5)
    for c in range(width):
        enter[:, c] = now
        now = now @ whole[:, :, c]
        now = now / now.sum()
    x0, x1 = enter
    for t in range(length):
        x0, x1 = ahead_step(x0, x1, t)
        ahead[0, t], ahead[1, t] = x0, x1
    # what comes after a token: behind(t) = m . (up(t + 1) * behind(t + 1)), ones before a new document
    whole = through(back_step, range(length - 1, -1, -1))
    leave, now = np.empty((2, width)), np.full(2, 0.5)
    for c in range(width - 1, -1, -1):
        leave[:, c] = now
        now = now @ whole[:, :, c]
        now = now / now.sum()
    x0, x1 = leave
    for t in range(length - 1, -1, -1):
        behind[0, t], behind[1, t] = x0, x1
        x0, x1 = back_step(x0, x1, t)
    flat = lambda x: x.T.reshape(-1)[:n]
    f0, f1, b0, b1 = flat(ahead[0]), flat(ahead[1]), flat(behind[0]), flat(behind[1])
    p = f1 * b1 / (f0 * b0 + f1 * b1)
    if not pairs:
        return p
    u, inner = flat(up), ~begin[1:]
    after = b0[1:][inner], (b1 * u)[1:][inner]
    joint = np.array([[f[:-1][inner] * m[i, j] * after[j] for j in range(2)] for i, f in enumerate((f0, f1))])
    return p, (joint / joint.sum(axis=(0, 1))).sum(axis=2) if joint.size else np.zeros((2, 2))


class Tagger:
    """The fitted field: feature weights, transitions, and the logistic function of a document's marginals."""

    def __init__(self, weights: dict[str, float], bias: float, move: np.ndarray, final: np.ndarray) -> None:
        self.weights, self.bias, self.move, self.final = weights, bias, move, final

    def emissions(self, tokens: list[str], begin: np.ndarray) -> np.ndarray:
        """What each token's features give: those of the word itself, of the word before it and of the word after it."""
        get = self.weights.get
        coded = pa.array(tokens, pa.large_string()).dictionary_encode()
        words, ids = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        own = np.array([sum([get(f, 0.0) for f in features(w)]) for w in words])
        out = self.bias + own[ids]
        inner = ~begin[1:]
        for kind, to, of in (("p:", slice(1, None), slice(None, -1)), ("n:", slice(None, -1), slice(1, None))):
            near = np.array([get(kind + w, 0.0) for w in words])
            if near.any():
                out[to] += np.where(inner, near[ids[of]], 0.0)
        return out

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        count = np.array([len(d) for d in docs], dtype=np.int64)
        tokens = [w for d in docs for w in d]
        start = np.concatenate([[0], np.cumsum(count)])
        begin = np.zeros(len(tokens), dtype=bool)
        begin[start[:-1][count > 0]] = True
        stream = forward_backward(self.emissions(tokens, begin), self.move, begin) if tokens else np.empty(0)
        return np.split(stream, start[1:-1]) if len(docs) else []

    @staticmethod
    def summary(marginal: np.ndarray) -> tuple[float, float]:
        return (float(marginal.max()), float(np.log1p(marginal.sum()))) if len(marginal) else (0.0, 0.0)

    def score(self, marginal: np.ndarray) -> float:
        top, total = self.summary(marginal)
        return float(1 / (1 + np.exp(-np.clip(self.final @ [1.0, top, total], -50, 50))))


def words(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _indicators(in_toxic: Counter, in_clean: Counter, n1: int, n0: int) -> set[str]:
    """Features that n1 things of one kind hold far more often than n0 of the other."""
    out = set()
    for f, n in in_toxic.items():
        m = in_clean[f]
        expected = (n + m) * n1 / (n1 + n0)
        g = 2 * (n * np.log(n / expected) + (m * np.log(m / (n + m - expected)) if m else 0))
        if n * n0 >= LEAST_RATIO * m * n1 and n > expected and g >= LEAST_G:
            out.add(f)
    return out


class Field:
    """The training tokens of a field as arrays, and the gradient of its penalised likelihood.

    token_of, feature_of: pairs of a token and a feature that it has; target: the token's label. Expectations are summed
    over blocks of whole documents, of about `BLOCK` tokens, so that messages of few tokens are held at a time.
    """

    RIDGE = 0.05
    BLOCK = 200_000

    def __init__(self, token_of: np.ndarray, feature_of: np.ndarray, n_features: int, target: np.ndarray, begin: np.ndarray) -> None:
        self.token_of, self.feature_of, self.n_features, self.target, self.begin = token_of, feature_of, n_features, target, begin
        self.n = len(target)
        inner = ~begin[1:]
        self.seen_move = np.bincount(2 * target[:-1][inner] + target[1:][inner], minlength=4).reshape(2, 2).astype(float)
        self.seen_feature = np.bincount(feature_of, target[token_of], n_features)
        self.held = np.bincount(feature_of, minlength=n_features)
        ends, self.cuts = np.append(np.flatnonzero(begin)[1:], self.n), [0]
        while self.cuts[-1] < self.n:
            last = np.searchsorted(ends, self.cuts[-1] + self.BLOCK, side="right") - 1
            self.cuts.append(int(ends[max(last, np.searchsorted(ends, self.cuts[-1], side="right"))]))

    def emit(self, weight: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.token_of, weight[self.feature_of], self.n)

    def gradient(self, weight: np.ndarray, bias: float, move: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
        """Of the weights, the bias and the transitions; and the marginals and expected pairs that it comes from."""
        emit, p, pairs = self.emit(weight, bias), np.empty(self.n), np.zeros((2, 2))
        for a, b in zip(self.cuts, self.cuts[1:]):
            p[a:b], own = forward_backward(emit[a:b], move, self.begin[a:b], pairs=True)
            pairs += own
        grad_w = self.seen_feature - np.bincount(self.feature_of, p[self.token_of], self.n_features) - self.RIDGE * weight
        return grad_w, self.target.sum() - p.sum(), self.seen_move - pairs - self.RIDGE * move, p, pairs


def fit(rows: list[tuple[str | None, int]], rounds: int = 25) -> Tagger | None:
    """A tagger from (text, label) rows; None if a class is missing."""
    labels = np.array([y for _, y in rows])
    if not (labels == 1).any() or not (labels == 0).any():
        return None
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], dtype=np.int32) for t, _ in rows]
    names = list(vocabulary)
    stream, count = np.concatenate(docs), np.array([len(d) for d in docs])
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    none = Tagger({}, -10.0, np.zeros((2, 2)), np.array([np.log(n1 / n0), 0.0, 0.0]))
    once = {(d.tobytes(), int(y)): d for d, y in zip(docs, labels)}  # copies of a text tell no more than one
    in_toxic, in_clean = Counter(), Counter()
    for (_, y), d in once.items():
        if y:
            in_toxic.update({f for w in np.unique(d) for f in features(names[w])})
    for (_, y), d in once.items():
        if not y:
            in_clean.update({f for w in np.unique(d) for f in features(names[w]) if f in in_toxic})
    likely = _indicators(in_toxic, in_clean, n1, n0)
    # a passage that many documents share has the same words about each of its words: these tell of the passage alone
    spread = np.zeros(len(names), dtype=np.int64)
    toxic, place = np.repeat(labels == 1, count), np.arange(len(stream)) - np.repeat(np.cumsum(count) - count, count)
    for far in range(1, min(APART, len(stream) - 1) + 1):
        own = np.flatnonzero(toxic & (place >= far))
        pairs = np.unique(stream[own - far].astype(np.int64) * len(names) + stream[own])
        spread = np.maximum(spread, np.bincount(pairs % len(names), minlength=len(names)))
    places: Counter = Counter()
    for w in np.flatnonzero(spread):
        for f in features(names[w]):
            if f in likely:
                places[f] += int(spread[w])
    index = {f: i for i, f in enumerate(sorted(f for f in likely if places[f] >= max(LEAST_FOUND, in_toxic[f] / 2)))}
    del once, in_toxic, in_clean, places
    if not index:
        return none
    begin = np.zeros(len(stream), dtype=bool)
    begin[(np.cumsum(count) - count)[count > 0]] = True
    of_word = [[index[f] for f in features(w) if f in index] for w in names]
    held = np.array([len(x) for x in of_word])
    hot = np.flatnonzero(held[stream])
    token_of = [np.repeat(hot, held[stream[hot]])]
    feature_of = [np.array([f for w in stream[hot] for f in of_word[w]], dtype=np.int64)]
    target = np.zeros(len(stream), dtype=np.int64)
    target[hot] = np.repeat(labels == 1, count)[hot]
    # words, no indicators themselves, that stand before or after a toxic token far more often than beside others
    inside = np.flatnonzero(~begin[1:])  # pairs of neighbours i, i + 1
    for kind, own, other in (("p:", inside + 1, inside), ("n:", inside, inside + 1)):
        beside, marked = stream[other], target[own] == 1
        near = np.bincount(beside[marked], minlength=len(names)) * (held == 0)
        far = np.bincount(beside[~marked], minlength=len(names))
        marks = _indicators(Counter({w: int(near[w]) for w in np.flatnonzero(near >= LEAST_BESIDE)}), Counter({w: int(far[w]) for w in np.flatnonzero(near)}), int(marked.sum()), int((~marked).sum())) if marked.any() and not marked.all() else set()
        number = np.full(len(names), -1)
        for w in sorted(marks):
            number[w] = index[kind + names[w]] = len(index)
        has = number[beside] >= 0
        token_of.append(own[has])
        feature_of.append(number[beside[has]])
    field = Field(np.concatenate(token_of), np.concatenate(feature_of), len(index), target, begin)
    weight, bias, move = np.zeros(len(index)), -4.0, np.zeros((2, 2))
    slope_w, slope_b, slope_m = np.zeros(len(index)), 0.0, np.zeros((2, 2))
    for _ in range(rounds):  # gradient steps, scaled by each weight's own curvature, with momentum
        grad_w, grad_b, grad_m, p, pairs = field.gradient(weight, bias, move)
        slope_w = 0.7 * slope_w + grad_w / (1 + 0.25 * field.held)
        slope_b = 0.7 * slope_b + grad_b / (1 + 0.25 * (p * (1 - p)).sum() + 0.02 * field.n)
        slope_m = 0.7 * slope_m + grad_m / (50 + 0.25 * np.maximum(pairs, field.seen_move) * 4)
        weight += 0.5 * slope_w
        bias += 0.5 * slope_b
        move += 0.2 * np.clip(slope_m, -1, 1)
    tagger = Tagger({f: float(weight[i]) for f, i in index.items() if abs(weight[i]) > 1e-4}, float(bias), move, np.zeros(3))
    whole = (m for k in range(0, len(docs), 100) for m in tagger.marginals([[names[w] for w in d] for d in docs[k : k + 100]]))
    x = np.array([[1.0, *Tagger.summary(m)] for m in whole])
    tagger.final = _logistic(x, labels)
    return tagger


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 0.1 * np.eye(len(w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - 0.1 * w)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str | None, int]]:
    """Texts and labels of documents that are not held out, by the least hash of doc_id: at most `sample` of each class, and
    of these, as whole texts, at most `sample_bytes` for each class (texts that don't fit any more are passed over)."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.coalesce(unit_bucket(F.col("doc_id")) != held_out, F.lit(False))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (1, 0)]
    names = picked[0].unionByName(picked[1]).groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("times"))  # 2 * sample rows at most
    found = docs.select("doc_id", "text").join(F.broadcast(names), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"), F.max("times").alias("times"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = materialise(found, "toxicity-sample").withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    fits = rows.withColumn("bytes", F.when(F.col("bytes") <= sample_bytes, F.col("bytes"))).withColumn("total", F.sum("bytes").over(order))
    kept = fits.filter(F.col("bytes").isNotNull() & (F.col("total") <= sample_bytes)).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
    return [(r["text"], r["toxic"]) for r in kept.select("text", "toxic", "times").toLocalIterator() for _ in range(r["times"])]


def spans_of(text: str, marginal: np.ndarray) -> list[tuple[int, int]]:
    """Offsets of the runs of tokens with a marginal of a half or more."""
    hot = np.flatnonzero(marginal >= 0.5)
    if not len(hot):
        return []
    # lower() may change a text's length: offsets are of the tokens of the text itself, matched in order
    places = [m.span() for m in _TOKEN.finditer(text)]
    if len(places) != len(marginal):
        places = [m.span() for m in _TOKEN.finditer(text.lower())]
    out = []
    for i in hot:
        if out and out[-1][2] == i - 1:
            out[-1] = (out[-1][0], places[i][1], i)
        else:
            out.append((places[i][0], places[i][1], i))
    return [(b, e) for b, e, _ in out]


@tidy
def score(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (begin:end, comma-joined) of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(training_rows(docs, labels, held_out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            for at in _slices(batch.column(2)):
                part = batch.slice(at.start, at.stop - at.start)
                texts = part.column(2).to_pylist()
                if tagger is None:
                    points, spans = [0.0] * len(texts), [""] * len(texts)
                else:
                    marginals = tagger.marginals([words(t) for t in texts])
                    points = [tagger.score(m) for m in marginals]
                    spans = [",".join(f"{b}:{e}" for b, e in spans_of(t, m)) if t else "" for t, m in zip(texts, marginals)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(points), pa.array([int(p >= 0.5) for p in points], pa.int32()), pa.array(spans, pa.string())],
                    names=["doc_id", "held_out", "score", "predicted", "spans"],
                )

    bound_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(unit_bucket(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out"), "text")
    return keyed.mapInArrow(frugal(run), RESULT)


@tidy
def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted to be toxic. Texts are scored where they are read."""
    tagger = fit(training_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            for part in _slices(batch.column(at)):
                rows = batch.slice(part.start, part.stop - part.start)
                if tagger is not None:
                    marginals = tagger.marginals([words(t) for t in rows.column(at).to_pylist()])
                    rows = rows.filter(pa.array([tagger.score(m) < 0.5 for m in marginals], pa.bool_()))
                yield rows

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(frugal(run), docs.schema)


def _slices(column: pa.Array, size: int = 2 << 20) -> Iterator[slice]:
    """Rows in runs of about `size` bytes of text."""
    each = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    begin, held = 0, 0
    for i, n in enumerate(each):
        if held and held + n > size:
            yield slice(begin, i)
            begin, held = i, 0
        held += int(n)
    if begin < len(each):
        yield slice(begin, len(each))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
