import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from shelfwise.llm import lm
from shelfwise.llm.tokens import words

from . import brute

DOCS = "doc_id long, text string, source string"


def base(rows):
    toks = {i: [*brute.words(brute.lower(t or "")), None] for i, t in rows}
    count = Counter(w for i, ws in toks.items() if brute.crc(i) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    return {i: (brute.crc(i) % 5 == 1, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in toks.items()}


def test_base_score_and_gain(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 200)  # so that both ways to a count are taken
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(5000, ""), (5001, None), (5002, "A a"), (5003, "the the the")]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)).collect()}
    want = base(rows)
    assert set(got) == set(want)
    for i, (held, n, known, train, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert abs(r["base_score"] - score) < 1e-6 * abs(score) + 1e-9
    held = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_filter_reads_levels_back():
    pick = np.random.default_rng(1)
    keys = pick.integers(0, 2**64, 20000, dtype=np.uint64)
    level = pick.integers(1, 8, 20000)
    block = {int(s): lm.build_block(keys[lm._segment(keys, 3) == s], level[lm._segment(keys, 3) == s], 1 << 22)[0] for s in range(8)}
    table = lm.Filter(block, 3)
    got = table.level(keys)
    assert (got >= level).all() and (got == level).mean() > 0.9
    others = pick.integers(0, 2**64, 20000, dtype=np.uint64)
    assert (table.level(others) > 0).mean() < 0.06


def test_filter_keeps_its_bound():
    keys = np.arange(100000, dtype=np.uint64)
    block, least = lm.build_block(keys, np.where(keys < 1000, 3, 1), 80_000)
    assert len(block) <= 10_000 and least == 2


def scores(texts, most_bits):
    """Scores by document of the model of the same texts, in this process."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    counted = lm._reduce(0, most_bits)(pd.concat(b.to_pandas() for b in lm._count(0)(iter([batch]))))
    own = counted.iloc[0]
    tokens, distinct, none = int(own["tokens"]), int(own["distinct"]), np.empty(0, np.uint64)
    model = lm.Model(tokens, distinct, none, np.empty(0, np.int64), lm.Filter({0: own["block"]}, 0), np.array([own["least"] > 1]))
    out = np.zeros(len(texts))
    for w in words(batch.column(0)):
        t, bound = lm._with_ends(w)
        logs, (place, *asked) = model.score(t, bound, np.zeros(len(t), dtype=bool), np.zeros(len(t), dtype=np.int64))
        out[w.first : w.first + len(w.count)] += np.add.reduceat(logs, bound[:-1])
        if len(place):
            owner = w.first + np.repeat(np.arange(len(w.count)), np.diff(bound))
            blobs = lm._lookup(tokens, distinct)(lm._asked(2, 0, asked[0], owner[place], *asked[1:]).to_pandas(), counted)
            sums = lm._sum_block(blobs)
            out[sums["row"]] += sums["gain"]
    return out, own["least"]


def test_moved_bigrams_are_still_found(monkeypatch):
    monkeypatch.setattr(lm, "PROBES", 24)  # no false hits, which the two ways would not share
    pick = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in pick.zipf(1.4, 300) % 900) for _ in range(40)] + ["", "w1 w2", "w1"]
    whole, least = scores(texts, 1 << 26)
    assert least == 1
    for most_bits in (200_000, 120_000):
        cut, least = scores(texts, most_bits)
        assert least > 1
        np.testing.assert_allclose(cut, whole, rtol=1e-6)


def test_score_with_a_small_filter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    whole, cut = ({r["doc_id"]: r for r in lm.score(docs, filter_bytes=n).collect()} for n in (lm.FILTER_BYTES, 40_000))
    assert lm.train(docs, 1000, 40_000)[0].moved.any() and not lm.train(docs, 1000)[0].moved.any()
    assert set(whole) == set(cut)
    for i, r in whole.items():
        assert abs(r["score"] - cut[i]["score"]) < 0.05 * abs(r["score"])  # false hits differ
        assert abs(r["base_score"] - cut[i]["base_score"]) < 1e-6 * abs(r["base_score"])


def test_odd_tables(spark):
    assert lm.score(spark.createDataFrame([], DOCS)).count() == 0
    got = lm.score(spark.createDataFrame([(None, "a b", "s"), (None, None, "s"), (3, "a", "s"), (3, "a", "s")], DOCS)).collect()
    assert len(got) == 4 and all(r["base_score"] < 0 and r["score"] < 0 for r in got)
