import itertools

import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import toxicity

from . import brute

DOCS = "doc_id long, text string, lang string, toxic string"


def plain_marginals(emit, move, begin):
    """Forward-backward by its definition, a document at a time."""
    out = []
    cuts = [*np.flatnonzero(begin), len(emit)]
    for a, b in zip(cuts, cuts[1:]):
        f = np.zeros((b - a, 2))
        r = np.ones((b - a, 2))
        for t in range(b - a):
            f[t] = (f[t - 1] @ np.exp(move) if t else np.ones(2)) * [1, np.exp(emit[a + t])]
            f[t] /= f[t].sum()
        for t in range(b - a - 2, -1, -1):
            r[t] = np.exp(move) @ (r[t + 1] * [1, np.exp(emit[a + t + 1])])
            r[t] /= r[t].sum()
        p = f * r
        out += list(p[:, 1] / p.sum(1))
    return np.array(out)


def test_forward_backward():
    pick = np.random.default_rng(0)
    for n in (1, 2, 7, 50, 333):
        emit, move = pick.normal(0, 3, n), pick.normal(0, 1, (2, 2))
        begin = pick.random(n) < 0.1
        begin[0] = True
        assert np.allclose(toxicity.forward_backward(emit, move, begin), plain_marginals(emit, move, begin))


def brute_log_z(emit, move, begin):
    """The logarithm of the sum over all sequences of states, a document at a time."""
    cuts, total = [*np.flatnonzero(begin), len(emit)], 0.0
    for a, b in zip(cuts, cuts[1:]):
        each = []
        for states in itertools.product((0, 1), repeat=b - a):
            each.append(sum(emit[a + t] * s for t, s in enumerate(states)) + sum(move[x, y] for x, y in zip(states, states[1:])))
        total += np.log(np.exp(each).sum())
    return total


def test_expected_states_and_pairs_are_the_slope_of_log_z():
    pick = np.random.default_rng(1)
    for n in (1, 2, 9, 14):
        emit, move, begin = pick.normal(0, 2, n), pick.normal(0, 1, (2, 2)), pick.random(n) < 0.3
        begin[0] = True
        p, pairs = toxicity.forward_backward(emit, move, begin, pairs=True)
        slope = lambda bump: (brute_log_z(*bump(1e-5), begin) - brute_log_z(*bump(-1e-5), begin)) / 2e-5
        one = np.eye(n)
        assert np.allclose(p, [slope(lambda e, t=t: (emit + e * one[t], move)) for t in range(n)], atol=1e-6)
        cell = lambda i, j: np.outer(np.arange(2) == i, np.arange(2) == j)
        assert np.allclose(pairs, [[slope(lambda e: (emit, move + e * cell(i, j))) for j in range(2)] for i in range(2)], atol=1e-6)


def test_gradient_of_the_field(monkeypatch):
    pick = np.random.default_rng(2)
    lists = [list(pick.choice(4, pick.integers(0, 3), replace=False)) for _ in range(12)]
    target, begin = pick.random(12) < 0.4, np.arange(12) % 5 == 0
    token_of, feature_of = (np.array([(t, f)[k] for t, x in enumerate(lists) for f in x]) for k in range(2))
    field = toxicity.Field(token_of, feature_of, 4, target.astype(int), begin)
    monkeypatch.setattr(toxicity.Field, "BLOCK", 5)
    assert toxicity.Field(token_of, feature_of, 4, target.astype(int), begin).cuts == [0, 5, 10, 12] and field.cuts == [0, 12]
    field = toxicity.Field(token_of, feature_of, 4, target.astype(int), begin)
    weight, bias, move = pick.normal(0, 1, 4), 0.3, pick.normal(0, 1, (2, 2))

    def likelihood(weight, bias, move):
        emit = field.emit(weight, bias)
        own = emit[target].sum() + sum(move[int(target[t]), int(target[t + 1])] for t in range(11) if not begin[t + 1])
        return own - brute_log_z(emit, move, begin) - field.RIDGE / 2 * ((weight**2).sum() + (move**2).sum())

    grad_w, grad_b, grad_m, *_ = field.gradient(weight, bias, move)
    slope = lambda bump: (likelihood(*bump(1e-5)) - likelihood(*bump(-1e-5))) / 2e-5
    assert np.allclose(grad_w, [slope(lambda e, k=k: (weight + e * np.eye(4)[k], bias, move)) for k in range(4)], atol=1e-5)
    assert abs(grad_b - slope(lambda e: (weight, bias + e, move))) < 1e-5
    cell = lambda i, j: np.outer(np.arange(2) == i, np.arange(2) == j)
    assert np.allclose(grad_m, [[slope(lambda e: (weight, bias, move + e * cell(i, j))) for j in range(2)] for i in range(2)], atol=1e-5)


def test_words_beside_toxic_tokens_are_features():
    rows = [(f"some text {i} you utter badword here and more {i}", 1) for i in range(60)] + [(f"you some text {i} here and utter nothing more {i}", 0) for i in range(60)]
    assert any(f.startswith(("p:", "n:")) for f in toxicity.fit(rows).weights)


def test_the_sample_is_of_whole_texts_within_its_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i), "en", "t") for i in range(40)] + [(3, "a", "en", "t")] * 3, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, 1)], "doc_id long, toxic int")
    every = toxicity.training_rows(docs, labels)
    held = {i for i in range(40) if brute.crc(i) % 5 == 0}
    want = sorted([("a" if i == 3 else "x" * (10 + i), i % 2) for i in range(40) if i not in held] + ([("x" * 17, 1)] if 7 not in held else []))
    assert sorted(every) == want
    few = toxicity.training_rows(docs, labels, sample_bytes=100)
    assert 0 < len(few) < len(every) and set(few) <= set(every)
    assert all(sum(len(t) for t, y in set(few) if y == k) <= 100 for k in (0, 1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (brute.crc(r["doc_id"]) % 5 == 0) for r in rows)
    assert all((r["predicted"] == 1) == (r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9


def test_odd_rows_and_spans(spark):
    words = [f"word{i}" for i in range(50)]
    train = [(i, " ".join(words[k % 50] for k in range(i, i + 30)) + (" You Idiotic fool" if i % 3 == 0 else ""), "en", "x") for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(1, None)], "doc_id long, toxic int")
    odd = [(1000, None, None, "x"), (1001, "", "en", "x"), (1002, "word1 idiotic fool word2", "en", "x"), (1002, "word1 idiotic fool word2", "en", "x"), (None, "word3", "en", "x")]
    got = toxicity.score(spark.createDataFrame(train + odd, DOCS), labels).filter(F.col("doc_id").isNull() | (F.col("doc_id") >= 1000)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by[1002]["predicted"] == 1 and by[1002]["spans"] == "6:18"
    assert not any(by[i]["predicted"] for i in (1000, 1001, None))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(spark.createDataFrame(odd, DOCS), none).collect()} == {0.0}
    assert toxicity.score(spark.createDataFrame([], DOCS), labels).count() == 0


def test_a_long_text_leaves_room_for_the_others():
    rows = [("word " * 410_000, 0)] + [(f"some text {i} with badword in it and badword", 1) for i in range(60)] + [(f"some text {i} with nothing in it", 0) for i in range(60)]
    tagger = toxicity.fit(rows)
    marginal = tagger.marginals([toxicity.words("a text with badword in it")])[0]
    assert marginal[3] >= 0.5 and tagger.score(marginal) >= 0.5 and tagger.score(tagger.marginals([toxicity.words("a text with nothing in it")])[0]) < 0.5
