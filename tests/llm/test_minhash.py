import random

import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import minhash, tokens

from . import brute

DOCS = "doc_id long, text string, source string, set_key string, component string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", None) for i, t in rows], DOCS)


def family(seed, n, words, change):
    """A text and n - 1 variants of it, each with some words changed."""
    pick = random.Random(seed)
    first = [f"w{seed}x{pick.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(first)]
    for _ in range(n - 1):
        own = list(first)
        for k in pick.sample(range(words), change):
            own[k] = f"v{pick.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def found(spark, table):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.link(table).collect()}


def test_against_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(family(1, 30, 200, 2) + family(2, 12, 60, 1) + family(3, 40, 300, 8))]
    rows += [(2000, ""), (2001, None), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, "É two"), (2006, "é two")]
    want = {d: (n, c, c == d) for d, (n, c) in brute.components(rows).items()}
    assert found(spark, docs(spark, rows)) == want


def test_large_bucket_is_complete(spark):
    """A chain of variants: neighbours are alike, the ends are not; a shared bucket has more members than are paired."""
    pick = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[pick.randrange(120)] = f"n{i}"
    pick.shuffle(rows)
    want = {d: (n, c, c == d) for d, (n, c) in brute.components(rows).items()}
    assert found(spark, docs(spark, rows)) == want


def test_nulls_and_repeats(spark):
    text = "a b c d e f g"
    table = docs(spark, [(None, text), (1, text), (1, text), (2, text), (None, None)])
    got = sorted(map(tuple, minhash.link(table).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, None, True), (None, 0, None, True)], key=str)
    assert sorted(str(r["doc_id"]) for r in minhash.deduplicate(table).collect()) == ["1", "None", "None"]
    assert minhash.deduplicate(table).columns == table.columns
    assert minhash.link(docs(spark, [])).count() == 0


def test_estimate():
    pick = np.random.default_rng(4)
    for same in (0, 300, 600, 900):
        both = pick.integers(0, 2**63, same).astype(np.uint64)
        a, b = (np.concatenate([both, pick.integers(0, 2**63, 1000 - same).astype(np.uint64)]) for _ in range(2))
        est = minhash.similarity(minhash.pack(minhash.minima(a)[None]), minhash.pack(minhash.minima(b)[None]))[0]
        assert abs(est - same / (2000 - same)) < 0.16


def test_blocks_find_every_pair(spark):
    texts = family(5, 600, 100, 1)
    import pyarrow as pa

    keys = [minhash._key(own) for _, own in minhash._sets(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(texts), pa.array(keys, pa.binary())], names=["cls", "text", "want"])
    small = [r["small"] for b in minhash._full(iter([batch])) for r in b.to_pylist()]
    rows = spark.createDataFrame([(7, i, 600, i, small[i]) for i in range(600)], "key long, cls long, n long, component long, small binary")
    pairs = minhash._blocks(rows).groupBy("key", "one", "two").applyInPandas(minhash._compare, "a long, b long")
    assert pairs.count() == pairs.distinct().count() == 600 * 599 // 2


def test_tokens_against_python():
    import pyarrow as pa

    texts = ["A b\tC", "", None, "é\x0bÀ x", "x", " lead and trail ", "a" * 5000 + " b", "\x1c\x00 \x85"] * 3
    every = [w for x in tokens.words(pa.array(texts), chunk=16) for w in x.hashes.tolist()]
    names = [w for t in texts for w in brute.words(brute.lower(t or ""))]
    assert len(every) == len(names) and len(set(zip(every, names))) == len(set(every)) == len(set(names))
    sets = [set(x) for w in tokens.words(pa.array(texts), chunk=16) for s, b in [tokens.shingles(w)] for x in np.split(s, b[1:-1])]
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]
