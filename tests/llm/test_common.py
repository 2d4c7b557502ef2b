import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import common, decontaminate, minhash, mixing, quality, sharding, toxicity, urls

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PLAIN = """
import os, sys
from pyspark.sql import SparkSession
from shelfwise.llm import common
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.sparkContext.getConf().get("spark.checkpoint.dir") is None
assert common.materialise(spark.range(3), "x").count() == 3
folder = common.work_dir(spark).removeprefix("file:")
assert len(os.listdir(folder)) == 1
spark.stop()
print("FOLDER", folder)
"""


def test_a_session_without_a_checkpoint_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not os.path.exists(done.stdout.split("FOLDER ")[1].strip())  # it went with the session


class Cluster:
    """A session of a cluster that names no shared folder."""

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    sparkContext, conf = Context(), Conf()


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.work_dir(Cluster())


def files(spark):
    folder = common.work_dir(spark).removeprefix("file://").removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_operators_keep_only_what_their_result_reads(spark, sf):
    docs, labels, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    docs = docs.limit(60)
    for make, most in ((lambda: minhash.deduplicate(docs), 1), (lambda: mixing.mixed_documents(docs), 2), (lambda: quality.judge(docs), 2), (lambda: sharding.assign(docs), 1), (lambda: decontaminate.clean(docs, items), 1), (lambda: toxicity.clean(docs, labels), 0)):
        before = files(spark)
        out = make()
        assert len(files(spark) - before) <= most
        out.count()
        common.discard(out)


CLASH = ["row_key", "salt", "own_key", "own_salt", "position", "id", "text_key", "keep_key", "row", "key", "hit_row", "hit_key", "__text", "__own", "__id", "size", "slot", "shard", "group", "component_id", "kept", "score", "held_out", "parts", "hot_key", "epochs"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_names_nulls_and_repeats(spark, name):
    sf = "/root/testdata/sf0.01"
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, "one two three four five six seven", "en", "a", 3), (1, "one two three four five six seven", "en", "a", 3), (1, "another text of the same id", "en", "a", 3), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, None, None, None, None), (None, None, None, None, None), (3, "w " * 40_000, "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.withColumns({c: F.concat_ws(":", F.lit(c), "doc_id") for c in CLASH})
    out = stage(spark, wide, sf)
    got = out.collect()
    if name == "sharding":
        assert len(got) == len(rows)
        return
    assert out.columns == wide.columns
    assert all(r[c] == (c if r["doc_id"] is None else f"{c}:{r['doc_id']}") for r in got for c in CLASH)
    texts = sorted((str(r["doc_id"]), len(r["text"] or "")) for r in got)
    every = sorted((str(r[0]), len(r[1] or "")) for r in rows)
    if name == "near_dedup":
        assert texts == sorted(set(every)) + [("None", 0)]
    elif name != "mixing":
        assert texts == every


def test_equal_rows_are_mixed_as_often_as_the_plan_says(spark):
    docs = spark.createDataFrame([(7, "x y z", "en", "a", 5)] * 40 + [(None, "p q", "en", "b", 1)] * 6, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["doc_id"]: r["n"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("epochs").alias("n")).collect()}
    got = {r["doc_id"]: r["n"] for r in mixing.mixed_documents(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == taken and taken[7] > 40


def test_mixed_rows_of_many_copies_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_COPIES", 5)
    docs = spark.createDataFrame([(7, "x y z", "en", "a", 5)] * 40 + [(i, f"p q {i}", "en", "b", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r["doc_id"]: r["n"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("epochs").alias("n")).collect() if r["n"]}
    assert {r["doc_id"]: r["n"] for r in mixing.mixed_documents(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == want


def test_very_long_and_odd_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/" + "x" * 200_000, '<a href="http://b.test/">' * 20_000), (2, None, None), (2, None, None), (None, "http://b.test", "")], "page_id long, url string, html string")
    got = urls.judge(pages).collect()
    assert len(got) == 4 and {r["page_id"]: r["verdict"] for r in got}[1] == "block"
