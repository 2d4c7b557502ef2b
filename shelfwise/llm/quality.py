"""Quality rules: repetition inside a document, and lines that recur across the documents of a host.

A line is normalised (lower case, digits as one class, white space as single blanks) and hashed. For each host (here: the
source) the distinct documents that hold a line are counted; documents are distinct if their texts are, so a text that was
copied is no template. A line held by more than
`LINE_DOCS` of them is above the limit and is removed, whatever the host's size. A document is depleted, and rejected, if
less than `LEAST_LEFT` of its words are left.

Everything is DataFrame functions. Texts are never shuffled: lines are shuffled as hashes, once for each distinct text of
a host, with a partial count before. Lines above the limit are at most one in `LINE_DOCS` of a host's lines, and are
broadcast only if their counted number is small; else the most frequent of them are, and the others meet by a shuffle.

Defined results: null and empty texts have no words and fail; a null source is a host of its own; repeated rows get equal
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import GAP, documents, join_hot, materialise, tidy

LINE_DOCS = 6
LEAST_LEFT = 0.3
MIN_WORDS = 10
REPEAT_PERCENT = 20
BROADCAST_LINES = 200_000
_HAS_WORD = r"[^\x20\x09-\x0D]"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def window_hashes(hashes: Column) -> Column:
    """A hash for each window of five words, from the words' hashes."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2), F.get(hashes, i + 3), F.get(hashes, i + 4)))


def covered(windows: Column) -> Column:
    """Words in windows whose hash is found twice or more. Windows sorted by hash, then place, stand beside their equals."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)
    pairs = F.zip_with(F.slice(placed, 1, n - 1), F.slice(placed, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), GAP, " "))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, host, text key, the base counts and the normalised lines (hash, words) of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.col("source").alias("host"), text.alias("text"), F.xxhash64(text).alias("text_key"), word_list(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_HAS_WORD))
    hashed = split.select(
        "doc_id",
        "host",
        "text_key",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windowed = hashed.select("*", window_hashes(F.col("hashes")).alias("windows")).drop("hashes")
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), covered(F.col("windows"))).otherwise(F.lit(0))
    return windowed.select(
        "doc_id",
        "host",
        "text_key",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))).alias("lines"),
    )


def frequent_lines(texts: DataFrame, least: int = LINE_DOCS) -> DataFrame:
    """host, line and count of the lines above the limit; texts: one row for each distinct text of a host, with its lines."""
    own = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    return own.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)


def held(own: DataFrame, lines: DataFrame, most: int = BROADCAST_LINES) -> DataFrame:
    """The rows of `own` whose line is above the limit of their host. Beyond `most` lines, the `most` commonest are broadcast."""
    same = (F.col("o.line") == F.col("t.line")) & F.col("o.host").eqNullSafe(F.col("t.host"))
    if lines.limit(most + 1).count() <= most:
        return own.alias("o").join(F.broadcast(lines).alias("t"), same).select("o.*")
    # n at the place `most` from the top: fewer than `most` lines are above it
    least = lines.select("n").orderBy(F.desc("n")).limit(most).agg(F.min("n")).first()[0]
    common, rare = lines.filter(F.col("n") > least), lines.filter(F.col("n") <= least)
    return own.alias("o").join(F.broadcast(common).alias("t"), same).select("o.*").unionByName(own.alias("o").join(rare.alias("t"), same).select("o.*"))


@tidy
def judge(docs: DataFrame, least: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """The base counts of each document, the words that line removal leaves, and the verdict."""
    stats = materialise(statistics(docs).withColumn("text_id", F.xxhash64("host", "text_key")), "quality-stats")
    # what goes from a text is found once for all its copies in a host
    texts = stats.groupBy("text_id", "host").agg(F.first("lines").alias("lines"), F.count(F.lit(1)).alias("copies"))
    texts = materialise(texts, "quality-texts")
    lines = materialise(frequent_lines(texts, least), "quality-lines")
    own = texts.select("text_id", "host", "copies", F.explode("lines").alias("x")).select("text_id", "host", "copies", F.col("x.line").alias("line"), F.col("x.n").alias("words"))
    gone = held(own, lines).groupBy("text_id").agg(F.sum("words").cast("long").alias("removed"), F.max("copies").alias("copies"))
    both = join_hot(stats.drop("lines"), materialise(gone, "quality-gone"), "text_id", "copies")
    left = F.col("n_words") - F.coalesce(F.col("removed"), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return both.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), left.alias("words_left"), (~failed & (left >= least_left * F.col("n_words"))).alias("kept")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("host")
