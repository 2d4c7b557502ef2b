"""Secret scans: patterns, and a randomness test battery for what no pattern names.

Candidates are maximal runs of base-64 characters, of 20 at least. `=` ends a run; at its end, padding is part of the span
but not of what is tested. A run that fits no encoding as a whole is cut at `-` and `_`, at `+` and `/`, and at all four;
of the pieces with an encoding, those inside no other are candidates. The encoding of a candidate is inferred from the
characters in it, and against the hypothesis that it is drawn evenly from that alphabet three tests are made: chi-squared uniformity of the
alphabet (Wilson-Hilferty), a runs test about the alphabet's middle, and the lag-one serial correlation. Fisher's method
joins the three p-values. Random strings have even p-values, structured ones (words, names, counters) have tiny ones.

False discoveries are controlled in strata of encoding and length, as short strings give the tests little power. In a
stratum, Storey's estimate of the share of random strings tells how many of those at or above a cut are structured; the
lowest cut at which these are at most `FDR` of those above it, and no lower than `ALPHA`, is the stratum's cut.
P-values are counted in `BINS` bins, so that a stratum is a small table whatever the number of candidates.

Everything is DataFrame functions. The positions of matches come from the lengths of the pieces between them.
Defined results: null and empty texts have no spans; rows are judged one by one, equal rows alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, materialise

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
#: Pieces of a run without an encoding.
PIECES = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}")
RUNS = "array<struct<begin:int,end:int,token:string>>"
#: Kinds in the order in which they are listed at one start.
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN = 12
FDR = 0.1
ALPHA = 0.001
LAMBDA = 0.5
BINS = 200
SPAN = "array<struct<kind:int,begin:int,end:int>>"

#: Alphabets by name: the characters in the order of their values. Fixed values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64_url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def _places(text: Column, pattern: str, found: Column) -> Column:
    """(begin, end) of the matches `found` of `pattern`, in code points, from the pieces that split() leaves between."""
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(pieces, found, lambda piece, match: F.struct(F.char_length(piece).alias("gap"), F.char_length(match).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.coalesce(pair["gap"], F.lit(0))
        end = begin + F.coalesce(pair["n"], F.lit(0))
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("begin"), end.alias("end"))).alias("out"))

    return F.slice(F.aggregate(pairs, start, step, lambda acc: acc["out"]), 1, F.size(found))


def _spans(places: Column, kind: int) -> Column:
    return F.transform(places, lambda p: F.struct(F.lit(kind).alias("kind"), p["begin"].alias("begin"), p["end"].alias("end")))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution: 1 - erf(|z| / sqrt 2) by a rational approximation (error below 2e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    series = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return let(x, lambda x: F.greatest(F.lit(1e-300), let(1.0 / (1.0 + 0.3275911 * x), series) * F.exp(-x * x)))


def encoding(token: Column) -> Column:
    """The narrowest alphabet that holds the token and of which the token uses every class of characters; else null.

    Digits alone (cards, counters) and letters of one case alone (words) fit no encoding.
    """
    digit, lower, upper = token.rlike("[0-9]"), token.rlike("[a-z]"), token.rlike("[A-Z]")
    return (
        F.when(token.rlike("^[0-9a-f]+$") & digit & lower, "hex")
        .when(token.rlike("^[0-9A-F]+$") & digit & upper, "hex_upper")
        .when(token.rlike("^[A-Z2-7]+$") & digit & upper, "base32")
        .when(token.rlike("^[0-9a-z]+$") & digit & lower, "base36")
        .when(token.rlike("^[0-9A-Za-z]+$") & digit & lower & upper, "base62")
        .when(token.rlike("^[0-9A-Za-z+/]+$") & digit & lower & upper, "base64")
        .when(token.rlike("^[0-9A-Za-z_-]+$") & digit & lower & upper, "base64_url")
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once: expressions stay small however often they use it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(values: Column, start: Column) -> Column:
    return F.aggregate(values, start, lambda s, x: s + x)


def _uniformity(v: Column, n: Column, k: Column) -> Column:
    """Chi-squared test of even use of the alphabet, by the Wilson-Hilferty transform."""
    count = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda a: F.size(F.filter(v, lambda x: x == a)).cast("double"))
    chi = F.aggregate(count, F.lit(0.0), lambda s, c: s + c * c) * k / n - n
    z = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    return let(z, lambda z: let(normal_tail(z) / 2, lambda p: F.when(z > 0, p).otherwise(1 - p)))


def _runs(v: Column, n: Column, k: Column) -> Column:
    """Wald-Wolfowitz runs test about the middle of the alphabet."""

    def with_sides(high: Column) -> Column:
        changes = F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high)), lambda a, b: (a != b).cast("int"))
        upper = _total(high, F.lit(0)).cast("double")
        mean = let(upper, lambda n1: 1 + 2 * (n - n1) * n1 / n)
        runs = 1 + _total(changes, F.lit(0))
        return let(mean, lambda m: let((m - 1) * (m - 2) / (n - 1), lambda var: F.when(var > 0, normal_tail((runs - m) / F.sqrt(var))).otherwise(F.pow(F.lit(2.0), 1 - n))))

    return let(F.transform(v, lambda x: (x * 2 >= k).cast("int")), with_sides)


def _serial(v: Column, n: Column) -> Column:
    """Test of the lag-one serial correlation, about -1/n with variance 1/n for random strings."""

    def with_mean(mu: Column) -> Column:
        spread = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mu) * (x - mu))
        lag = _total(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: (a - mu) * (b - mu)), F.lit(0.0))
        r = let(spread, lambda s: F.when(s > 0, lag / s).otherwise(1.0))
        return normal_tail((r + 1 / n) * F.sqrt(n))

    return let(_total(v, F.lit(0)).cast("double") / n, with_mean)


def battery(token: Column, name: Column) -> Column:
    """Fisher's joint p-value of the three tests for a token of the named encoding."""
    chars = F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair))

    def with_alphabet(alphabet: Column) -> Column:
        values = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.position(c, alphabet) - 1)
        k = F.char_length(alphabet).cast("double")
        return let(k, lambda k: let(values, lambda v: let(F.size(v).cast("double"), lambda n: joint(v, n, k))))

    def joint(v: Column, n: Column, k: Column) -> Column:
        logs = F.array(_uniformity(v, n, k), _runs(v, n, k), _serial(v, n))
        half = F.aggregate(logs, F.lit(0.0), lambda s, p: s - F.log(F.greatest(p, F.lit(1e-300))))  # of Fisher's statistic
        return let(half, lambda x: F.exp(-x) * (1 + x + x * x / 2))

    return let(F.element_at(chars, name), with_alphabet)


def length_band(n: Column) -> Column:
    return F.least(F.floor(F.log2(n.cast("double")) * 2), F.lit(16)).cast("int")


def candidates_of(r: Column) -> Column:
    """The candidates in a run (begin, end, token): the run without its padding, or its widest pieces that have an encoding."""
    core = F.rtrim(r["token"], F.lit("="))
    item = lambda begin, end, token: F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"), token.alias("token"))

    def cut(core: Column) -> Column:
        def by(pattern: str) -> Column:
            found = F.regexp_extract_all(core, F.lit(pattern), 0)
            # a piece that ends the run takes the padding into its span
            ends = lambda p: F.when(p["end"] == F.char_length(core), r["end"]).otherwise(r["begin"] + p["end"])
            return F.zip_with(_places(core, pattern, found), found, lambda p, t: item(r["begin"] + p["begin"], ends(p), t))

        pieces = F.filter(F.array_distinct(F.concat(*map(by, PIECES))), lambda p: encoding(p["token"]).isNotNull())
        inside = lambda p, q: (q["begin"] <= p["begin"]) & (p["end"] <= q["end"]) & (F.char_length(q["token"]) > F.char_length(p["token"]))
        widest = let(pieces, lambda ps: F.filter(ps, lambda p: ~F.exists(ps, lambda q: inside(p, q))))
        return F.when(encoding(core).isNotNull(), F.array(item(r["begin"], r["end"], core))).otherwise(widest)

    return let(core, cut)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans of the patterns, and the candidates of the battery with stratum and p-value, one row a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id",
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(ASSIGN), 0).alias("assign"),
        F.regexp_extract_all(text, F.lit(ASSIGN), 2).alias("value"),
        F.regexp_extract_all(text, F.lit(ACCESS), 0).alias("access"),
        F.regexp_extract_all(text, F.lit(HEX), 0).alias("hex"),
        F.regexp_extract_all(text, F.lit(RUN), 0).alias("run"),
    )
    assign = F.zip_with(_places(F.col("text"), ASSIGN, F.col("assign")), F.col("value"), lambda p, v: F.struct(p["begin"].alias("begin"), p["end"].alias("end"), F.char_length(v).alias("n")))
    some = lambda c, value, kind: F.when(F.size(c) > 0, value).otherwise(_none(kind))
    placed = found.select(
        "doc_id",
        some("assign", _spans(F.filter(assign, lambda s: s["n"] >= MIN_ASSIGN), 0), SPAN).alias("assign"),
        some("access", _spans(_places(F.col("text"), ACCESS, F.col("access")), 1), SPAN).alias("access"),
        some("hex", _spans(_places(F.col("text"), HEX, F.col("hex")), 2), SPAN).alias("hex"),
        some("run", F.zip_with(_places(F.col("text"), RUN, F.col("run")), F.col("run"), lambda p, t: F.struct(p["begin"].alias("begin"), p["end"].alias("end"), t.alias("token"))), RUNS).alias("run"),
    )
    base = F.array_sort(F.transform(F.concat("assign", "access", "hex"), lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["end"].alias("end"))))
    placed = placed.withColumn("base", base)
    # what overlaps a span of the patterns is found already
    fresh = F.filter(F.flatten(F.transform("run", candidates_of)), lambda r: ~F.exists("base", lambda s: (s["begin"] < r["end"]) & (r["begin"] < s["end"])))
    return placed.select("doc_id", "assign", "access", "hex", "base", F.when(F.size("run") > 0, fresh).otherwise(_none(RUNS)).alias("fresh"))


def judged(scanned: DataFrame) -> DataFrame:
    """Adds to every candidate its stratum and the bin of its p-value, and drops its text."""

    def one(r: Column) -> Column:
        def scored(name: Column, p: Column) -> Column:
            stratum = F.concat_ws(":", name, length_band(F.char_length(r["token"])).cast("string"))
            return F.struct(r["begin"].alias("begin"), r["end"].alias("end"), stratum.alias("stratum"), F.least(F.floor(p * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), p.alias("p"))

        return let(encoding(r["token"]), lambda name: let(battery(r["token"], name), lambda p: scored(name, p)))

    some = F.when(F.size("fresh") > 0, F.transform("fresh", one)).otherwise(_none("array<struct<begin:int,end:int,stratum:string,bin:int,p:double>>"))
    return scanned.select("doc_id", "assign", "access", "hex", "base", some.alias("runs"))


def cuts(candidates: DataFrame) -> dict[str, float]:
    """The least p-value at which a candidate of a stratum counts as random; strata of which none does are left out.

    The table has a row for each of at most `BINS` bins of 7 encodings times 17 length bands.
    """
    rows = candidates.select(F.explode("runs").alias("r")).filter(F.col("r.p") > ALPHA).groupBy("r.stratum", "r.bin").count().collect()
    strata = {r["stratum"] for r in rows}
    total = {r["stratum"]: r["count"] for r in candidates.select(F.explode("runs").alias("r")).groupBy("r.stratum").count().collect()}
    out = {}
    for s in strata:
        hist = [0] * BINS
        for r in rows:
            if r["stratum"] == s:
                hist[r["bin"]] = r["count"]
        m = total[s]
        half = int(BINS * LAMBDA)
        random = min(1.0, (1 + sum(hist[half:])) / ((1 - LAMBDA) * m)) * m
        above = sum(hist)
        for b in range(BINS):
            t = max(ALPHA, b / BINS)
            if above and max(0.0, above - random * (1 - t)) <= FDR * above:
                out[s] = t
                break
            above -= hist[b]
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans (begin, kind, end, in that order) of all findings, and those of the patterns alone."""
    found = materialise(judged(scan(docs)), "secrets")
    cut = cuts(found)
    if cut:
        table = F.create_map(*(F.lit(x) for pair in sorted(cut.items()) for x in pair))
        more = F.filter("runs", lambda r: r["p"] >= F.coalesce(F.try_element_at(table, r["stratum"]), F.lit(2.0)))
    else:
        more = F.filter("runs", lambda r: F.lit(False))
    extra = F.transform(more, lambda r: F.struct(r["begin"].alias("begin"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return found.select("doc_id", "assign", "access", "hex", "base", F.when(F.size("runs") > 0, F.array_sort(F.concat("base", extra))).otherwise(F.col("base")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir))
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
