"""Secret scans by patterns and a battery of randomness tests, with DataFrame functions only.

Patterns: assigned values, access keys and long hexadecimal numbers, each kind's matches leftmost and non-overlapping.
A match's place is the sum of the lengths before it, summed in runs of 256 matches so that a text with very many is no
square.

Battery: every maximal run of at least 20 key characters, of any length, with two kinds of characters out of capitals, small
letters and digits is a candidate. Its encoding is the smallest alphabet that holds it. The tests ask whether its
symbols are drawn evenly and independently from that alphabet: Pearson's chi-squared against the uniform alphabet, parted
into that between capitals, small letters and the rest (whose expected counts are large enough in short strings too) and that
within them (with the variance for the length), the number of runs above and below the alphabet's middle, and the correlation of
neighbours; Fisher's method combines them.

False discovery is controlled on both sides, within strata of encoding and length over all documents. A candidate is
discarded as not random by the Benjamini-Hochberg rule at `rate`, so that of what this discards an expected share of
`rate` at most is random. Of the rest, those are spans of kind "random" whose p-value is beyond what ordinary strings of the stratum
reach: their null distribution is that of decoys, strings of the same alphabet and length squeezed from the words of
the documents that hold candidates, and the same rule against it bounds the expected share of ordinary strings among
the spans by `rate`. (A stratum without any decoy, for want of words, has the first rule alone.) Both rules read counts of
p-values in 1/16 steps of their logarithm, so a stratum is a bounded number of counts and never a sorted list.

Null texts are empty: no spans, and the hash of the empty string. Repeated rows stay. The spans of different kinds may
overlap. Other columns are kept where the caller names them; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansheet.llm._common import hidden, materialize, shown, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that starts with AKIA has 20 or more characters, or nothing in it does
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
RUN = 256
#: Alphabets, smallest first.
ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "alnum62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "url64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "other66": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
_TESTS = {"hex": "[0-9a-f]+", "HEX": "[0-9A-F]+", "base32": "[A-Z2-7]+", "lower36": "[0-9a-z]+", "upper36": "[0-9A-Z]+", "alnum62": "[0-9A-Za-z]+", "base64": "[0-9A-Za-z+/]+", "url64": "[0-9A-Za-z_-]+", "other66": ".+"}
#: What decoys of an encoding drop, and how they are cased.
_OUTSIDE = {"hex": "[^0-9a-f]", "HEX": "[^0-9A-F]", "base32": "[^A-Z2-7]", "lower36": "[^0-9a-z]", "upper36": "[^0-9A-Z]", "alnum62": "[^0-9A-Za-z]", "base64": "[^0-9A-Za-z+/]", "url64": "[^0-9A-Za-z_-]", "other66": "[^0-9A-Za-z+/_-]"}
DECOYS = 32  # of a stratum in a document, at most
LENGTHS = (32, 48, 64, 128)
STEPS, BINS = 16, 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def placed(df: DataFrame, kind: str, pattern: str, low: int = 1, group: bool = False, text: str = "_t") -> DataFrame:
    """df with s_<kind>: an array of (start, end, value) of the pattern's matches with low or more characters (of its group, if it has one)."""
    m, g, n, runs, base, out = (f"_{x}_{kind}" for x in ("m", "g", "n", "runs", "base", "out"))
    df = df.withColumn(m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size(m) > 0
    df = df.withColumn(g, F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))) if group else F.col(m))
    df = df.withColumn(n, F.when(some, F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), F.col(m), lambda a, b: F.struct(F.length(a).cast("long").alias("before"), F.length(b).cast("long").alias("own")))))
    both = lambda x: F.transform(x, lambda y: y["before"] + y["own"])
    df = df.withColumn(runs, F.when(some, F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / RUN).cast("int")), lambda j: _total(both(F.slice(F.col(n), j * RUN + 1, F.lit(RUN)))))))
    df = df.withColumn(base, F.when(some, F.transform(F.sequence(F.lit(0), F.size(runs) - 1), lambda j: _total(F.slice(F.col(runs), F.lit(1), j)))))

    def one(i: Column) -> Column:
        j = F.floor(i / RUN).cast("int")
        start = F.get(F.col(base), j) + _total(both(F.slice(F.col(n), j * RUN + 1, i % RUN))) + F.get(F.col(n), i)["before"]
        return let(start, lambda s: F.struct(s.alias("start"), (s + F.get(F.col(n), i)["own"]).alias("end"), F.get(F.col(g), i).alias("value")))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    wanted = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.length(F.get(F.col(g), i)) >= low)
    df = df.withColumn(out, F.when(some, F.transform(wanted, one)))
    return df.withColumn(f"s_{kind}", F.coalesce(F.col(out), empty)).drop(m, g, n, runs, base, out)


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1.0 / (1.0 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def upper(z: Column) -> Column:
    """P(Z >= z) of a standard normal variable, kept off 0."""
    half = 0.5 * erfc(F.abs(z) / math.sqrt(2.0))
    return F.greatest(F.lit(1e-12), F.when(z >= 0, half).otherwise(1.0 - half))


def both_sides(z: Column) -> Column:
    return F.greatest(F.lit(1e-12), F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2.0))))


def encoding(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(_TESTS):
        out = F.when(s.rlike(f"^{_TESTS[name]}$"), F.lit(name)).otherwise(out)
    return out


def battery(s: Column, alphabet: Column) -> Column:
    """Fisher's p-value of the tests that s is drawn evenly from its alphabet."""
    k, n = F.length(alphabet).cast("double"), F.length(s).cast("double")
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    squares = F.aggregate(letters(alphabet), F.lit(0.0), lambda a, c: a + F.pow((F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0)))
    def kinds(x: Column) -> list[Column]:
        capital, small = (F.length(x) - F.length(F.regexp_replace(x, c, "")) for c in ("[A-Z]", "[a-z]"))
        return [c.cast("double") for c in (capital, small, F.length(x) - capital - small)]

    parts = list(zip(kinds(s), kinds(alphabet)))
    spread_out = sum(F.coalesce(F.try_divide(F.pow(o - e * n / k, F.lit(2.0)), e * n / k), F.lit(0.0)) for o, e in parts)
    free = sum((e > 0).cast("int") for _, e in parts) - 1
    within = k - 1 - free  # what is left of the whole chi-squared, independent of the kinds' part
    chi = upper((k * squares / n - n - spread_out - within) / F.sqrt(2 * within * (n - 1) / n))
    coarse = F.greatest(F.lit(1e-12), F.when(free == 2, F.exp(-spread_out / 2)).when(free == 1, both_sides(F.sqrt(spread_out))).otherwise(1.0))

    def of(x: Column) -> Column:
        size = F.size(x)
        pairs = F.sequence(F.lit(0), size - 2)
        high = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.when(v * 2 >= k, 1.0).otherwise(0.0))
        runs = 1.0 + F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.when((F.get(x, i) * 2 >= k) != (F.get(x, i + 1) * 2 >= k), 1.0).otherwise(0.0))

        def run_test(h: Column) -> Column:
            two = 2.0 * h * (n - h)
            variance = two * (two - n) / (n * n * (n - 1))
            return F.when(variance > 0, both_sides((runs - (two / n + 1)) / F.sqrt(variance))).otherwise(F.lit(1e-12))

        def serial(mean: Column) -> Column:
            spread = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
            moved = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + (F.get(x, i) - mean) * (F.get(x, i + 1) - mean))
            return F.when(spread > 0, both_sides((moved / spread + 1.0 / n) * F.sqrt(n))).otherwise(F.lit(1e-12))

        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        total = -(F.log(chi) + F.log(coarse) + F.log(let(high, run_test)) + F.log(let(mean, serial)))
        return let(total, lambda t: F.exp(-t) * (1 + t + t * t / 2 + t * t * t / 6))

    return let(F.transform(letters(s), lambda c: (F.position(c, alphabet) - 1).cast("double")), of)


def stratum(enc: Column, n: Column) -> Column:
    band = sum((n >= x).cast("int") for x in LENGTHS)
    return F.concat(enc, F.lit(":"), band.cast("string"))


def decoys(text: Column, candidates: Column, alphabets: Column) -> Column:
    """(stratum, p) of ordinary strings: for each stratum of a document's candidates up to DECOYS strings, of the length of
    its first candidate there, from all over the document's other words."""
    outside = F.create_map(*(F.lit(x) for pair in _OUTSIDE.items() for x in pair))
    words = F.regexp_replace(text, CANDIDATE, " ")

    def of(stratum: Column) -> Column:
        n = F.get(F.filter(candidates, lambda c: c["stratum"] == stratum), F.lit(0))["n"]
        enc = F.substring_index(stratum, ":", 1)
        cased = F.when(enc.isin("hex", "lower36"), F.lower(words)).when(enc.isin("HEX", "base32", "upper36"), F.upper(words)).otherwise(F.initcap(words))
        squeezed = F.regexp_replace(cased, F.element_at(outside, enc), F.lit(""))

        def strings(v: Column) -> Column:
            room = F.length(v["x"]) - v["n"]
            last = F.least(F.lit(DECOYS - 1), room)
            some = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda j: F.substring(v["x"], (F.floor(j * room / F.greatest(last, F.lit(1))) + 1).cast("int"), v["n"]))
            return F.when(room >= 0, some).otherwise(F.array().cast("array<string>"))

        strung = let(F.struct(squeezed.alias("x"), n.alias("n")), strings)
        return let(F.element_at(alphabets, enc), lambda a: F.transform(strung, lambda s: F.struct(stratum.alias("stratum"), battery(s, a).alias("p"))))

    return F.flatten(F.transform(F.array_distinct(F.transform(candidates, lambda c: c["stratum"])), of))


def scanned(df: DataFrame, keep: tuple[str, ...] = (), shortest: int = 20) -> DataFrame:
    """keep with the spans of the three patterns, the candidates with stratum and p-value, and decoys, from text."""
    df = df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    df = placed(df, "assign", ASSIGN, 6, group=True)
    df = placed(df, "access", ACCESS)
    df = placed(df, "hex", HEX)
    df = placed(df, "candidate", CANDIDATE, shortest)
    mixed = lambda v: (v.rlike("[0-9]").cast("int") + v.rlike("[a-z]").cast("int") + v.rlike("[A-Z]").cast("int")) >= 2
    alphabets = F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair))

    def tested(c: Column) -> Column:
        s = F.rtrim(c["value"], F.lit("="))
        enc = encoding(s)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.length(s).alias("n"), stratum(enc, F.length(s)).alias("stratum"), let(F.element_at(alphabets, enc), lambda a: battery(s, a)).alias("p"))

    df = df.withColumn("candidates", F.transform(F.filter("s_candidate", lambda c: mixed(c["value"])), tested))
    none = F.array().cast("array<struct<stratum:string,p:double>>")
    return df.withColumn("decoys", F.when(F.size("candidates") > 0, decoys(F.col("_t"), F.col("candidates"), alphabets)).otherwise(none)).drop("s_candidate", "_t")


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * STEPS).cast("int"))


def thresholds(scan: DataFrame, rate: float = 0.05) -> dict[str, int]:
    """By stratum the first bin whose candidates are discarded: Benjamini-Hochberg on counts over all documents, against
    random strings from one side and against decoys from the other."""

    def of(column: str, own: int) -> Column:
        return F.transform(column, lambda x: F.struct(x["stratum"].alias("stratum"), _bin(x["p"]).alias("bin"), F.lit(own).alias("own")))

    counts = scan.select(F.explode(F.concat(of("candidates", 1), of("decoys", 0))).alias("c")).groupBy("c.stratum", "c.bin").agg(F.sum("c.own").alias("n"), F.sum(1 - F.col("c.own")).alias("d"))
    every = Window.partitionBy("stratum")
    above, below = every.orderBy(F.desc("bin")), every.orderBy("bin")
    ruled = counts.select("*", F.sum("n").over(every).alias("m"), F.sum("n").over(above).alias("up"), F.sum("n").over(below).alias("down"), F.sum("d").over(every).alias("decoys"), F.sum("d").over(below).alias("over"))
    odd = (F.col("up") > 0) & (F.col("m") * F.exp(-F.col("bin") / STEPS) <= rate * F.col("up"))
    sure = (F.col("decoys") == 0) | (F.col("down") > 0) & (F.col("over") * F.col("m") <= rate * F.col("down") * F.col("decoys"))
    out = ruled.groupBy("stratum").agg(F.least(F.coalesce(F.min(F.when(odd, F.col("bin"))), F.lit(BINS)), F.coalesce(F.max(F.when(sure, F.col("bin"))), F.lit(-1)) + 1).alias("bin"))
    return {r["stratum"]: r["bin"] for r in out.collect()}  # a row for each stratum at most: alphabets times length bands


def found(scan: DataFrame, cut: dict[str, int]) -> DataFrame:
    """scan with base and spans: arrays of (start, kind's number, end), sorted."""
    limit = F.create_map(*(F.lit(x) for pair in cut.items() for x in pair)) if cut else F.create_map().cast("map<string,int>")
    kept = F.filter("candidates", lambda c: _bin(c["p"]) < F.coalesce(F.try_element_at(limit, c["stratum"]), F.lit(BINS)))
    spans = lambda x, k: F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    base = F.concat(*(spans(F.col(f"s_{kind}"), k) for k, kind in enumerate(KINDS[:3])))
    return scan.withColumn("base", F.array_sort(base)).withColumn("spans", F.array_sort(F.concat(F.col("base"), spans(kept, 3))))


def joined(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(df: DataFrame, rate: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """df (documents) with every span of its texts, overlapping ones as one, replaced by the mark; n_chars follows."""
    cut = thresholds(scanned(df), rate)
    df, names = hidden(df)
    out = found(scanned(df.withColumn("_source_text", F.col("text")), (*names.values(), "_source_text")), cut)

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.substring("_source_text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring("_source_text", (a["at"] + 1).cast("int"), F.length("_source_text"))))
    some = F.size("spans") > 0
    out = out.withColumn("text", F.when(some, text).otherwise(F.col("_source_text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return shown(out, names)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = materialize(scanned(table(spark, sf_dir, "documents"), ("doc_id",)), "secret-scan")
    out = found(scan, thresholds(scan))
    counts = [F.size(f"s_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
