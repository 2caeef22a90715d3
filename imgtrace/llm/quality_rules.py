"""Quality rules with adaptive thresholds, in DataFrame functions only.

Counts are taken row by row inside the JVM. Thresholds are not fixed: each language and source has quantile sketches of its
documents' rates, counts in logarithmic buckets (a value is known to GAMMA - 1 of itself), built in one partial aggregation.
Sketches merge by adding their counts up, into those of a language and of the whole corpus, which serve the groups whose
own sketch holds too few values. Sums don't hang on their order, so the verdicts are the same however rows are dealt out
and tasks repeated. A join brings the limits back to the documents.

Of symbols, repeated lines and repeated passages good text mostly has none, so the quantiles of all documents are often 0
and say little. Each of these rates has a second sketch of the documents that have any. A document is rejected if it lies
above the quantile TOP of its whole group, and also above the quantile SOME of those that have any: so never more than
1 - TOP of a group by one rate, and in a group where these are rare, those that have hardly any stay. Word lengths are
rejected that lie farther outside the quantiles TAIL and 1 - TAIL than these lie apart (or than NARROW of the median, for
groups of mere copies).

Defined results: null text has no words and fails; null languages and sources are groups of their own; every row gives
one row, repeated rows count as often as they occur; a rate at its limit is inside (ties are kept); a sketch of fewer than
LEAST values leaves its limit to that of the language, or of the whole corpus if that has fewer too; an empty table gives no rows; a very long text is one row of long arrays; columns
other than doc_id, lang, source and text are not read, so none can clash. A document is kept if it passes the fixed base
rules and all its rates lie within the limits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.llm.common import WORD_BREAKS, materialize, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
#: The rates that get limits: name, and whether small, large or both extremes are rejected.
RATES = {"mean_word_chars": "both", "symbols_per_word": "high", "dup_lines_per_line": "high", "repeats_per_word": "high"}
#: Quantiles of all documents and of those with a rate above 0, both of which a rejected one exceeds; those for word lengths.
TOP, SOME, TAIL, NARROW = 0.97, 0.25, 0.05, 0.1
#: Sketches of fewer documents leave the limits to those of the next larger group.
LEAST = 50
#: Ratio of neighbouring buckets' edges, and the bucket of 0, below all others.
GAMMA = 1.005
NONE = -1_000_000
REPEAT_WINDOW = 8


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of every document, and n_lines, its lines with a word.

    Windows are compared by 64-bit hashes within their document. Only documents with equal hashes sort them; the places of
    equal ones, in order, then give the words covered: the gaps to the next place, 8 at most, and 8 for the last.
    Arrays that a lambda looks into are columns of the step before, so they are made once a row.
    """
    trimmed = F.btrim("text", F.lit(SPACES))
    n = F.size("words")
    source = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"))), text_or_empty().alias("text"))
    split = source.select(
        "doc_id",
        "lang",
        "source",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAKS)).alias("words"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        "lang",
        "source",
        n.alias("n_words"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(n > REPEAT_WINDOW, F.transform(F.sequence(F.lit(1), n - REPEAT_WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, F.lit(REPEAT_WINDOW))))).alias("windows"),
    )
    placed = hashed.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    last = F.size("placed")
    none = F.array(F.lit(None).cast("long"))
    h = F.col("placed.h")
    neighbours = F.arrays_zip(h.alias("h"), F.col("placed.i").alias("i"), F.concat(none, F.slice(h, F.lit(1), last - 1)).alias("before"), F.concat(F.slice(h, F.lit(2), last - 1), none).alias("after"))
    equal = F.filter(neighbours, lambda x: F.coalesce(x.h == x.before, F.lit(False)) | F.coalesce(x.h == x.after, F.lit(False)))
    places = placed.withColumn("places", F.when(last > 0, F.array_sort(F.transform(equal, lambda x: x.i))))
    k = F.size("places")
    gaps = F.zip_with(F.slice("places", F.lit(2), k - 1), F.slice("places", F.lit(1), k - 1), lambda x, y: F.least(x - y, F.lit(REPEAT_WINDOW)))
    covered = F.when(k > 0, F.aggregate(gaps, F.lit(REPEAT_WINDOW), lambda total, x: total + x)).otherwise(0)
    counted = places.withColumn("n_repeat_words", covered)
    return counted.select("doc_id", "lang", "source", *(F.col(c).cast("long").alias(c) for c in (*COUNTS, "n_lines")))


def with_rates(measured: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumns(
        {
            "base_failed": failed,
            "mean_word_chars": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words,
            "dup_lines_per_line": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeats_per_word": F.col("n_repeat_words") / words,
        }
    )


def _bucket(rate: Column) -> Column:
    """The logarithmic bucket of a rate: values of one bucket differ by a factor of GAMMA at most; NONE for 0."""
    return F.when(rate > 0, F.floor(F.log(rate) / math.log(GAMMA)).cast("int")).otherwise(NONE)


def _edge(bucket: Column) -> Column:
    """The value where a bucket begins."""
    return F.when(bucket > NONE, F.exp(bucket * math.log(GAMMA))).otherwise(0.0)


def sketches(rated: DataFrame) -> DataFrame:
    """lang, source, rate, bucket and n: the documents of each group by buckets of their rates. Sketches merge by adding up n."""
    each = rated.select("lang", "source", F.inline(F.array(*(F.struct(F.lit(r).alias("rate"), _bucket(F.col(r)).alias("bucket")) for r in RATES))))
    return each.groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def _read(merged: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """A row for each group of `keys` with what its merged sketches say: counts of documents and quantiles' buckets by rate."""
    within = Window.partitionBy(*keys, "rate")
    running = within.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    some = F.when(F.col("bucket") > NONE, F.col("n")).otherwise(0)
    counted = merged.withColumns({"upto": F.sum("n").over(running), "all": F.sum("n").over(within), "some_upto": F.sum(some).over(running), "some": F.sum(some).over(within)})
    out = []
    for r, kind in RATES.items():
        mine = F.col("rate") == r
        at = lambda q, upto="upto", n="all": F.min(F.when(F.lit(mine) & (F.col(n) > 0) & (F.col(upto) >= F.ceil(q * F.col(n))), F.col("bucket")))  # noqa: B023, E731
        out += [F.max(F.when(mine, F.col("all"))).alias(f"{prefix}{r}_n"), F.max(F.when(mine, F.col("some"))).alias(f"{prefix}{r}_some_n")]
        if kind == "high":
            out += [at(TOP).alias(f"{prefix}{r}_top"), at(SOME, "some_upto", "some").alias(f"{prefix}{r}_some")]
        else:
            out += [at(q).alias(f"{prefix}{r}_{name}") for name, q in (("low", TAIL), ("middle", 0.5), ("high", 1 - TAIL))]
    return counted.groupBy(*keys).agg(*out)


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source, and a lower and an upper limit for each rate, from the documents that pass the base rules."""
    own = materialize(sketches(with_rates(measured).where(~F.col("base_failed"))))
    merged = lambda *keys: own.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    by_lang = _read(merged("lang"), ["lang"], "lang_").withColumnRenamed("lang", "of")
    whole = _read(merged(), [], "").first()  # one row of counts and buckets
    joined = _read(own, ["lang", "source"], "").join(by_lang, F.col("lang").eqNullSafe(F.col("of")))

    def chosen(name: str, count: str) -> Column:
        """What the smallest group with LEAST documents behind this sketch says."""
        return F.when(F.col(count) >= LEAST, F.col(name)).when(F.col(f"lang_{count}") >= LEAST, F.col(f"lang_{name}")).otherwise(F.lit(whole[name]).cast("int"))

    out = []
    for r, kind in RATES.items():
        if kind == "high":
            least = F.lit(float("-inf"))
            most = _edge(F.greatest(chosen(f"{r}_top", f"{r}_n"), F.coalesce(chosen(f"{r}_some", f"{r}_some_n"), F.lit(NONE))) + 1)
        else:
            low, middle, high = (_edge(chosen(f"{r}_{k}", f"{r}_n") + int(k == "high")) for k in ("low", "middle", "high"))
            reach = F.greatest(high - low, NARROW * middle)
            least, most = low - reach, high + reach
        out += [least.alias(f"{r}_least"), most.alias(f"{r}_most")]
    return joined.select("lang", "source", *out)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, the rates, their limits, and kept, of every document."""
    measured = materialize(measure(docs))
    limits = thresholds(measured).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    rated = with_rates(measured)
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    inside = F.lit(True)
    for r in RATES:
        inside &= F.coalesce(F.col(r).between(F.col(f"{r}_least"), F.col(f"{r}_most")), F.lit(True))
    return joined.drop("of_lang", "of_source").withColumn("kept", ~F.col("base_failed") & inside)
