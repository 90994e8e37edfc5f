"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every rule is an upper limit on a whole number measured on a document.  Instead of fixed
limits, each (lang, source) gets its own, a fence above the bulk of its documents:

    limit = q75 + spread * max(q75 - q25, step)

The quantiles come from mergeable sketches: counts in log-linear buckets (exact below 64,
then 32 buckets for each power of two, so at most 3.2 % wide).  Sketches add up, so tasks
combine them before the shuffle, and a group with few documents takes the merged sketch of
its language, or of everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, stored, text_of

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

#: Base rules, fixed: at least so many words, at most so many per cent in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Measures with the least spread of a group, in the measure's unit.
RULES = {
    "symbol_rate": 30,  # symbols in 1000 words
    "shout_rate": 60,  # exclamation marks in 1000 words
    "word_length": 100,  # mean code points of a word, in hundredths
    "line_rate": 20,  # repeated lines in 1000 words
    "repeat_rate": 120,  # words in repeated windows, in 1000
}
#: How many spreads above the upper quartile the limit lies.
SPREAD = 4
#: Groups with fewer documents take the sketch of their language, languages that of all.
LEAST_DOCUMENTS = 40


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_shouts).

    Words are runs of characters other than the six ASCII spaces.  ``n_repeat_words`` counts
    the words inside any 3-word window that the text holds twice or more; the windows are
    sorted by their hash within the row, and neighbours of equal hash are compared word by
    word.  NULL texts have no words; NULL lang and source are the empty string.
    """
    base = docs.select(
        F.col(key).alias(key),
        F.coalesce(docs[lang].cast("string"), F.lit("")).alias("lang"),
        F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"),
        text_of(docs, text).alias("t"),
    )
    t = F.col("t")
    trimmed = F.btrim(t, F.lit(SPACES))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    cut = base.select(
        key,
        "lang",
        "source",
        F.split(trimmed, "[ \\t-\\r]+", -1).alias("w"),
        _without(t, SPACES).cast("bigint").alias("word_chars"),
        (F.length(t) - _without(t, SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.length(t) - _without(t, "!")).cast("bigint").alias("n_shouts"),
        lines.alias("lines"),
    )
    w = F.col("w")
    n = F.when(F.col("word_chars") == 0, 0).otherwise(F.size(w))
    hashed = cut.withColumns(
        {
            "n": n,
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
            "h": F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))),
        }
    ).drop("lines")
    h = F.col("h")
    ordered = hashed.withColumn(
        "s",
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("p")))),
    ).drop("h")
    s = F.col("s")

    def same(x: Column, y: Column) -> Column:
        p, q = x["p"], y["p"]
        return (x["h"] == y["h"]) & (w[p] == w[q]) & (w[p + 1] == w[q + 1]) & (w[p + 2] == w[q + 2])

    twice = F.filter(s, lambda x, i: ((i > 0) & same(x, F.get(s, i - 1))) | ((i < F.size(s) - 1) & same(x, F.get(s, i + 1))))
    placed = ordered.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("s", "w")
    at = F.col("at")
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("end")),
        lambda acc, p: F.struct((acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - p)).cast("bigint").alias("n"), (p + 3).alias("end")),
    )["n"]
    return placed.select(
        key,
        "lang",
        "source",
        F.col("n").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        "n_shouts",
    )


def rates(counted: DataFrame) -> DataFrame:
    """Add the whole-number rate of each rule; NULL without words."""
    n = F.col("n_words")

    def rate(column: str, times: int) -> Column:
        return F.when(n > 0, F.floor(F.col(column) * times / n).cast("bigint"))

    return counted.withColumns(
        {
            "symbol_rate": rate("n_symbols", 1000),
            "shout_rate": rate("n_shouts", 1000),
            "word_length": rate("word_chars", 100),
            "line_rate": rate("n_dup_lines", 1000),
            "repeat_rate": rate("n_repeat_words", 1000),
        }
    )


def bucket(value: Column) -> Column:
    """Lower end of the sketch bucket of a whole number >= 0: exact below 64, then its six top bits."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return (F.floor(value / F.pow(F.lit(2), drop)) * F.pow(F.lit(2), drop)).cast("bigint")


def sketches(rated: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): one mergeable sketch for each language, source and rule."""
    long = rated.unpivot(["lang", "source"], list(RULES), "rule", "value").filter("value IS NOT NULL")
    return long.groupBy("lang", "source", "rule", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of wider groups: counts of equal buckets add up."""
    return sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule, total, q25, q75): the first buckets that reach a quarter and three quarters of the count."""
    group = Window.partitionBy(*by, "rule")
    run = sketch.withColumns(
        {
            "below": F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)),
            "total": F.sum("n").over(group),
        }
    )
    return run.groupBy(*by, "rule").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("below") * 4 >= F.col("total"), F.col("bucket"))).alias("q25"),
        F.min(F.when(F.col("below") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q75"),
    )


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, limit of each rule), from the group's sketch or the wider one it falls back to."""
    own = quartiles(sketch, ["lang", "source"])
    of_lang = quartiles(merged(sketch, ["lang"]), ["lang"]).select(
        "lang", "rule", *(F.col(c).alias(f"l_{c}") for c in ("total", "q25", "q75"))
    )
    of_all = quartiles(merged(sketch, []), []).select("rule", *(F.col(c).alias(f"a_{c}") for c in ("q25", "q75")))
    both = own.join(of_lang, ["lang", "rule"]).join(of_all, "rule")

    def pick(c: str) -> Column:
        return (
            F.when(F.col("total") >= LEAST_DOCUMENTS, F.col(c))
            .when(F.col("l_total") >= LEAST_DOCUMENTS, F.col(f"l_{c}"))
            .otherwise(F.col(f"a_{c}"))
        )

    step = F.create_map(*(F.lit(x) for pair in RULES.items() for x in pair))[F.col("rule")]
    fence = pick("q75") + SPREAD * F.greatest(pick("q75") - pick("q25"), step)
    return both.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == r, fence)).cast("bigint").alias(f"most_{r}") for r in RULES))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Measures, limits and verdict of every document.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows.
    ``kept``: passes the base rules and no rate is above the limit of its language and source.
    The measures are stored in the shared folder, as both the sketches and the verdict read
    them.  Repeated rows and keys each keep their row.
    """
    rated = rates(stored(measures(docs, key, text, lang, source), "measures"))
    # Stored, so that Spark knows how small the limits are before it deals the rows.
    limit = stored(limits(sketches(rated)), "limits")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"most_{r}"), F.lit(False))
    return rated.join(limit, ["lang", "source"], "left").withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` whose verdict is ``kept``, with their columns as they are.

    A row is named by its key and a digest of what the rules read, so rows that share a key, or
    have none, each get their own verdict.
    """
    read = [F.coalesce(docs[c].cast("string"), F.lit("")) for c in (text, lang, source)]
    named = docs.withColumn("__digest", F.xxhash64(*read))
    rows = named.withColumn("__row", F.struct(F.col(key).alias("key"), F.col("__digest").alias("digest")))
    verdict = judged(rows, "__row", text, lang, source).filter("kept")
    verdict = verdict.select(F.col("__row.key").alias("__kept_key"), F.col("__row.digest").alias("__kept_digest")).distinct()
    same = named[key].eqNullSafe(F.col("__kept_key")) & (F.col("__digest") == F.col("__kept_digest"))
    return named.join(verdict, same, "left_semi").drop("__digest")
