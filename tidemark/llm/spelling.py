"""Spelling variants: words that differ by one code point, and the frequent form each leads to.

Candidates come from asymmetric q-chunks.  A word of length L contributes its two disjoint chunks
of half its length; words as long, or longer by one, contribute their positional grams of that
length.  One edit lies in one chunk at most, so the other chunk of the shorter word is a gram of
the longer one, shifted by one place at most.  Where a chunk has many words, the rest of the word
is dealt in the same way: it too differs by one edit at most, so one of its two halves is a gram of
the rest of the other word.  Candidates are verified inside the join and only true pairs leave it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_of

#: Shortest word, least count and, of frequent forms, the least ratio of the counts.
LEAST_CHARS, LEAST_COUNT, LEAST_RATIO = 6, 5, 5
#: One in so many (document, run) keys loses a code point: the spelling noise of the contract.
NOISE = 199
#: Chunks with more words than this are dealt by a chunk of the rest as well.
GROUP = 200
#: Entries of a task's table of counts; it is handed on when it grows past this.
COUNTED = 400_000

_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_CHARS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            key = f"{key}:".encode()
            seen = zlib.crc32(key)
            for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                h = zlib.crc32(run.encode(), seen)  # goes on from the checksum of the key
                if h % NOISE == 0:  # this run loses a code point, as the contract says
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) < LEAST_CHARS:
                        continue
                counts[run] += n
            if len(counts) > COUNTED:
                yield flush()
                counts.clear()
    yield flush()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    plain = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), text_of(docs, text).alias("text"))
    counted = plain.mapInArrow(_count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _cut(word: Column, start: Column, size: Column) -> Column:
    return word.substr(start + 1, size)


def _chunks(word: Column, length: Column) -> list[Column]:
    """The two disjoint chunks of a word, each with what lies beyond it on its open side."""
    q = F.floor(length / 2).cast("int")
    return [
        F.struct(F.lit(0).alias("side"), length.alias("size"), _cut(word, F.lit(0), q).alias("gram"), _cut(word, q, length).alias("rest")),
        F.struct(F.lit(1).alias("side"), length.alias("size"), _cut(word, length - q, q).alias("gram"), _cut(word, F.lit(0), length - q).alias("rest")),
    ]


def _grams(word: Column, length: Column) -> list[Column]:
    """All positional grams that are within shift one of a chunk of a word as long, or shorter by one."""
    out = []
    for shorter in (0, 1):
        size = (length - shorter).cast("int")
        q = F.floor(size / 2).cast("int")
        for shift in range(shorter + 1):
            low, high = F.lit(shift), size - q + shift
            out.append(F.struct(F.lit(0).alias("side"), size.alias("size"), _cut(word, low, q).alias("gram"), _cut(word, low + q, length).alias("rest")))
            out.append(F.struct(F.lit(1).alias("side"), size.alias("size"), _cut(word, high, q).alias("gram"), _cut(word, F.lit(0), high).alias("rest")))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): pairs of words one insertion, deletion or replacement apart, each once; a isn't the longer one."""
    word = F.col("word")
    length = F.length("word").cast("int")
    spread = lambda made: words.select("word", "n", F.explode(F.array_distinct(F.array(*made))).alias("c")).select("word", "n", "c.*")
    short, long = spread(_chunks(word, length)), spread(_grams(word, length))
    keys = ["side", "size", "gram"]
    hot = stored(short.groupBy(*keys).count().filter(F.col("count") > GROUP).select(*keys, F.lit(True).alias("hot")), "hot-chunks")

    def dealt(rows: DataFrame, deeper) -> DataFrame:
        """Rows with the key of their chunk, and in hot chunks one row for each key of the rest."""
        rest = F.length("rest").cast("int")
        none = F.struct(F.lit(0).alias("side"), F.lit(0).alias("size"), F.lit("").alias("gram"), F.lit("").alias("rest"))
        inner = F.when(F.col("hot"), F.array_distinct(F.array(*deeper(F.col("rest"), rest)))).otherwise(F.array(none))
        out = rows.join(hot, keys, "left").withColumn("d", F.explode(inner))
        return out.select("word", "n", *keys, F.col("d.side").alias("side2"), F.col("d.size").alias("size2"), F.col("d.gram").alias("gram2"))

    x, y = dealt(short, _chunks).alias("x"), dealt(long, _grams).distinct().alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*keys, "side2", "size2", "gram2")]
    once = (F.length("x.word") < F.length("y.word")) | (F.col("x.word") < F.col("y.word"))
    close = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    match = on[0]
    for c in (*on[1:], once, close):
        match = match & c
    return x.join(y, match).select(F.col("x.word").alias("a"), F.col("y.word").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the end of their chain of forms, by doubling the steps.

    Counts grow by ``LEAST_RATIO`` along a chain, so chains are short and have an end.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        at = at.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        at = stored(at, "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    ``form`` is the most frequent near word (of equal counts the first in code-point order) if it
    is ``LEAST_RATIO`` times as frequent, ``root`` the word that a chain of forms ends in.  NULL and
    empty texts have no words, a NULL key counts as the empty string in the noise, rows that repeat
    a key or a text are counted each.  Texts are read whole and a run of any length is one word.  An
    empty table gives no rows; other columns are ignored.  Counts are added up before they are
    shuffled, so a word that holds a third of all runs is one row of each task.
    """
    words = stored(word_counts(docs, key, text), "word-counts")
    pairs = stored(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
    found = words.join(best, "word", "left")
    takes = -F.col("best.m") >= LEAST_RATIO * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"))
    found = stored(found, "forms")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
