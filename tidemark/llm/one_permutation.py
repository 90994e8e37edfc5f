"""One-permutation MinHash fingerprints with optimal densification, packed to a few bits per bin.

A text is the set of its 5-word shingles (fewer words: the whole sequence).  Each shingle is
hashed once; the top bits choose a bin and the smallest hash of a bin is kept.  An empty bin
takes the value of a full one, found by hashing (bin, attempt) until a full bin is met, which
all documents do in the same way.  The lowest ``BITS`` bits of every bin make the fingerprint.
Two equal bins of a fingerprint may agree by chance, so likeness is corrected by
(share - c) / (1 - c) with c = 2**-BITS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import PIECE_BYTES, mix64, text_of
from tidemark.llm.wordhash import hashed_words, ngram_hashes

BIN_BITS = 9
BINS = 1 << BIN_BITS
BITS = 4
SHINGLE = 5
#: Attempts that are tabled; a bin still empty then takes the first full bin after it.
ATTEMPTS = 64

_try = (
    mix64(np.arange(BINS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + mix64(np.arange(1, ATTEMPTS + 1, dtype=np.uint64))[:, None])
    >> np.uint64(64 - BIN_BITS)
).astype(np.int64)


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the word shingles of each text; a text with fewer words has one, without words none."""
    words, first = hashed_words(texts)
    grams = ngram_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(grams[a : b - size + 1])
        elif b > a:
            out.append(ngram_hashes(words[a:b], b - a))
        else:
            out.append(grams[:0])
    return out


def fingerprint(hashes: np.ndarray) -> np.ndarray | None:
    """The low bits of every bin; None for a text without words."""
    if not len(hashes):
        return None
    ordered = np.sort(hashes)
    bins = (ordered >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    new = np.empty(len(bins), bool)
    new[0] = True
    np.not_equal(bins[1:], bins[:-1], out=new[1:])
    full = np.zeros(BINS, bool)
    low = np.zeros(BINS, np.uint8)
    at = bins[new]
    full[at] = True
    low[at] = (ordered[new] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    empty = np.flatnonzero(~full)
    for row in _try:
        if not len(empty):
            break
        donor = row[empty]
        ok = full[donor]
        low[empty[ok]] = low[donor[ok]]
        empty = empty[~ok]
    if len(empty):
        low[empty] = low[at[np.searchsorted(at, empty) % len(at)]]
    return low


def packed(low: np.ndarray | None) -> str:
    """Lowercase hex, one digit for each bin; the empty string for a text without words."""
    if low is None:
        return ""
    return ((low[0::2] << 4) | low[1::2]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Corrected share of equal bins, 0 to 1; two texts without words are alike, one is unlike any other."""
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    chance = 2.0**-BITS
    return float(max(0.0, (np.count_nonzero(a == b) / BINS - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row; NULL texts are empty, all other columns are ignored."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("text").to_pylist()
            for at, part in _runs([t.encode() for t in rows]):
                made = [packed(fingerprint(h)) for h in shingle_hashes(part)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(made, pa.string())], names=[key, "fingerprint"])

    plain = docs.select(F.col(key).alias(key), text_of(docs, text).alias("text"))
    return plain.mapInArrow(make, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def _runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_BYTES:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Documents that follow each other in one range, and the most ranges that are cut.
RANGE_ROWS, MOST_RANGES = 2000, 20_000

EDIT_DDL = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
EDIT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, each against the one after it."""
    raw = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
    own = [fingerprint(h) for _, part in _runs([t.encode() for t in texts]) for h in shingle_hashes(part)]
    other = [fingerprint(h) for _, part in _runs(raw) for h in shingle_hashes(part)]
    columns = [
        ids[: len(raw)],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(r).hexdigest() for r in raw],
        [packed(f) for f in own[:-1]],
        [packed(f) for f in other],
        [likeness(a, b) for a, b in zip(own, other)],
        [likeness(a, b) for a, b in zip(own, own[1:])],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EDIT)], schema=EDIT)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come range by range, each ended by the text that follows its last document."""
    ids, texts = [], []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256).to_pydict()
            for key, text, end in zip(part["doc_id"], part["text"], part["end"]):
                ids.append(key)
                texts.append(text)
                if end:
                    if len(texts) > 1:
                        yield _compare(ids, texts)
                    ids, texts = [], []
            if len(texts) > 1:
                yield _compare(ids, texts)
                ids, texts = ids[-1:], texts[-1:]


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    Documents follow each other by key (NULL first, rows that repeat a key by the hash of their
    text), the last by the first.  The keys are cut into ranges; one shuffle brings a range
    together, with the first text of the range after it as its end, and each row meets the next
    as they stream by.  What goes through the driver are the edges of the ranges, at most
    ``MOST_RANGES`` keys.
    """
    place = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    plain = docs.select(F.col(key).cast("bigint").alias("doc_id"), place.alias("place"), text_of(docs, text).alias("text"))
    keys = plain.select("place")
    ranges = min(MOST_RANGES, max(1, keys.count() // RANGE_ROWS))
    shares = [k / ranges for k in range(1, ranges)]
    edges = keys.agg(F.percentile_approx("place", shares, 20 * ranges).alias("e")).first()["e"] if shares else []
    edges = np.unique(np.array(edges or [], np.int64))

    @F.pandas_udf("int")
    def range_of(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, places.to_numpy(), "right").astype(np.int32))

    dealt = plain.withColumn("range", range_of("place")).withColumn("end", F.lit(False))
    # The first document of every range, which is also the end of the range before it.
    line = Window.orderBy("range")
    first = keys.withColumn("range", range_of("place")).groupBy("range").agg(F.min("place").alias("place"))
    before = first.withColumns({"before": F.lag("range").over(line), "last": F.max("range").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    heads = plain.join(F.broadcast(before.select("place", F.coalesce("before", "last").alias("range"))), "place")
    ends = heads.groupBy("range").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    ends = ends.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("place"), "text", "range", F.lit(True).alias("end"))
    rows = dealt.unionByName(ends).repartition("range").sortWithinPartitions("range", "end", "place", F.xxhash64("text"))
    return rows.select("doc_id", "text", "end").mapInArrow(_walk, EDIT_DDL)
