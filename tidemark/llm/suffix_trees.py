"""Removal of repeated word windows with prefix-partitioned suffix trees.

A suffix starts at a word of a document and is followed to the depth of one window (20 words).
Suffixes are grouped by a prefix, and within a group the nodes at window depth with two or more
suffixes below them are the repeats; every suffix but the first under such a node is one.

* Anchors.  Of the 5-word prefixes inside a window the one with the smallest hash stands for it,
  so equal windows meet at the same prefix at the same distance, and only one suffix in about
  seven has to travel.  The paths of the windows that an anchor stands for go with it as hashes.
* Pruning.  A first pass counts the prefixes; one that occurs once cannot start a repeat.
  The prefixes that occur more often come back as a bitmap of fixed size, in which a clash
  only lets a prefix through that has no repeat.
* Variable length.  A prefix with more than ``GROUP`` suffixes is lengthened to the whole
  window, so its group falls apart into the nodes of the tree; a second bitmap tells which.
* Combining.  Within a task, equal windows are reduced to the first one before the shuffle, so
  a passage that very many documents share reaches its group once for each task.

Paths are compared by 128 bits of hash (64 of the window, 64 of its prefix).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, pieces, stored, text_of
from tidemark.llm.wordhash import hashed_words, ngram_hashes

WINDOW = 20
PREFIX = 5
SPAN = WINDOW - PREFIX + 1
#: Suffixes that one group may have before its prefix is lengthened.
GROUP = 4_000
#: Bits of the two bitmaps (16 MB and 1 MB): a fixed size, whatever the size of the corpus.
REPEATED_BITS, LONG_BITS = 27, 23

SUFFIX = pa.schema([("prefix", pa.int64()), ("doc", pa.int64()), ("at", pa.int32()), ("reach", pa.int32()), ("paths", pa.binary())])
SUFFIX_DDL = "prefix bigint, doc bigint, at int, reach int, paths binary"
NODE = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
NODE_DDL = "doc bigint, start int, end int"


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window starts, their anchors (both as word indexes), the text of each window, and prefix hashes.

    The anchor of a window is its 5-word prefix with the smallest hash, the first of equals.
    """
    grams = ngram_hashes(words, PREFIX)
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, grams
    value, place = grams, np.arange(len(grams), dtype=np.int32)
    width = 1
    while width < SPAN:  # smallest of runs of 1, 2, 4, 8 and 16 prefixes
        a, b = value[:-width], value[width:]
        later = b < a
        place = np.where(later, place[width:], place[:-width])
        value = np.where(later, b, a)
        width *= 2
    starts = np.arange(n)
    owner = np.searchsorted(first, starts, "right") - 1
    inside = starts + WINDOW <= first[owner + 1]
    return starts[inside], place[:n][inside].astype(np.int64), owner[inside], grams


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("prefix", pa.int64()), ("n", pa.int64())])
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(_signed(found)), pa.array(n.astype(np.int64))], schema=schema)

    for batch in batches:
        for _, texts in pieces(batch):
            words, first = hashed_words(texts)
            _, place, _, grams = anchors(words, first)
            held.append(grams[np.unique(place)])
            size += len(held[-1])
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _bitmap(counts: DataFrame, bits: int) -> bytes:
    """Bits of the prefixes of a table, by their lowest ``bits`` bits, as one byte string.

    At most 2**bits / 32768 rows of 4 KB come to the driver.
    """
    place = F.col("prefix").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = counts.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    size = min(32768, 1 << bits) // 8
    out = bytearray((1 << bits) // 8)
    for row in rows.collect():
        at = (row["k"] - 1) * size
        out[at : at + size] = row["bits"][:size]
    return bytes(out)


def _has(bitmap: np.ndarray, bits: int, prefixes: np.ndarray) -> np.ndarray:
    place = prefixes & np.uint64((1 << bits) - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Windows that a task holds before it combines equal ones and hands them on.
COMBINE = 1_000_000


def _not_first(doc: np.ndarray, start: np.ndarray, *node: np.ndarray) -> np.ndarray:
    """Windows that are not the first under their node, by document and start.

    The same place met twice (a repeated row) is no repeat of itself.
    """
    order = np.lexsort((start, doc, *node))
    again = np.zeros(len(order), bool)
    again[1:] = True
    for x in node:
        y = x[order]
        again[1:] &= y[1:] == y[:-1]
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    d, s = doc[order], start[order]
    out = np.zeros(len(order), bool)
    out[order] = again & ((d != d[head]) | (s != s[head]))
    return out


def _suffixes(repeated, long):
    """Suffixes at anchors whose prefix may occur again, with the paths of the windows they stand for.

    Windows that repeat an earlier one of this task need no comparison any more: they travel as
    bare spans (``reach`` holds their number, negative), dealt by document.
    """

    def emit(held: list[tuple[np.ndarray, ...]], more: np.ndarray) -> pa.RecordBatch:
        doc, start, reach, prefix, path = (np.concatenate(x) for x in zip(*held))
        known = _not_first(doc, start, path, reach, prefix)
        # A lengthened prefix is the whole window: one suffix for each.
        deep = _has(more, LONG_BITS, prefix) & ~known
        run = np.ones(len(doc), bool)
        run[1:] = (
            (doc[1:] != doc[:-1])
            | (start[1:] != start[:-1] + 1)
            | (start[1:] + reach[1:] != start[:-1] + reach[:-1])
            | (known[1:] != known[:-1])
            | deep[1:]
        )
        at = np.flatnonzero(run)
        ends = np.append(at[1:], len(doc))
        raw = path.astype("<u8").tobytes()
        spread = mix64(doc.view(np.uint64) + start.astype(np.uint64))
        group = np.where(known, spread, np.where(deep, prefix ^ (path * np.uint64(0x9E3779B97F4A7C15)), prefix))[at]
        paths = [b"" if k else raw[8 * x : 8 * y] for x, y, k in zip(at.tolist(), ends.tolist(), known[at].tolist())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(_signed(group)),
                pa.array(doc[at], pa.int64()),
                pa.array(start[at].astype(np.int32)),
                pa.array(np.where(known[at], at - ends, reach[at]).astype(np.int32)),
                pa.array(paths, pa.binary()),
            ],
            schema=SUFFIX,
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, more = np.frombuffer(repeated.value, np.uint8), np.frombuffer(long.value, np.uint8)
        held, size = [], 0
        for batch in batches:
            for part, texts in pieces(batch):
                docs = part.column("doc").to_numpy(zero_copy_only=False)
                words, first = hashed_words(texts)
                starts, place, owner, grams = anchors(words, first)
                keep = _has(seen, REPEATED_BITS, grams[place])
                starts, place, owner = starts[keep], place[keep], owner[keep]
                if not len(starts):
                    continue
                paths = ngram_hashes(words, WINDOW)[starts]
                held.append((docs[owner], starts - first[owner], place - starts, grams[place], paths))
                size += len(starts)
                if size >= COMBINE:
                    yield emit(held, more)
                    held, size = [], 0
        if held:
            yield emit(held, more)

    return make


def _unfold(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """One entry for each window of some suffixes: group, distance to the anchor, path, document, start."""
    column = part.column("paths")
    size = np.array([len(v.as_buffer()) // 8 for v in column], np.int64)
    path = np.frombuffer(b"".join(v.as_py() for v in column), "<u8")
    step = np.arange(len(path)) - np.repeat(np.cumsum(size) - size, size)
    spread = lambda name: np.repeat(part.column(name).to_numpy(zero_copy_only=False), size)
    return spread("prefix"), spread("reach") - step, path, spread("doc"), spread("at") + step


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that are not the first under their node; suffixes come ordered by prefix.

    The last group of a batch may go on in the next: of it only the first window of each node
    is carried over, so the memory is that of the different windows of one group.  Documents of
    a group come in order, so what is carried stays the first.
    """
    carried: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        reach = batch.column("reach").to_numpy(zero_copy_only=False)
        if (reach < 0).any():
            bare = batch.filter(pa.array(reach < 0))
            start, doc = bare.column("at").to_numpy(), bare.column("doc").to_numpy()
            yield _spans(doc, start, start + WINDOW - 1 - bare.column("reach").to_numpy())
            batch = batch.filter(pa.array(reach >= 0))
        for at in range(0, batch.num_rows, 100_000):
            fresh = _unfold(batch.slice(at, 100_000))
            old = 0 if carried is None else len(carried[0])
            group, reach, path, doc, start = fresh if carried is None else (np.concatenate(x) for x in zip(carried, fresh))
            repeat = _not_first(doc, start, path, reach, group)
            fresh_repeat = repeat.copy()
            fresh_repeat[:old] = False
            if fresh_repeat.any():
                yield _spans(doc[fresh_repeat], start[fresh_repeat], start[fresh_repeat] + WINDOW)
            kept = (group == group[-1]) & ~repeat
            carried = tuple(x[kept] for x in (group, reach, path, doc, start))


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans joined where they overlap or touch: the maximal repeats of what is at hand."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    # Spans of one document: the furthest end so far, kept apart by a step for each document.
    step = np.cumsum(np.append(False, doc[1:] != doc[:-1])) * (int(end.max()) + 1)
    reached = np.maximum.accumulate(end + step)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + step[1:] > reached[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[at], pa.int64()), pa.array(start[at].astype(np.int32)), pa.array((reached - step)[last].astype(np.int32))], schema=NODE
    )


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, end): word spans covered by windows that also start earlier in the corpus.

    Earlier is in a document of smaller key, or further left in the same one.  Spans of one
    document may overlap; together they cover each repeated window and nothing else.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("bigint").alias("doc"), text_of(docs, text).alias("text")).filter("doc IS NOT NULL")
    counts = stored(
        plain.select("text").mapInArrow(_prefix_counts, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n")).filter("n > 1"),
        "prefixes",
    )
    repeated = spark.sparkContext.broadcast(_bitmap(counts, REPEATED_BITS))
    long = spark.sparkContext.broadcast(_bitmap(counts.filter(F.col("n") > GROUP), LONG_BITS))
    suffixes = plain.mapInArrow(_suffixes(repeated, long), SUFFIX_DDL)
    dealt = suffixes.repartition("prefix").sortWithinPartitions("prefix", "doc", "at")
    return dealt.mapInArrow(_nodes, NODE_DDL)


def _covered(words: int, spans: list) -> np.ndarray:
    edge = np.zeros(words + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


def _left(raw: bytes, spans: list | None) -> tuple[int, bytes | None]:
    """Number of words of a text, and the words left, joined by one space; None if all of them are."""
    words = raw.split()
    if not spans:
        return len(words), None
    gone = _covered(len(words), [(s["start"], s["end"]) for s in spans])
    return len(words), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def _with_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    found = repeats(docs, key, text).groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    return docs.join(found, docs[key].cast("bigint") == F.col("__doc"), "left").drop("__doc")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept) of every row: ``kept`` are the words left, joined by one space.

    A NULL text has no words.  Texts shorter than a window keep all their words, as do rows with
    a NULL key, which have no place in the order.  A key names a document: rows that repeat a
    key are read as one document, whose windows do not repeat themselves.  All other columns are
    ignored.
    """
    plain = docs.select(F.col(key).cast("bigint").alias(key), text_of(docs, text).alias("text"))
    schema = pa.schema([(key, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                made = []
                for raw, spans in zip(texts, part.column("__spans").to_pylist()):
                    n, left = _left(raw, spans)
                    kept = b" ".join(raw.split()) if left is None else left
                    made.append((n, n - len(kept.split()), kept.decode()))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*made), list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    return _with_spans(plain, key, "text").mapInArrow(cut, f"`{key}` bigint, n_words bigint, n_removed bigint, kept string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated windows cut out of the text; rows that lose nothing stay exactly as they are.

    A text that loses words becomes its words that are left, joined by one space.
    """
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text):
                made = part.column(text).to_pylist()
                for k, (raw, spans) in enumerate(zip(texts, part.column("__spans").to_pylist())):
                    left = _left(raw, spans)[1] if spans else None
                    if left is not None:
                        made[k] = left.decode()
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if c == text else part.column(c) for c in columns], names=columns)

    return _with_spans(docs, key, text).mapInArrow(cut, docs.schema)
