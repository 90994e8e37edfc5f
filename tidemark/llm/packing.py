"""Packing documents into token sequences by the configuration linear program.

A configuration is a multiset of lengths that fits into one sequence.  The program asks for the
smallest total of fractional amounts of configurations that covers every length as often as it
occurs.  Multiplicative weights solve it: a length gains weight while it lags behind, and a
knapsack dynamic program prices the configurations.  The same weights bound the optimum from
below.  The amounts are then rounded down, and up again where the demand allows it; what is left
goes into whole configurations that fill a sequence, and in the end best fit, longest first.
All of this works on the histogram (at most one entry for each length up to the capacity),
whatever the number of documents.  Tasks then look up the sequence of every piece by its rank
among equal lengths.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_of
from tidemark.llm.encoding import library_encoder

CAPACITY = 2048
#: Rounds of multiplicative weights, and how strongly the part still uncovered raises a weight.
ROUNDS, STEP = 40, 6.0
#: Rounds that price the program.
PRICED = 20
#: Shares of the demand that are tried for the program; the rest of each length is there to fill what rounding leaves.
SHARES = (1.0, 0.4)

PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    + [("block", pa.int32()), ("nth", pa.int64())]
)
PIECE_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, block int, nth bigint"


def knapsack(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity``: the largest total weight that fits, and the length to take first.

    ``lengths`` are in falling order; of equally good ones the longest is taken.  0 leaves one token free.
    """
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    since = np.searchsorted(-lengths, -np.arange(capacity + 1))
    for room in range(1, capacity + 1):
        n = since[room]
        if n < len(lengths):
            gain = value[room - lengths[n:]] + weights[n:]
            k = int(gain.argmax())
            if gain[k] > value[room - 1]:
                value[room], choice[room] = gain[k], lengths[n + k]
                continue
        value[room] = value[room - 1]
    return value, choice


def configuration(length: int, left: np.ndarray, lengths: np.ndarray, weights: np.ndarray, priced: tuple, capacity: int) -> dict[int, int]:
    """The best configuration that holds ``length``; a length whose demand is used up gives way to the next best.

    ``left`` is the demand by length, which is lowered by what the configuration takes once.
    """
    value, choice = priced
    out = {length: 1}
    left[length] -= 1
    room = capacity - length
    while room > 0:
        take = int(choice[room])
        if take and not left[take]:
            fits = lengths[(lengths <= room) & (left[lengths] > 0)]
            if not len(fits):
                break
            take = int(fits[(value[room - fits] + weights[fits]).argmax()])
        if take:
            out[take] = out.get(take, 0) + 1
            left[take] -= 1
        room -= take or 1
    return out


def fractional(histogram: dict[int, int], capacity: int, rounds: int = PRICED) -> tuple[dict[tuple, float], float]:
    """(amounts by configuration, lower bound of their total): the configuration program by multiplicative weights.

    In round t every length may be covered up to t / rounds of its demand.  The weight of a length is its size
    times exp(STEP * how far it lags behind that); one knapsack table prices the round.  Each length takes the
    best configuration that holds it and lengths that still lag, in the largest amount that they all allow, as
    long as that fills a sequence; else it waits and gains weight.  The last round takes what is missing in any
    configuration, so every demand is covered exactly.  Any weights bound the program from below by
    duality: the weight of the demand over that of the best configuration.
    """
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    demand, covered, weights = (np.zeros(capacity + 1) for _ in range(3))
    demand[lengths] = [histogram[x] for x in lengths.tolist()]
    amounts: dict[tuple, float] = defaultdict(float)
    bound = 0.0
    for t in range(1, rounds + 1):
        lag = t / rounds - covered[lengths] / demand[lengths]
        weights[lengths] = lengths * np.exp(STEP * (lag - lag.mean()))
        priced = knapsack(lengths, weights[lengths], capacity)
        bound = max(bound, float(demand[lengths] @ weights[lengths] / priced[0][capacity]))
        left = demand * t / rounds - covered
        left[left < 1e-9 * demand] = 0.0
        for length in lengths.tolist():
            while left[length] > 0:
                config = _open_configuration(length, left > 0, lengths, weights, priced, capacity)
                if t < rounds and sum(x * k for x, k in config.items()) != capacity:
                    break
                amount, least = min((left[x] / k, x) for x, k in config.items())
                for x, k in config.items():
                    left[x] = max(0.0, left[x] - k * amount)
                    covered[x] += k * amount
                left[least] = 0.0
                amounts[tuple(sorted(config.items(), reverse=True))] += amount
    return dict(amounts), bound


def _open_configuration(length: int, is_open: np.ndarray, lengths: np.ndarray, weights: np.ndarray, priced: tuple, capacity: int) -> dict[int, int]:
    """The best configuration that holds ``length``; a length that is not open gives way to the next best."""
    value, choice = priced
    out, room = {length: 1}, capacity - length
    while room > 0:
        take = int(choice[room])
        if take and not is_open[take]:
            fits = lengths[(lengths <= room) & is_open[lengths]]
            if not len(fits):
                break
            take = int(fits[(value[room - fits] + weights[fits]).argmax()])
        if take:
            out[take] = out.get(take, 0) + 1
        room -= take or 1
    return out


def rounded(amounts: dict[tuple, float], histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole numbers of configurations, and the histogram of what they leave.

    Amounts are rounded down first, then up by falling fraction, each as far as no length's demand stands
    against it.  Only configurations that fill a sequence completely are taken.
    """
    left = dict(histogram)
    out: Counter = Counter()
    full = [(c, x) for c, x in amounts.items() if sum(length * k for length, k in c) == capacity]
    up = sorted(((c, 1) for c, x in full), key=lambda p: (int(amounts[p[0]]) - amounts[p[0]], p[0]))
    for config, most in [(c, int(x)) for c, x in full] + up:
        n = min([most, *(left.get(length, 0) // k for length, k in config)])
        if n > 0:
            out[config] += n
            for length, k in config:
                left[length] -= n * k
    return [(dict(c), n) for c, n in out.items()], {x: n for x, n in left.items() if n}


def cover(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """What rounding leaves: whole numbers of configurations, and the histogram of what stays.

    Multiplicative weights on the covering program: the weight of a length is its size times
    exp(STEP * the share of its demand that is uncovered).  One knapsack table prices a round,
    and gives for each length the best configuration that holds it.  A round is meant to cover
    an equal part of what is left of each length; the number of sequences for that is rounded
    down to a whole number (one at least) that no length's demand stands against.  Only
    configurations that fill a sequence completely are taken.
    """
    demand, left = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    demand[list(histogram)] = left[list(histogram)] = list(histogram.values())
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    out: dict[tuple, int] = {}
    for t in range(rounds):
        lengths = lengths[left[lengths] > 0]
        if not len(lengths):
            break
        share = left[lengths] / demand[lengths]
        weights = np.zeros(capacity + 1)
        weights[lengths] = lengths * np.exp(STEP * (share - share.mean()))
        priced = knapsack(lengths, weights[lengths], capacity)
        moved = 0
        for length in lengths.tolist():
            if not left[length]:
                continue
            part = int(left[length] / (rounds - t))
            config = configuration(length, left, lengths, weights, priced, capacity)
            if sum(x * k for x, k in config.items()) != capacity:
                for x, k in config.items():
                    left[x] += k
                continue
            n = 1 + min([max(0, part // config[length] - 1), *(int(left[x]) // k for x, k in config.items())])
            for x, k in config.items():
                left[x] -= (n - 1) * k
            name = tuple(sorted(config.items(), reverse=True))
            out[name] = out.get(name, 0) + n
            moved += n
        if not moved:
            break
    return [(dict(config), n) for config, n in out.items()], {x: int(left[x]) for x in histogram if left[x]}


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on a histogram: (configuration, number of sequences)."""
    free: dict[int, list] = defaultdict(list)  # room left: [configuration, sequences]
    rooms: list[int] = []  # sorted keys of free

    def put(room: int, config: dict, n: int) -> None:
        if n:
            if room not in free or not free[room]:
                if room not in free or room not in rooms:
                    bisect.insort(rooms, room)
            free[room].append([config, n])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                n = left // each
                put(capacity - each * length, {length: each}, n)
                left -= n * each
                if left:
                    put(capacity - left * length, {length: left}, 1)
                left = 0
                continue
            room = rooms[k]
            if not free[room]:
                rooms.pop(k)
                continue
            config, n = free[room].pop()
            each = room // length
            use = min(n, left // each)
            if use:
                put(room - each * length, config | {length: config.get(length, 0) + each}, use)
                left -= use * each
                n -= use
            if n and left:  # less than one sequence takes
                put(room - left * length, config | {length: config.get(length, 0) + left}, 1)
                n, left = n - 1, 0
            if n:
                free[room].append([config, n])
    return [(config, n) for room in free for config, n in free[room] if n]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(configuration, number of sequences) that hold every length of the histogram exactly as often as it occurs."""
    left = {x: n for x, n in histogram.items() if 0 < x < capacity and n}
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    if not left:
        return out

    found = []
    amounts, _ = fractional(left, capacity)
    for share in SHARES:
        part = {x: int(n * share) for x, n in left.items()}
        whole, rest = rounded({c: x * share for c, x in amounts.items()}, {x: n for x, n in part.items() if n}, capacity)
        covered, rest = cover(rest, capacity)
        for x, n in left.items():
            rest[x] = rest.get(x, 0) + n - part[x]
        found.append(whole + covered + best_fit({x: n for x, n in rest.items() if n}, capacity))
    return out + min(found, key=lambda f: sum(n for _, n in f))


def slots(packed: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: runs of ``copies`` pieces in consecutive sequences."""
    next_rank: Counter = Counter()
    rows, sequence = [], 0
    for config, n in packed:
        at = 0
        for length in sorted(config, reverse=True):
            copies = config[length]
            rows.append((length, next_rank[length], copies, sequence, at))
            next_rank[length] += copies * n
            at += copies * length
        sequence += n
    rows.sort()
    names = ("length", "rank", "copies", "sequence", "offset")
    return {n: np.array([r[k] for r in rows], np.int64) for k, n in enumerate(names)}


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Pieces of every document: its ids and the id ``end``, cut into ``capacity`` tokens if longer.

    A shorter piece of a cut document is its first.  ``nth`` numbers the pieces of one length
    inside a task (``block``).  NULL is the empty text: one piece of one token.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = library_encoder(tokenizer), TaskContext.get().partitionId()
        seen: Counter = Counter()
        last = end.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, ids in zip(part.column("doc").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    ids += last
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), block, seen[b - a]))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE)], schema=PIECE)

    plain = docs.select(F.col(key).cast("bigint").alias("doc"), text_of(docs, text).alias("text"))
    return plain.mapInArrow(cut, PIECE_DDL)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of pieces that are stored.

    Equal lengths are numbered by task and place in the task, from counts per task and length;
    a length that very many documents share is never in one task.
    """
    spark = pieces.sparkSession
    counts = stored(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = spark.sparkContext.broadcast(slots(pack_histogram(histogram, capacity), capacity))
    line = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "block", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "block"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        key = table["length"] * (1 << 48) + table["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            nth, copies = rank - table["rank"][k], table["copies"][k]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            sequence, offset = table["sequence"][k] + nth // copies, table["offset"][k] + nth % copies * length
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, ddl)


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` tokens; see ``token_pieces`` and ``pack``.

    Repeated rows and NULL keys give their pieces like any other row; other columns are ignored.
    """
    return pack(stored(token_pieces(docs, tokenizer, key, text, capacity, end), "pieces"), capacity)
