"""Byte-pair encoding through a lexicon automaton, and decoding.

The most frequent words of the corpus are compiled into a minimal acyclic transducer:
words with the same remaining suffixes share states, and the outputs along a path add up
to the number of the word, which points to its token ids.  The arrays of the automaton are
one file that every task maps into memory.  All distinct words of a batch walk through it
together; a word it does not know is merged pair by pair, so the ids are exact for any text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, stored, text_of
from tidemark.llm.encoding import LAST_LATIN, WORD_PATTERN, PieceEncoder, byte_characters, ranked_encoder, safe_pieces, to_bytes

#: Words in the lexicon. A bound on the file that is sent to the executors, not on the words that are encoded.
LEXICON_WORDS = 65_536
#: Longer words (in bytes) are merged without looking in the lexicon.
LEXICON_BYTES = 64


class Merger:
    """A byte-level vocabulary: ids of one word by repeated merging of the best pair, and bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        pre = setup.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or setup.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        vocab = setup["model"]["vocab"]
        back = {c: b for b, c in byte_characters().items()}
        self.token = {k: bytes(back[c] for c in t) for t, k in vocab.items() if all(c in back for c in t)}
        self.special = {t["content"]: t["id"] for t in setup.get("added_tokens") or []}
        self.token.update({k: t.encode() for t, k in self.special.items()})
        self.byte = [vocab[byte_characters()[b]] for b in range(256)]
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(setup["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pair[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.pattern = regex.compile(WORD_PATTERN)
        self.ranked = ranked_encoder(setup)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: while any adjacent pair can be merged, merge the earliest of lowest rank."""
        ids = [self.byte[b] for b in word]
        if len(ids) > 256:
            return self._merge_long(ids)
        none = (1 << 60, 0)
        ranks = [self.pair.get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = self.pair.get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = self.pair.get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long word, with a heap over a linked list: n log n steps."""
        import heapq

        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        heap = [(*self.pair[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.pair]
        heap = [(rank, k, made) for rank, made, k in heap]
        heapq.heapify(heap)
        gone = [False] * len(ids)
        while heap:
            rank, k, made = heapq.heappop(heap)
            nxt = after[k]
            if gone[k] or nxt < 0 or self.pair.get((ids[k], ids[nxt])) != (rank, made):
                continue
            ids[k], gone[nxt] = made, True
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (found := self.pair.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, found[1]))
        return [i for i, g in zip(ids, gone) if not g]

    def words(self, text: str) -> list[bytes]:
        return [w.encode() for w in self.pattern.findall(text)]

    def ids_of(self, word: str) -> bytes:
        """Packed ids of one word; Latin words are merged by a library that knows the same ranks."""
        if self.ranked and max(word) <= LAST_LATIN:
            return to_bytes(self.ranked(word))
        return to_bytes(self.merge(word.encode()))

    def encode_whole(self, text: str) -> bytes:
        """Ids of a text that holds special strings: these become their own ids."""
        out, at = [], 0
        for found in self.special_pattern.finditer(text):
            out += [i for w in self.words(text[at : found.start()]) for i in self.merge(w)] + [self.special[found[0]]]
            at = found.end()
        return to_bytes(out + [i for w in self.words(text[at:]) for i in self.merge(w)])


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic transducer of some words (no empty one) with their ids.

    Words go in in byte order; once a word leaves the path of the one before it, the states
    below are final and are replaced by an equal state if there is one, so equal suffixes are
    stored once.  The output of an arc is the number of words that come before those through
    it, among the words that reach its state.
    """
    order = sorted(words)
    children: list[list[tuple[int, int]]] = [[]]  # per state: (byte, state), by byte
    accepts = [False]
    known: dict[tuple, int] = {}
    path, last = [0], b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            same = known.setdefault((accepts[state], tuple(children[state])), state)
            if same != state:
                children[path[-1]][-1] = (children[path[-1]][-1][0], same)

    for word in order:
        shared = next((k for k, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(shared)
        for b in word[shared:]:
            children.append([])
            accepts.append(False)
            children[path[-1]].append((b, len(children) - 1))
            path.append(len(children) - 1)
        accepts[path[-1]] = True
        last = word
    close(0)

    below: dict[int, int] = {}

    def count(root: int) -> None:
        stack = [(root, False)]
        while stack:
            s, done = stack.pop()
            if s in below:
                continue
            if done:
                below[s] = accepts[s] + sum(below[t] for _, t in children[s])
            else:
                stack.append((s, True))
                stack += [(t, False) for _, t in children[s] if t not in below]

    count(0)
    number = {s: k for k, s in enumerate(sorted(below))}  # the start has number 0
    arcs = []
    for s in sorted(below):
        passed = int(accepts[s])
        for b, t in children[s]:
            arcs.append((number[s] * 256 + b, number[t], passed))
            passed += below[t]
    table = np.array(arcs, np.int64).reshape(-1, 3)
    ids = [words[w] for w in order]
    return {
        "arc": table[:, 0].copy(),
        "target": table[:, 1].copy(),
        "output": table[:, 2].copy(),
        "accepts": np.array([accepts[s] for s in sorted(below)], np.int64),
        "ids_from": np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64),
        "ids": np.array([x for i in ids for x in i], np.int64),
    }


def save_lexicon(arrays: dict[str, np.ndarray], path: str) -> None:
    """One flat file: a line of JSON with the lengths, then the arrays as 64-bit integers."""
    with open(path, "wb") as f:
        f.write(json.dumps({k: len(a) for k, a in arrays.items()}).encode().ljust(255) + b"\n")
        for a in arrays.values():
            f.write(a.astype("<i8").tobytes())


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lengths = json.loads(f.read(256))
        whole = np.memmap(path, "<i8", "r", offset=256) if sum(lengths.values()) else np.zeros(0, np.int64)
        at = 0
        for name, n in lengths.items():
            setattr(self, name, whole[at : at + n])
            at += n

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if the lexicon lacks it: all words take a step at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((size > 0) & (size <= LEXICON_BYTES))
        if not len(live) or not len(self.arc):
            return out
        raw = np.frombuffer(b"".join(words), np.uint8)
        at = (np.cumsum(size) - size)[live]
        state, total, left = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), size[live]
        while len(live):
            wanted = state * 256 + raw[at]
            arc = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
            ok = self.arc[arc] == wanted
            live, at, arc, left, total = live[ok], at[ok] + 1, arc[ok], left[ok] - 1, total[ok] + self.output[arc[ok]]
            state = self.target[arc]
            ended = left == 0
            hit = ended & (self.accepts[state] == 1)
            out[live[hit]] = total[hit]
            live, at, left, total, state = live[~ended], at[~ended], left[~ended], total[~ended], state[~ended]
        return out

    def ids_of(self, number: int) -> bytes:
        return self.ids[self.ids_from[number] : self.ids_from[number + 1]].astype("<u4").tobytes()

    def packed(self, numbers: np.ndarray) -> list[bytes]:
        """Ids of many words; empty for -1."""
        if not len(self.ids):
            return [b""] * len(numbers)
        raw = np.asarray(self.ids).astype("<u4").tobytes()
        at = np.where(numbers < 0, 0, numbers)
        first, end = self.ids_from[at] * 4, np.where(numbers < 0, self.ids_from[at], self.ids_from[at + 1]) * 4
        return [raw[a:b] for a, b in zip(first.tolist(), end.tolist())]


def lexicon_encoder(lexicon: Lexicon, vocabulary: Merger) -> PieceEncoder:
    """Encoder of whole texts: pieces are cut into words, known words take ids from the lexicon."""

    findall = vocabulary.pattern.findall

    def pieces(texts: list[str]) -> list[bytes]:
        cut = [findall(t) for t in texts]
        distinct = list({w for ws in cut for w in ws})
        found = lexicon.find([w.encode() for w in distinct])
        known = lexicon.packed(found)
        ids = {w: k if n >= 0 else vocabulary.ids_of(w) for w, n, k in zip(distinct, found.tolist(), known)}
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in cut]

    return PieceEncoder(pieces, vocabulary.encode_whole, list(vocabulary.special))


_encoders: dict[str, PieceEncoder] = {}


def _task_encoder(file: str, tokenizer: str) -> PieceEncoder:
    """The encoder of this worker; one lexicon at a time."""
    if file not in _encoders:
        _encoders.clear()
        _encoders[file] = lexicon_encoder(Lexicon(SparkFiles.get(file)), merger(tokenizer))
    return _encoders[file]


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task (space in front included) with their counts, flushed when there are many."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    pattern = regex.compile(WORD_PATTERN)

    inner: Counter = Counter()  # pieces that follow a space, without it
    outer: Counter = Counter()

    def flush() -> pa.RecordBatch:
        totals: Counter = Counter()
        for front, counts in ((" ", inner), ("", outer)):
            for piece, n in counts.items():
                for word in pattern.findall(front + piece):
                    totals[word] += n
        kept = [(w.encode(), n) for w, n in totals.items()]
        kept = [x for x in kept if len(x[0]) <= LEXICON_BYTES]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], schema=schema)

    for batch in batches:
        for text in batch.column("text").to_pylist():
            parts = text.split(" ")
            if "" in parts[1:]:
                outer.update(safe_pieces(text))
            else:
                outer[parts[0]] += 1
                inner.update(parts[1:])
            if len(inner) + len(outer) > 400_000:
                yield flush()
                inner.clear()
                outer.clear()
    yield flush()


def count_step(n: Column) -> Column:
    """Lower end of the step of a count: its four top bits."""
    drop = F.greatest(F.lit(0), F.length(F.bin(n)) - 4)
    return (F.floor(n / F.pow(F.lit(2), drop)) * F.pow(F.lit(2), drop)).cast("bigint")


def build_lexicon(docs: DataFrame, tokenizer: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Count the words of all texts, compile the most frequent and ship the file; returns its name.

    At most ``words`` words come to the driver: those of a count as high as possible.  A corpus
    in which no word occurs twice gives an empty lexicon.
    """
    spark = docs.sparkSession
    counted = docs.select(text_of(docs, text).alias("text")).mapInArrow(_word_counter, "word binary, n bigint")
    totals = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "words")
    # The least count whose words are not too many, from a table of counts in log-linear steps.
    steps = totals.groupBy(count_step(F.col("n")).alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    least, taken = None, 0
    for row in steps:
        taken += row["words"]
        if taken > words:
            break
        least = row["step"]
    top = totals.filter(F.col("n") >= F.lit(least)) if least is not None else totals.limit(0)
    vocabulary = merger(tokenizer)
    arrays = compile_lexicon({bytes(r["word"]): vocabulary.merge(bytes(r["word"])) for r in top.collect()})
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "lexicon")
    save_lexicon(arrays, path)
    with open(path, "rb") as f:
        name = f"lexicon-{hashlib.file_digest(f, 'sha256').hexdigest()[:24]}-{os.path.basename(new_folder(spark, 'x'))}"
    os.rename(path, path := os.path.join(os.path.dirname(path), name))
    spark.sparkContext.addFile(path)
    return name


def _coder(file: str, tokenizer: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = _task_encoder(file, tokenizer), merger(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encoder.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([decode(vocabulary, i) for i in ids], pa.string())],
                    names=[part.schema.names[0], "ids", "decoded"],
                )

    return code


def decode(vocabulary: Merger, ids: bytes) -> str:
    """Text of little-endian 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
    token = vocabulary.token
    return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", lexicon: str | None = None) -> DataFrame:
    """(key, ids, decoded) of every row: token ids as packed 32-bit integers, and the text they decode to.

    ``lexicon`` is a name from ``build_lexicon``; by default one is built from these texts.
    NULL is the empty text, which has no ids.  Special strings inside a text become their own
    ids and decode to themselves.  Every row gives a row, with repeated and NULL keys too;
    all other columns are ignored.
    """
    lexicon = lexicon or build_lexicon(docs, tokenizer, text)
    plain = docs.select(F.col(key).alias(key), text_of(docs, text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return plain.mapInArrow(_coder(lexicon, tokenizer), f"`{key}` {kind}, ids binary, decoded string")
