"""SentencePiece BPE through a table of prefixes, and decoding.

Every prefix of a text has one encoding, so one last token.  The table holds it for each prefix,
from left to right: of the pieces that an automaton finds to end there, it is the one that stands
next to the last token of the shorter prefix before it without being merged with it.  The ids are
then read from the end of the text backwards.

Why one pair at a time is enough: merges inside two neighbours don't see each other, so tokens are
the encoding of their text exactly if each is the encoding of its own characters and no merge
ever crosses from one to the next.  Whether one does follows from the two alone: their own merges,
in the order in which they happen, and the symbols that meet at the border meanwhile.

Texts are cut in front of runs of spaces and of line ends, where no piece of the model reaches
across, and each worker keeps the ids of the units it has met.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.encoding import to_bytes

#: Fixed value: the character that stands for a space in the pieces of a model.
SPACE = "▁"
#: Entries of a worker's memos of units and of pairs; each is emptied when it grows past this.
UNITS, PAIRS = 500_000, 1_000_000
#: Longer units (in characters) aren't kept.
UNIT_CHARS = 64

_NEVER = float("inf")
_RUNS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")


class Pieces:
    """The pieces of a BPE model file, and the encoder over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "ﬁ①  é　 x\t"
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path} changes texts before it encodes them")
        self.id: dict[str, int] = {}
        self.rank: dict[str, float] = {}  # merges happen from the lowest on
        self.unknown = [model.unk_id()]
        self.byte: dict[int, int] = {}
        self.text: list[bytes] = []  # what each id decodes to
        self.automaton = ahocorasick.Automaton()
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                self.text.append(model.decode([k]).encode())
            elif model.is_unused(k):
                raise ValueError(f"{path} has unused pieces")
            else:
                self.id[piece], self.rank[piece] = k, -model.get_score(k)
                self.automaton.add_word(piece, piece)
                self.text.append(piece.replace(SPACE, " ").encode())
        self.automaton.make_automaton()
        self.leads = [t[:1] == b" " and self.id.get(SPACE + t[1:].decode().replace(" ", SPACE)) == k for k, t in enumerate(self.text)]
        across = any(a != SPACE and b == SPACE for p in self.id for a, b in zip(p, p[1:]))
        self.cuts = not across and not any("\n" in p and len(p) > 1 for p in self.id)
        self.histories: dict[str, list[tuple[float, str, str]] | None] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.known_pairs = 0
        self.units: dict[str, bytes] = {}

    def history(self, piece: str) -> list[tuple[float, str, str]] | None:
        """(rank, first, last symbol after it) of each merge that makes ``piece``; None if its characters merge to something else."""
        if piece in self.histories:
            return self.histories[piece]
        symbols, steps = list(piece), []
        while len(symbols) > 1:
            ranks = [self.rank.get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == _NEVER:
                break
            k = ranks.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            steps.append((best, symbols[0], symbols[-1]))
        self.histories[piece] = found = steps if len(symbols) == 1 else None
        return found

    def _meets(self, a: str, b: str) -> bool:
        before, after = self.history(a), self.history(b)
        if before is None or after is None:
            return False
        left, right, i, j = a[-1], b[0], 0, 0
        while True:
            across = self.rank.get(left + right, _NEVER)
            x = before[i][0] if i < len(before) else _NEVER
            y = after[j][0] if j < len(after) else _NEVER
            if across < x and across <= y:  # of equal ranks the leftmost goes first
                return False
            if x <= y:
                if x == _NEVER:
                    return True
                left, i = before[i][2], i + 1
            else:
                right, j = after[j][1], j + 1

    def compatible(self, a: str, b: str) -> bool:
        """Whether the encoding of the two tokens' text is these two tokens."""
        found = self.pairs.get(a, {}).get(b)
        if found is None:
            if self.known_pairs >= PAIRS:
                self.pairs, self.known_pairs = {}, 0
            found = self.pairs.setdefault(a, {})[b] = self._meets(a, b)
            self.known_pairs += 1
        return found

    def tokens(self, unit: str) -> list[str]:
        """Tokens of a string as pieces; a character that no piece covers is a token of its own."""
        last = [""] * (len(unit) + 1)
        for end, piece in self.automaton.iter(unit):
            end += 1
            if last[end]:
                continue
            at = end - len(piece)
            if at:
                before = last[at] or unit[at - 1]
                try:
                    fits = self.pairs[before][piece]
                except KeyError:
                    fits = self.compatible(before, piece)
            else:
                fits = self.history(piece) is not None
            if fits:
                last[end] = piece
        out, at = [], len(unit)
        while at:
            piece = last[at] or unit[at - 1]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def _packed(self, unit: str) -> bytes:
        tokens = self.tokens(unit)
        try:
            return to_bytes([self.id[piece] for piece in tokens])
        except KeyError:  # characters without a piece
            fallback = lambda piece: [self.byte[b] for b in piece.encode()] if self.byte else self.unknown
            return to_bytes([k for piece in tokens for k in ([self.id[piece]] if piece in self.id else fallback(piece))])

    def _unit(self, key: str) -> bytes:
        """Ids of a unit. The key of one that starts with a space lacks that space; others start with a line end."""
        found = self._packed(key if key[:1] == "\n" else SPACE + key)
        if len(key) <= UNIT_CHARS:
            if len(self.units) >= UNITS:
                self.units = {}
            self.units[key] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as packed little-endian 32-bit integers; an empty one has none."""
        if not text:
            return b""
        plain = text.replace(" ", SPACE)
        if not self.cuts:
            return self._packed(SPACE + plain)
        keys = plain.replace("\n", f"{SPACE}\n").split(SPACE)
        if "" in keys:  # runs of spaces: a unit starts with all of them
            keys = [u[1:] if u[0] == SPACE else u for u in _RUNS.findall(SPACE + plain)]
        known = self.units.get
        return b"".join([known(k) or self._unit(k) for k in keys])

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding puts in front of a text is taken off."""
        raw = b"".join(map(self.text.__getitem__, ids))
        return (raw[1:] if ids and self.leads[ids[0]] else raw).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _coder(path: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = [pieces.encode(t) for t in part.column(1).to_pylist()]
                ids = np.frombuffer(b"".join(packed), "<i4")
                ends = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
                flat = ids.tolist()
                decoded = [pieces.decode(flat[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[part.schema.names[0], "ids", "decoded"])

    return code


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of every row: ids without begin or end as an array, and the text they decode to.

    ``model`` is a BPE model file that leaves texts as they are but for the space in front; the
    pieces and byte fallback of any such file hold.  NULL is the empty text, which has no ids and
    decodes to itself.  A literal U+2581 is a space to the model and decodes to one.  A text of any
    length is encoded whole; its time grows with its length, spaces or not.  Every row gives a row,
    with repeated and NULL keys too; an empty table gives none, and all other columns, whatever
    their names, are ignored.  Nothing is shuffled: a lost executor costs its own tasks.
    """
    plain = docs.select(F.col(key).alias(key), text_of(docs, text).alias("__text"))
    kind = docs.schema[key].dataType.simpleString()
    return plain.mapInArrow(_coder(model), f"`{key}` {kind}, ids array<int>, decoded string")
