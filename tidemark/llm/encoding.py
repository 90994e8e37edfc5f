"""Token ids of whole texts, made from a bounded memo of text pieces.

A text is cut in front of a space wherever no token of a byte-level pre-tokenizer can
cross: the space is not between two other white-space characters.  Each distinct piece
is encoded once per memo, and the ids of a text are the ids of its pieces in order.  New
pieces of Latin text are encoded as one run, which is cut again by the bytes of its tokens.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
import os
from collections.abc import Callable

import numpy as np

from tidemark.llm.wordhash import span_hashes

#: Entries of a worker's memo; it is emptied when it grows past this.
MEMO_ENTRIES = 500_000


#: The pattern by which byte-level vocabularies split a text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The last letter of the Latin blocks that have not changed since the first versions of Unicode.
LAST_LATIN = "\u017f"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order.
    """
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def safe_pieces(text: str) -> list[str]:
    """Cut before each space, except where white space stands on both sides of it (or ends the text)."""
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        before = out[-1]
        if (not before or before[-1].isspace()) and (not part or part[0].isspace()):
            out[-1] = f"{before} {part}"
        else:
            out.append(f" {part}")
    return out


class PieceEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    ``encode_pieces`` gives the ids of distinct pieces; ``encode_whole`` those of a text that
    holds one of the ``special`` strings, which the library looks for before anything else.
    """

    def __init__(
        self,
        encode_pieces: Callable[[list[str]], list[bytes]],
        encode_whole: Callable[[str], bytes],
        special: list[str],
        entries: int = MEMO_ENTRIES,
    ):
        self.encode_pieces, self.encode_whole = encode_pieces, encode_whole
        self.special, self.entries = special, entries
        self.inner: dict[str, bytes] = {}  # by what follows the space
        self.outer: dict[str, bytes] = {}  # pieces without a leading space
        self.odd: set[str] = set()  # keys of inner that start or end with white space

    def _learn(self, inner: set[str], outer: set[str]) -> None:
        if len(self.inner) + len(inner) > self.entries:
            self.inner, self.odd = {}, set()
        if len(self.outer) + len(outer) > self.entries // 4:
            self.outer = {}
        inner, outer = [c for c in inner if c not in self.inner], [c for c in outer if c not in self.outer]
        got = self.encode_pieces([f" {c}" for c in inner] + outer)
        self.inner.update(zip(inner, got))
        self.outer.update(zip(outer, got[len(inner) :]))
        self.odd.update(c for c in inner if not c or c[0].isspace() or c[-1].isspace())

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        split: list[list[str] | None] = [None] * len(texts)
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[k] = self.encode_whole(text)
            else:
                split[k] = text.split(" ")
        plain = [p for p in split if p is not None]
        self._learn(set().union(*(p[1:] for p in plain)), {p[0] for p in plain})
        inner, odd = self.inner, self.odd
        hard = []
        for k, parts in enumerate(split):
            if parts is None:
                continue
            if not odd.isdisjoint(parts) or not parts[0] or parts[0][-1].isspace():
                hard.append(k)
            else:
                out[k] = self.outer[parts[0]] + b"".join([inner[c] for c in parts[1:]])
        if hard:
            cut = {k: safe_pieces(texts[k]) for k in hard}
            flat = [p for ps in cut.values() for p in ps]
            self._learn({p[1:] for p in flat if p[:1] == " "}, {p for p in flat if p[:1] != " "})
            for k, ps in cut.items():
                out[k] = b"".join([self.inner[p[1:]] if p[:1] == " " else self.outer[p] for p in ps])
        return out


#: Bytes of text that are hashed at a time; a longer text is hashed alone.
RUN_BYTES = 1 << 19


class ArrayEncoder(PieceEncoder):
    """The same ids with the memo in arrays: pieces are found by two 64-bit hashes, many texts at a time.

    New pieces of Latin letters, digits and signs that follow a space are one run for ``encode_latin``, which is
    cut again by the ``widths`` of its tokens in bytes.  Texts with white space at the edge of a piece, or
    a piece whose second hash is not that of the memo, go through ``PieceEncoder``.
    """

    def __init__(self, encode_pieces, encode_whole, special, encode_latin: Callable[[str], list[int]], widths: np.ndarray, entries: int = MEMO_ENTRIES):
        super().__init__(encode_pieces, encode_whole, special, entries)
        self.encode_latin, self.widths = encode_latin, widths
        self._forget()

    def _forget(self) -> None:
        self.keys, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.edge = np.zeros(0, bool)  # pieces that are empty, or start or end with white space
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = {k for s in self.special for k, text in enumerate(texts) if s in text}
        out: list[bytes | None] = [self.encode_whole(t) if k in marked else None for k, t in enumerate(texts)]
        run, size = [], 0
        for k, text in enumerate(texts):
            if k not in marked:
                run.append((k, text.encode()))
                size += len(run[-1][1])
            if run and (size >= RUN_BYTES or k + 1 == len(texts)):
                for (at, _), ids in zip(run, self._encode_run([raw for _, raw in run])):
                    out[at] = ids
                run, size = [], 0
        hard = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(hard, super().encode([texts[k] for k in hard])):
            out[k] = ids
        return out

    def _encode_run(self, texts: list[bytes]) -> list[bytes | None]:
        """ids of each text; None for one that has to go another way."""
        joined = b" ".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        spaces = np.flatnonzero(raw == 0x20)
        starts, ends = np.append(0, spaces + 1), np.append(spaces, len(raw))
        head = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))  # first piece of each text
        follows = np.ones(len(starts), bool)
        follows[head[:-1]] = False
        name = span_hashes(raw, starts, ends) ^ follows
        second = span_hashes(raw, starts, ends, second=True)
        distinct, where, inverse = np.unique(name, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        new = place == len(self.keys)
        new[~new] = self.keys[place[~new]] != distinct[~new]
        if len(self.keys) + new.sum() > self.entries:
            self._forget()
            new[:], place[:] = True, 0
        if new.any():
            at = where[new]
            ids, size, edge = self._ids_of(joined, raw, starts[at], ends[at], follows[at])
            place = place[new]
            self.keys = np.insert(self.keys, place, distinct[new])
            self.second = np.insert(self.second, place, second[at])
            self.first = np.insert(self.first, place, len(self.ids) + np.cumsum(size) - size)
            self.size = np.insert(self.size, place, size)
            self.edge = np.insert(self.edge, place, edge)
            self.ids = np.append(self.ids, ids)
        slot = np.searchsorted(self.keys, distinct)[inverse]
        size = self.size[slot]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[slot] - ends + size, size) + np.arange(ends[-1])].astype("<u4").tobytes()
        hard = np.add.reduceat((self.edge[slot] | (self.second[slot] != second)).astype(np.int64), head[:-1])
        edges = [0, *(4 * ends[head[1:] - 1]).tolist()]
        return [None if h else ids[a:b] for h, a, b in zip(hard.tolist(), edges, edges[1:])]


    def _ids_of(self, joined: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, their number by piece, whether a piece is empty or has white space at an edge)."""
        raw = np.append(raw, np.uint8(0))  # a place to read for the only piece of no bytes
        wide = np.append(0, np.cumsum(raw >= 0xC6))  # first bytes of characters after LAST_LATIN
        first, last, before = (raw[np.clip(k, 0, len(raw) - 1)] for k in (starts, ends - 1, ends - 2))
        # The only white space in Latin text is up to the space, or starts with the byte C2.
        latin = follows & (ends > starts) & (wide[starts] == wide[ends]) & (first > 0x20) & (first != 0xC2) & (last > 0x20) & (before != 0xC2)
        edge, size = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64)
        other = np.flatnonzero(~latin)
        texts = [joined[a:b].decode() for a, b in zip(starts[other].tolist(), ends[other].tolist())]
        edge[other] = [not t or t != t.strip() for t in texts]
        rest = self.encode_pieces([f" {t}" if f else t for t, f in zip(texts, follows[other].tolist())])
        size[other] = [len(i) // 4 for i in rest]
        a, b = starts[latin] - 1, ends[latin]
        run = np.array(self.encode_latin(b"".join([joined[x:y] for x, y in zip(a.tolist(), b.tolist())]).decode()), np.uint32)
        size[latin] = np.diff(np.searchsorted(np.cumsum(self.widths[run]), np.cumsum(b - a)) + 1, prepend=0)
        ids = np.empty(size.sum(), np.uint32)
        of_run = np.repeat(latin, size)
        ids[of_run], ids[~of_run] = run, np.frombuffer(b"".join(rest), "<u4")
        return ids, size, edge


def to_bytes(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


@functools.lru_cache(maxsize=4)
def library_encoder(path: str) -> PieceEncoder | Callable:
    """Encoder of a tokenizer file that agrees with the library on every text.

    Byte-level .json files without a normaliser are encoded by pieces; any other .json and
    .model file by whole texts.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return _Whole(lambda text: to_bytes(model.encode(text)))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        setup = json.load(f)
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()

    def whole(text: str) -> bytes:
        return to_bytes(made.encode(text, add_special_tokens=False).ids)

    ranked = ranked_encoder(setup)

    def many(texts: list[str]) -> list[bytes]:
        return [to_bytes(ranked(t)) if ranked and t and max(t) <= LAST_LATIN else whole(t) for t in texts]

    pre = setup.get("pre_tokenizer") or {}
    added = setup.get("added_tokens") or []
    by_pieces = (
        pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not setup.get("normalizer")
    )
    special = [t["content"] for t in added]
    if by_pieces and ranked:
        return ArrayEncoder(many, whole, special, ranked, token_bytes(setup))
    return PieceEncoder(many, whole, special) if by_pieces else _Whole(whole)


def ranked_encoder(setup: dict) -> Callable[[str], list[int]] | None:
    """The same merges through a faster library; None where ids don't follow the order of the merges.

    Used for Latin text alone, whose letters, digits and spaces are the same in every version of Unicode.
    """
    import tiktoken

    model = setup["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    merged = [vocab.get(a + b) for a, b in pairs]
    if len(vocab) < 256 or None in merged or any(b <= a for a, b in zip(merged, merged[1:])):
        return None
    back = {c: b for b, c in byte_characters().items()}
    single = [t for t in vocab if len(t) == 1]
    keep = single + [a + b for a, b in pairs]
    if len(single) != 256 or not set(single) <= set(back) or merged[:1] and merged[0] < max(vocab[t] for t in single):
        return None
    ranks = {bytes(back[c] for c in t): vocab[t] for t in keep}
    if sorted(ranks.values()) != list(range(len(ranks))):
        return None
    made = tiktoken.Encoding("ranked", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return made.encode_ordinary


def token_bytes(setup: dict) -> np.ndarray:
    """Bytes of each token of a byte-level vocabulary, by id."""
    vocab = setup["model"]["vocab"]
    widths = np.zeros(max(vocab.values()) + 1, np.int64)
    widths[list(vocab.values())] = [len(t) for t in vocab]
    return widths


class _Whole:
    def __init__(self, encode_one: Callable[[str], bytes]):
        self.encode_one = encode_one

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]
