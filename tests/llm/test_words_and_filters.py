"""Spelling variants, the filter audit and the SentencePiece encoder against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.cases import words
from tidemark.llm import filter_audit, piece_prefixes, spelling
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
DIR = "/root/testdata/sf0.001"


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_variants(rows):
    n = Counter()
    for key, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: sorted((-n[v], v) for v in n if one_edit(w, v)) for w in n}
    form = {w: v[0][1] for w, v in near.items() if v and -v[0][0] >= 5 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def spelled_rows(seed=2):
    """Words and their misspellings, with counts that form chains."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdeéß÷xyz", k=rng.randint(5, 11))) for _ in range(60)] + ["letter" * 3, "abcabc", "abcabcd"]
    bag = []
    for w in stems:
        v = w
        for times in (130, 26, 5):
            bag += [v] * times
            k = rng.randrange(len(v))
            v = rng.choice([v[:k] + v[k + 1 :], v[:k] + "q" + v[k:], v[:k] + "q" + v[k + 1 :]])
    bag += ["Tie" + c + "Word" for c in "aab" for _ in range(30)] + ["TiexWord"] * 6 + ["short"] * 50 + ["rareword"] * 4
    rng.shuffle(bag)
    rows = [(k, " ".join(bag[k * 40 : k * 40 + 40]).replace(" short", "1short,")) for k in range(len(bag) // 40 + 1)]
    return rows + [(None, "tieaword " * 9), (7, "tieaword " * 9), (7, "tieaword " * 9), (900, None), (901, ""), (902, "long" * 5000)]


@pytest.mark.parametrize("group", [0, 3, 10**6])
def test_variants_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    rows = spelled_rows()
    frame = spark.createDataFrame([(*r, "w", 1, "f") for r in rows], "doc_id bigint, text string, word string, n int, form string").repartition(3)
    got = spelling.variants(frame).collect()
    want = brute_variants(rows)
    assert {r["word"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert any(v[0] and v[1] != v[0] for v in want.values()) and any(v[0] is None and v[3] for v in want.values())


def test_variants_of_odd_and_no_rows(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert {r["word"]: tuple(r)[1:] for r in spelling.variants(messy).collect()} == brute_variants(rows)
    assert spelling.variants(empty).count() == 0


def test_noise_and_flushes_do_not_change_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 10)
    rows = [(k, f"correct spelling{'a' * (k % 7)} of words") for k in range(600)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_variants(rows)
    assert sum(v[2] for v in want.values()) < 1200  # some occurrences were changed
    assert {r["word"]: tuple(r)[1:] for r in got.collect()} == want


# Filter audit


def brute_audit(rows, labels):
    """The documents filtered step by step in each order."""
    good = {d for d, q, t in labels if q == 1 and d is not None}  # no row without a key has a label
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    docs = []
    for key, text, part in rows:
        t, w = text or "", words(text)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": key is not None and first[t] < key,
        }
        docs.append((key, part or "", {f for f, x in fails.items() if x}))
    out = {}
    for part in {d[1] for d in docs}:
        removed_in = Counter()
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[1] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                fail = [d for d in docs if d[1] == part and f in d[2]]
                removed_in[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(fail) - len(gone), sum(d[2] == {f} for d in fail), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
        for key in [k for k in out if k[0] == part]:
            out[key].append(removed_in[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_brute_force(spark, messy, empty):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in messy.collect()]
    rows += [(k, rows[10][1], "copies") for k in range(200, 240)] + [(200, rows[10][1], "other"), (-5, None, "copies"), (300, "SHOUT " * 60, None), (None, rows[10][1], "copies")]
    rng = random.Random(1)
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 320, 2)] + [(None, 1, 1), (10, 1, 0), (10, 0, 1), (12, None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, source string, n int, mask string, rank int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 120 * 5 * len({r[2] or "" for r in rows})
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want
    assert any(v[4] for v in want.values()) and any(v[5] for v in want.values()) and any(v[2] for v in want.values())
    assert filter_audit.audit(empty, marks).count() == 0


def test_intervals_cover_every_order_once():
    for mask in range(1, 32):
        hit = Counter()
        for m, step, start, stop in filter_audit.intervals():
            if m == mask:
                for rank in range(start, stop):
                    order = filter_audit.ORDERS[rank]
                    fails = [k for k, f in enumerate(order, 1) if mask >> filter_audit.FILTERS.index(f) & 1]
                    assert fails[0] == step
                    hit[rank] += 1
        assert hit == dict.fromkeys(range(120), 1)


# SentencePiece


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    parts = [" ", " ", "  ", "▁", "\n", "a", "b", "the", "ing", "é", "日本", "\t", "\U0001f600", "12", "...", "==", "    ", "\r\n", "<s>", "<unk>", "\x00", "ﬁ", "﻿", "\x85"]
    letters = "abcdefghijklmnopqrstuvwxyzABC éñ "
    out = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(n)]
    out += ["".join(rng.choices(letters, k=rng.randint(0, 24))) for _ in range(n)]
    pieces = [LIBRARY.id_to_piece(k).replace("▁", " ") for k in range(259, LIBRARY.get_piece_size())]
    return out + ["".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(n)] + ["x" * 5000, "ab" * 3000, " " * 700, "\n" * 99]


def test_ids_agree_with_the_library():
    made = piece_prefixes.Pieces(PATH)
    for t in odd_texts(4000):
        ids = LIBRARY.encode(t)
        assert list(memoryview(made.encode(t)).cast("i")) == ids
        assert made.decode(ids) == LIBRARY.decode(ids)


def test_bounds_of_the_memos_and_uncut_texts(monkeypatch):
    monkeypatch.setattr(piece_prefixes, "UNITS", 3)
    monkeypatch.setattr(piece_prefixes, "PAIRS", 5)
    made, whole = piece_prefixes.Pieces(PATH), piece_prefixes.Pieces(PATH)
    whole.cuts = False
    for t in odd_texts(150, 8)[:450]:
        assert list(memoryview(made.encode(t)).cast("i")) == LIBRARY.encode(t) == list(memoryview(whole.encode(t)).cast("i"))


def test_every_prefix_has_one_last_token():
    """Of the pieces that end at a place exactly one fits the shorter prefix: the library's last token."""
    made = piece_prefixes.Pieces(PATH)
    unit = "▁internationalisation"
    last = [None] * (len(unit) + 1)
    for end in range(1, len(unit) + 1):
        fit = [unit[at:end] for at in range(end) if unit[at:end] in made.id and (made.history(unit[:end]) is not None if at == 0 else made.compatible(last[at], unit[at:end]))]
        assert len(fit) == 1
        last[end] = fit[0]
        assert LIBRARY.id_to_piece(LIBRARY.encode(unit[1:end])[-1]) == fit[0] if end > 1 else True


def test_encoded_rows(spark, messy, empty):
    rows = piece_prefixes.encode(messy, PATH).collect()
    want = Counter((r["doc_id"], tuple(LIBRARY.encode(r["text"] or "")), r["text"] or "") for r in messy.collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == want
    assert piece_prefixes.encode(empty, PATH).count() == 0


# The registered queries


def test_queries(spark):
    documents = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()]
    got = {r["word"]: tuple(r)[1:] for r in QUERIES["op11_spelling_chunks"](spark, DIR).collect()}
    assert got == brute_variants([(r["doc_id"], r["text"]) for r in documents])
    got = {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES["op12_filter_ranks"](spark, DIR).collect()}
    assert got == brute_audit([(r["doc_id"], r["text"], r["source"]) for r in documents], labels)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_piece_prefixes"](spark, DIR).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in documents:
        ids = LIBRARY.encode(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))
