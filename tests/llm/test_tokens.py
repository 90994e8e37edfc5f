import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import WORDS, messy_rows
from tidemark.llm import encoding, packing, token_counts, transducer
from tidemark.llm.common import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    parts = [" ", " ", " ", "\n", "a", "b", "'s", "é", "\t", " ", "1", "!", "<|endoftext|>", " ", "\x1c", "\x85", "日", "the", " of", "\U0001f600"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(n)]


def test_piece_encoder_agrees_with_library():
    encoder = encoding.library_encoder(PATH)
    texts = odd_texts(3000) + [r[1] or "" for r in messy_rows(WORDS)]
    assert encoder.encode(texts) == [encoding.to_bytes(ids_of(t)) for t in texts]


def test_memo_bound_does_not_change_ids():
    made = encoding.library_encoder(PATH)
    small = encoding.PieceEncoder(made.encode_pieces, made.encode_whole, made.special, entries=3)
    for t in odd_texts(300, 9):
        assert small.encode([t]) == [encoding.to_bytes(ids_of(t))]


def test_new_pieces_are_encoded_in_one_run(monkeypatch):
    """New Latin pieces are one call of the library, with the same ids; the bound of the memo changes none."""
    made = encoding.library_encoder(PATH)
    calls = []

    def counted(text):
        calls.append(text)
        return made.encode_latin(text)

    single = lambda pieces: [calls.append(p) or i for p, i in zip(pieces, made.encode_pieces(pieces))]
    for entries in (3, 10**6):
        encoder = encoding.ArrayEncoder(single, made.encode_whole, made.special, counted, made.widths, entries)
        texts = ["x" + "".join(f" wörd{k},{j}" for j in range(40)) for k in range(100)]
        assert encoder.encode(texts) == [encoding.to_bytes(ids_of(t)) for t in texts]
        assert len(calls) == 2  # the run, and the one piece that follows no space
        assert encoder.encode([""]) == [b""] and encoder.encode([]) == []
        for t in odd_texts(300, 9):
            assert encoder.encode([t, "", t]) == [encoding.to_bytes(ids_of(x)) for x in (t, "", t)]
        monkeypatch.setattr(encoding, "RUN_BYTES", 64)
        texts = odd_texts(500, 4) + [r[1] or "" for r in messy_rows(WORDS)]
        assert encoder.encode(texts) == [encoding.to_bytes(ids_of(t)) for t in texts]
        monkeypatch.undo()
        calls.clear()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_by_whole_texts(spark, messy, name):
    path = public_tokenizers.path(name)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(messy, new_folder(spark, "cache"), path).collect()}
    if name.endswith("json"):
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t or ""))
    for r in messy.collect():
        assert got[r["doc_id"]] == count(r["text"])


def test_counts_and_cache(spark, messy, empty):
    cache = new_folder(spark, "cache")
    first = token_counts.count_tokens(messy, cache, PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(ids_of(r["text"]))) for r in messy.collect()), key=key)
    assert sorted((tuple(r) for r in first), key=key) == want
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == messy.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = token_counts.count_tokens(messy, cache, PATH).collect()
    assert sorted((tuple(r) for r in again), key=key) == want
    assert spark.read.parquet(cache).count() == n  # nothing was encoded again
    # A count that only the cache can know is the one returned; another tokenizer version does not see it.
    fresh = spark.createDataFrame([(1, "quite new")], "doc_id bigint, text string")
    planted = spark.createDataFrame([("quite new", 77)], "t string, n_tokens bigint")
    version = encoding.file_digest(PATH)
    planted.select(F.unhex(F.sha2("t", 256)).alias("digest"), "n_tokens", F.lit(version).alias("version")).write.mode("append").partitionBy("version").parquet(cache)
    assert token_counts.count_tokens(fresh, cache, PATH).first()["n_tokens"] == 77
    assert token_counts.count_tokens(fresh, cache, PATH, version="other").first()["n_tokens"] == len(ids_of("quite new"))
    assert token_counts.count_tokens(empty, new_folder(spark, "cache"), PATH).count() == 0


def test_merges_of_single_words():
    vocabulary = transducer.merger(PATH)
    rng = random.Random(1)
    for text in ["ab" * 1500, "".join(rng.choices("abcdeth", k=2000)), "a", "日本" * 200, "é" * 5]:
        for word in vocabulary.words(text):
            assert vocabulary.merge(word) == ids_of(word.decode())


def test_transducer_is_minimal_and_exact(tmp_path):
    vocabulary = transducer.merger(PATH)
    words = {w.encode() for t in WORDS for w in (t, f" {t}", f" {t}s")} | {bytes([b]) for b in range(256)} | {b"tops", b"taps", b"top", b"tap"}
    arrays = transducer.compile_lexicon({w: vocabulary.merge(w) for w in words})
    path = str(tmp_path / "lexicon")
    transducer.save_lexicon(arrays, path)
    lexicon = transducer.Lexicon(path)
    unknown = [b"", b"topsy", b"ta", b"\xff\xfe", b"q" * 100]
    found = lexicon.find([*sorted(words), *unknown]).tolist()
    assert found == [*range(len(words)), -1, -1, -1, -1, -1]
    for word, number in zip(sorted(words), found):
        assert lexicon.ids_of(number) == encoding.to_bytes(vocabulary.merge(word))
    # Minimal: as many states as there are different sets of remaining suffixes.
    suffixes = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(arrays["accepts"]) == len(suffixes)
    nothing = transducer.compile_lexicon({})
    transducer.save_lexicon(nothing, path + "0")
    assert transducer.Lexicon(path + "0").find([b"a"]).tolist() == [-1]


def test_encode_and_decode(spark, messy, empty):
    texts = messy.unionByName(
        spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd_texts(200, 11))], "doc_id bigint, text string"), allowMissingColumns=True
    )
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in transducer.encode(texts, PATH).collect())
    want = Counter()
    for r in texts.collect():
        ids = ids_of(r["text"])
        want[r["doc_id"], encoding.to_bytes(ids), LIBRARY.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    small = transducer.build_lexicon(texts, PATH, words=5)
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in transducer.encode(texts, PATH, lexicon=small).collect()) == want
    assert transducer.encode(empty, PATH).count() == 0


def check_packing(rows, texts, capacity):
    """Every document is cut by the rule, and every sequence is filled from 0 without a gap."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    import zlib

    want = {}
    for key, text in texts:
        raw = encoding.to_bytes([*ids_of(text), 0])
        n = len(raw) // 4
        edges = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n, capacity), n]
        want.setdefault(key, []).extend((k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(messy, empty):
    rows = packing.pack_documents(messy, PATH).collect()
    texts = [(r["doc_id"], r["text"]) for r in messy.collect()]
    n = check_packing(rows, texts, packing.CAPACITY)
    tokens = sum(len(ids_of(t)) + 1 for _, t in texts)
    assert n <= -(-tokens // packing.CAPACITY) + 1
    assert packing.pack_documents(empty, PATH).count() == 0


def test_small_capacity_cuts_documents(messy):
    rows = packing.pack_documents(messy, PATH, capacity=64).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in messy.collect()], 64)


@pytest.mark.parametrize("seed", range(6))
def test_histogram_packing_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(4.5, 1, 3000).astype(int), 1, 512)
    histogram = {int(k): int(v) for k, v in Counter(lengths.tolist()).items()}
    packed = packing.pack_histogram(histogram, 512)
    used = Counter()
    for config, n in packed:
        assert n > 0 and sum(x * k for x, k in config.items()) <= 512
        for x, k in config.items():
            used[x] += k * n
    assert used == Counter(histogram)
    assert sum(n for _, n in packed) <= 1.01 * lengths.sum() / 512 + 1
    assert packing.cover(histogram, 512)[0]  # the program itself packs a part
    assert packing.pack_histogram({512: 3}, 512) == [({512: 1}, 3)]
    assert packing.pack_histogram({}, 512) == []


def test_optimal_on_tiny_instances():
    # 3 + 3 + 4 = 10 and 6 + 4: best fit, longest first, needs one sequence more without looking ahead.
    assert sum(n for _, n in packing.pack_histogram({6: 2, 4: 2, 3: 4, 2: 0}, 10)) <= 4
    assert sum(n for _, n in packing.pack_histogram({5: 4, 10: 1}, 10)) == 3


def test_digests_stored_twice_count_once(spark, messy):
    cache = new_folder(spark, "cache")
    first = token_counts.count_tokens(messy, cache, PATH).collect()
    spark.read.parquet(cache).limit(10).write.mode("append").partitionBy("version").parquet(cache)
    again = token_counts.count_tokens(messy, cache, PATH).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, first))


@pytest.mark.parametrize("histogram, capacity, optimum", [({6: 4, 4: 4}, 10, 4), ({5: 10}, 10, 5), ({7: 3, 3: 9}, 10, 5), ({6: 7}, 10, 7), ({10: 2, 1: 5}, 10, 2.5), ({5: 1, 4: 1, 3: 1, 2: 1}, 7, 2)])
def test_configuration_program_on_small_instances(histogram, capacity, optimum):
    """Known optima: the amounts cover every demand exactly, and the bound is below the optimum."""
    amounts, bound = packing.fractional(histogram, capacity)
    covered = Counter()
    for config, x in amounts.items():
        assert x > 0 and sum(length * k for length, k in config) <= capacity
        covered.update({length: k * x for length, k in config})
    assert dict(covered) == pytest.approx(histogram)
    assert bound <= optimum + 1e-9 and optimum - 1e-9 <= sum(amounts.values()) <= 1.1 * optimum
    whole, rest = packing.rounded(amounts, histogram, capacity)
    held = Counter(rest)
    for config, n in whole:
        assert n > 0 and sum(length * k for length, k in config.items()) == capacity
        held.update({length: k * n for length, k in config.items()})
    assert held == Counter(histogram)
    assert sum(n for _, n in packing.pack_histogram(histogram, capacity)) == math.ceil(optimum)


@pytest.mark.parametrize("seed", range(4))
def test_configuration_program_is_near_its_bound(seed):
    rng = random.Random(seed)
    histogram = Counter(min(256, max(1, int(rng.lognormvariate(4, 0.8)))) for _ in range(20000))
    histogram.pop(256, None)
    amounts, bound = packing.fractional(histogram, 256)
    assert bound <= sum(amounts.values()) <= 1.05 * bound
    assert sum(n for _, n in packing.pack_histogram(histogram, 256)) >= bound - 1e-6
