import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.cases import WORDS, messy_rows, prose, shingles, words
from tidemark.llm import components, near_copies, one_permutation, simhash, suffix_trees, wordhash
from tidemark.llm.common import stored


def test_word_hashes_depend_on_the_word_alone():
    texts = [(r[1] or "").encode() for r in messy_rows(WORDS)]
    hashes, first = wordhash.hashed_words(texts)
    flat = [w for t in texts for w in t.split()]
    assert len(hashes) == len(flat) and first.tolist() == [0, *np.cumsum([len(t.split()) for t in texts])]
    seen = defaultdict(set)
    for w, h in zip(flat, hashes.tolist()):
        seen[w].add(h)
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
    assert len(wordhash.hashed_words([b"", b" "])[0]) == 0


# One-permutation MinHash


def jaccard(a, b):
    a, b = set(shingles(a, 5)), set(shingles(b, 5))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_every_document_meets_the_next(messy, empty):
    rows = [r for r in messy.collect() if r["doc_id"] is not None and r["doc_id"] != 20]
    plain = messy.filter("doc_id <> 20")
    got = {r["doc_id"]: r for r in one_permutation.against_next(plain).collect()}
    rows.sort(key=lambda r: r["doc_id"])
    assert sorted(got) == [r["doc_id"] for r in rows]
    error = []
    for r, n in zip(rows, [*rows[1:], rows[0]]):
        text, following = r["text"] or "", n["text"] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(text)
        assert g["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert g["near_next"] == pytest.approx(one_permutation.likeness(*prints(text, following)))
        assert g["near_edited"] == pytest.approx(one_permutation.likeness(*prints(text, changed)))
        both = [(g["near_edited"] - jaccard(text, changed), changed), (g["near_next"] - jaccard(text, following), following)]
        error += [(e, len(set(shingles(text, 5)) | set(shingles(other, 5)))) for e, other in both]
    # The error of a few shingles is large, as each is hashed once; it falls with their number.
    assert np.sqrt(np.mean([e * e for e, n in error if n >= 100])) < 0.04
    assert abs(np.mean([e for e, n in error])) < 0.03
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"] or ""].add(got[r["doc_id"]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert one_permutation.against_next(empty).count() == 0
    assert one_permutation.against_next(messy).count() == messy.count()  # NULL and repeated keys


def prints(*texts):
    return [one_permutation.fingerprint(h) for h in one_permutation.shingle_hashes([t.encode() for t in texts])]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.8, 0.95, 1.0])
@pytest.mark.parametrize("size", [60, 1000, 5000])
def test_likeness_is_unbiased(share, size):
    rng = np.random.default_rng(int(share * 100) + size)
    error = []
    for _ in range(40):
        both = int(size * share)
        pool = rng.integers(0, (1 << 64) - 1, 2 * size - both, dtype=np.uint64)
        a, b = pool[:size], np.concatenate([pool[:both], pool[size:]])
        error.append(one_permutation.likeness(one_permutation.fingerprint(a), one_permutation.fingerprint(b)) - both / (2 * size - both))
    assert abs(np.mean(error)) < 0.025 and np.std(error) < 0.08


def test_short_and_empty_texts():
    a, b, c, d = prints("", "one", "one", "two")
    assert a is None and one_permutation.likeness(a, a) == 1 and one_permutation.likeness(a, b) == 0
    assert one_permutation.likeness(b, c) == 1 and one_permutation.likeness(b, d) < 0.2
    assert one_permutation.packed(a) == "" and len(one_permutation.packed(b)) == one_permutation.BINS


def test_fingerprint_table(messy):
    got = one_permutation.fingerprints(messy).collect()
    assert len(got) == messy.count()
    want = {r["doc_id"]: one_permutation.packed(prints(r["text"] or "")[0]) for r in messy.collect()}
    assert all(r["fingerprint"] == want[r["doc_id"]] for r in got)


# SimHash


def brute_simhash(text):
    grams = shingles((text or "").encode().lower().decode(), 3)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_bits():
    for r in messy_rows(WORDS):
        assert simhash.simhash((r[1] or "").encode()) == brute_simhash(r[1])


def grouped(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_and_components_of_near_fingerprints(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randint(0, 12)):  # chains: each step flips up to three bits
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << bit
            prints.add(x)
    prints |= {0, 1, 3, 7, (1 << 64) - 1}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    near = {(signed(a), signed(b)) for a in prints for b in prints if signed(a) < signed(b) and (a ^ b).bit_count() <= 2}
    got = {(r["a"], r["b"]) for r in simhash.links(frame).collect()}
    assert got == near
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(sorted(near), "a bigint, b bigint")).collect()}
    assert found == grouped(near, {x for p in near for x in p})


def test_pivot_distances_bound_the_distance():
    rng = random.Random(2)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        for p in simhash._REFERENCE:
            assert abs((a ^ (p & (1 << 64) - 1)).bit_count() - (b ^ (p & (1 << 64) - 1)).bit_count()) <= simhash.RADIUS


def test_components_of_long_paths_and_stars(spark):
    pairs = [(k, k + 1) for k in range(100)] + [(200, k) for k in range(201, 260)] + [(300, 300), (5, 4), (400, None)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {k: 0 for k in range(101)} | {k: 200 for k in range(200, 260)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicate_groups(messy, empty):
    rows = messy.collect()
    fp = {k: brute_simhash(r["text"]) for k, r in enumerate(rows)}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    root = grouped(pairs, fp)
    least = {}
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root[k]] = min(least.get(root[k], 10**9), r["doc_id"])
    want = Counter((r["doc_id"], signed(fp[k]), least.get(root[k])) for k, r in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.near_duplicates(messy).collect()) == want
    kept = simhash.keep_one(messy).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(ids) == sorted(set(least.values())) and sum(r["doc_id"] is None for r in kept) == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# Texts of similar shingles


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "zz" + str(rng.randrange(1000))
    return " ".join(w)


def near_rows():
    """Groups of near copies, chains among them, beside texts of lower similarity; some without a key."""
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        base = " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(rng.randint(60, 400)))
        texts += [base, base.upper()]
        for _ in range(rng.randint(0, 6)):
            texts.append(edited(rng, rng.choice(texts[-3:]), rng.randint(1, len(base.split()) // 25)))
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    alone = prose(rng, 70)
    return rows + [(None, alone, "en", "s", 1), (None, alone, "de", "s", 2), (None, rows[0][1], "en", "s", 3), rows[1], rows[1]]


def kept_by_brute_force(rows):
    sets = [frozenset(shingles((t or "").encode().lower().decode(), 5)) for _, t, *_ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root, least = grouped(pairs, range(len(rows))), {}
    for k, r in enumerate(rows):
        least[root[k]] = min(least.get(root[k], (True, 0)), (r[0] is None, r[0] or 0))
    return Counter(None if nokey else key for nokey, key in least.values())


def test_near_copies_against_brute_force(spark, messy, empty):
    rows = near_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    want = kept_by_brute_force(rows)
    assert want[None] == 1 and len(want) < 200
    assert Counter(r["doc_id"] for r in near_copies.keep_one(frame).collect()) == want
    assert sum(r["doc_id"] is not None for r in simhash.keep_one(frame).collect()) > len(want)  # two bits are not enough
    rows = [tuple(r) for r in messy.collect()]
    kept = near_copies.keep_one(messy)
    assert kept.columns == messy.columns and Counter(r["doc_id"] for r in kept.collect()) == kept_by_brute_force(rows)
    assert near_copies.keep_one(empty).count() == 0


def edited_copies(n, edits, size=300):
    rng = random.Random(n)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for k in range(n):
        text = base[:]
        for _ in range(edits):
            text[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        yield k, " ".join(text)


def test_pairs_of_one_group_grow_with_its_texts(spark, monkeypatch):
    counts, check = [], near_copies._checked

    def watched(pairs, sets):
        counts[-1] += pairs.count()
        return check(pairs, sets)

    monkeypatch.setattr(near_copies, "_checked", watched)
    for n in (200, 400, 800):
        counts.append(0)
        rows = list(edited_copies(n, 3))
        kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert [r["doc_id"] for r in kept.collect()] == [0]
    assert all(c <= near_copies.BANDS * n for c, n in zip(counts, (200, 400, 800)))
    assert counts[2] < 3 * counts[1] < 9 * counts[0]  # four times as many if all pairs were listed


def test_fingerprints_discard_no_similar_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 2000))
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate([x[: n - int(n * rng.random() * 0.3)], rng.integers(0, 1 << 63, int(n * rng.random() * 0.2)).astype(np.uint64)])
        both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        a, b = near_copies.fingerprint(x), near_copies.fingerprint(y)
        differ = int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum())
        assert differ <= either - both
        assert np.abs(near_copies.distances(a) - near_copies.distances(b)).max() <= differ
        if 100 * both >= 80 * either:
            assert 180 * differ <= 20 * (len(x) + len(y))


def test_the_stage_keeps_no_near_copy(spark):
    import corpus_pipeline

    rows = [r for r in near_rows() if r[0] is not None]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicate_stage(spark, frame, "")
    assert Counter(r["doc_id"] for r in got.collect()) == kept_by_brute_force(rows)


# Repeated windows


def brute_repeats(rows, window=suffix_trees.WINDOW):
    """Kept words by document: windows in order, those seen before are cut."""
    seen, out = set(), {}
    for key, text in sorted({(k, t) for k, t in rows if k is not None}, key=lambda r: r[0]):
        w = words(text)
        cut = [False] * len(w)
        for k in range(len(w) - window + 1):
            name = tuple(w[k : k + window])
            if name in seen:
                cut[k : k + window] = [True] * window
            seen.add(name)
        out[key] = (len(w), sum(cut), b" ".join(x for x, c in zip(w, cut) if not c).decode())
    return out


def check_repeats(frame):
    rows = frame.collect()
    want = brute_repeats([(r["doc_id"], r["text"] or "") for r in rows])
    got = suffix_trees.remove_repeats(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r)[1:] == want[r["doc_id"]]
    return want


def test_repeated_windows(messy, empty):
    want = check_repeats(messy)
    assert sum(v[1] for v in want.values()) > 1000
    assert suffix_trees.remove_repeats(empty).count() == 0


def test_rows_without_repeats_stay_as_they_are(messy):
    want = brute_repeats([(r["doc_id"], r["text"] or "") for r in messy.collect()])
    cut = suffix_trees.without_repeats(messy)
    assert cut.columns == messy.columns
    before = {(r["doc_id"], r["n_chars"]): r for r in messy.collect()}
    for r in cut.collect():
        old = before[r["doc_id"], r["n_chars"]]
        if r["doc_id"] is None or not want[r["doc_id"]][1]:
            assert r == old
        else:
            assert r["text"] == want[r["doc_id"]][2] and r["spans"] == old["spans"]


@pytest.mark.parametrize("group,combine", [(0, 1_000_000), (50_000, 1), (3, 50)])
def test_lengthened_prefixes_and_combining(spark, monkeypatch, group, combine):
    rng = random.Random(4)
    passage = [prose(rng, n) for n in (20, 25, 60)]
    rows = []
    for k in range(150):
        parts = [prose(rng, rng.randint(0, 30))]
        if rng.random() < 0.6:
            parts += [rng.choice(passage), prose(rng, rng.randint(0, 10))]
        rows.append((k, " ".join(parts)))
    rows += [(500 + k, rows[k][1]) for k in range(20)]
    monkeypatch.setattr(suffix_trees, "GROUP", group)
    monkeypatch.setattr(suffix_trees, "COMBINE", combine)
    check_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))


def test_groups_go_on_over_batches():
    """The same suffixes in one batch or many give the same spans."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 400
    prefix = np.sort(rng.integers(0, 4, n))
    doc = np.concatenate([np.sort(rng.integers(0, 200, (prefix == p).sum())) for p in range(4)])
    at = np.arange(n)
    paths = [rng.integers(0, 3, rng.integers(1, 4)).astype("<u8").tobytes() for _ in range(n)]
    whole = pa.RecordBatch.from_arrays(
        [pa.array(prefix, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array([5] * n, pa.int32()), pa.array(paths, pa.binary())],
        schema=suffix_trees.SUFFIX,
    )

    def places(batches):
        return {(d, k) for b in suffix_trees._nodes(iter(batches)) for d, s, e in zip(*(c.to_pylist() for c in b.columns)) for k in range(s, e)}

    assert places([whole]) == places([whole.slice(k, 7) for k in range(0, n, 7)])


def similar_sets(rng, shared, percent):
    """Two sets of hashes whose Jaccard similarity is ``percent`` or just above."""
    extra = shared * (100 - percent) // percent
    x = rng.integers(0, 1 << 63, shared + extra).astype(np.uint64)
    return np.sort(x[: shared + extra // 2]), np.sort(np.concatenate([x[:shared], x[shared + extra // 2 :]]))


def test_simhash_of_near_copies_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 300, 1000):
        shingles = rng.integers(0, 1 << 63, n).astype(np.uint64)
        hashes = [b"".join(int(h).to_bytes(8, "little") for h in wordhash.mix64(s ^ near_copies._WORDS)) for s in shingles]
        counts = [sum(h[k // 8] >> (7 - k % 8) & 1 for h in hashes) for k in range(near_copies.BITS)]
        balance = near_copies.balances(shingles)
        assert balance.tolist() == [2 * c - n for c in counts]
        bits = np.unpackbits(near_copies.simhash(balance).view(np.uint8))
        assert bits.tolist() == [int(2 * c > n) for c in counts]


def test_simhash_keys_find_similar_sets_and_the_radius_discards_none():
    rng = np.random.default_rng(4)
    found = []
    for k in range(600):
        x, y = (near_copies.balances(s) for s in similar_sets(rng, 40 + 4 * k, 80))
        a, b = near_copies.simhash(x), near_copies.simhash(y)
        differ = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        assert np.abs(near_copies.distances(a) - near_copies.distances(b)).max() <= differ <= near_copies.RADIUS
        found.append(bool((near_copies.keys(x) == near_copies.keys(y)).any()))
    assert np.mean(found) >= 0.9  # at the limit itself; more above it
    apart = [near_copies.balances(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(300)]
    prints = [near_copies.simhash(x) for x in apart]
    assert min(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) for k, a in enumerate(prints) for b in prints[:k]) > near_copies.RADIUS


def test_simhash_keys_alone_find_the_groups(spark):
    """Without MinHash bands the stage still links nearly all near copies."""
    rows = [r[:2] for r in near_rows() if r[0] is not None]
    plain = spark.createDataFrame([(k, k, k, t) for k, t in rows], "key bigint, t bigint, k bigint, text string")
    classes = near_copies._classes(plain, "bigint").withColumn("bands", F.array().cast("array<bigint>"))
    sets = stored(plain.select("text").mapInArrow(near_copies._sets, "id bigint, shingles binary").dropDuplicates(["id"]), "sets")
    pairs = {(r["a"], r["b"]) for r in near_copies.links(classes, lambda ids: sets.join(ids, "id")).collect()}
    ids = [r["id"] for r in classes.collect()]
    groups = len(set(grouped(pairs, ids).values()))
    want = len(kept_by_brute_force(rows))
    assert want <= groups <= want + (len(ids) - want) // 10


def test_a_large_group_meets_few_leaders(spark, monkeypatch):
    """Pairs that leave the join of buckets and leaders, repeats included: a few for each text of a group, not one a bucket."""
    counts, check = [], near_copies._plausible

    def watched(pairs, classes):
        counts.append(pairs.count())
        return check(pairs, classes)

    monkeypatch.setattr(near_copies, "_plausible", watched)
    rows = list(edited_copies(400, 1))
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [r["doc_id"] for r in kept.collect()] == [0]
    assert 0 < sum(counts) <= 8 * 400


def test_sets_are_made_for_plausible_pairs_alone(spark):
    """Unlike texts that share their keys by chance are discarded before any shingle set of theirs is asked for."""
    rng = random.Random(6)
    rows = [(k, k, k, prose(rng, 40 + 3 * k)) for k in range(60)]
    plain = spark.createDataFrame(rows, "key bigint, t bigint, k bigint, text string")
    classes = near_copies._classes(plain, "bigint").withColumn("keys", F.array_repeat(F.lit(7), near_copies.KEYS))
    asked = []

    def sets_of(ids):
        asked.extend(r["id"] for r in ids.collect())
        return plain.select("text").mapInArrow(near_copies._sets, "id bigint, shingles binary").dropDuplicates(["id"])

    assert near_copies.links(classes, sets_of).count() == 0
    assert asked == []


def test_buckets_keep_texts_whose_size_fits_a_neighbour(spark):
    """A pair of similar sets is found among texts of all sizes in one bucket."""
    rng = random.Random(9)
    base = prose(rng, 300)
    texts = [base, base + " one more"] + [prose(rng, n) for n in (10, 100, 215, 420, 700, 1500)]
    plain = spark.createDataFrame([(k, k, k, t) for k, t in enumerate(texts)], "key bigint, t bigint, k bigint, text string")
    classes = near_copies._classes(plain, "bigint").withColumn("keys", F.array_repeat(F.lit(7), near_copies.KEYS))
    sets = plain.select("text").mapInArrow(near_copies._sets, "id bigint, shingles binary").dropDuplicates(["id"])
    want = {near_copies.set_id(s) for s in near_copies.shingle_sets([t.encode() for t in texts[:2]])}
    assert {(r["a"], r["b"]) for r in near_copies.links(classes, lambda ids: sets).distinct().collect()} == {tuple(sorted(want))}


def test_bitmap_passes_every_wanted_row_and_few_others(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("t"), (F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("text"))
    wanted = rows.filter("pmod(t, 10) = 3").select("t", "k")
    got = near_copies._may_be_in(rows, wanted, ["t", "k"])
    assert got.columns == ["t", "k", "text", "__hit"] and got.count() == 20_000
    hit = {r["t"] for r in got.filter("__hit").collect()}
    need = {r["t"] for r in wanted.collect()}
    assert need <= hit and len(hit) <= len(need) + 20
    assert near_copies._may_be_in(rows, wanted.limit(0), ["t", "k"]).filter("__hit").count() == 0


def test_rows_that_stay_do_not_travel(spark):
    """Only rows to drop or that repeat reach the joins with their text."""
    rng = random.Random(12)
    alone = [(k, prose(rng, 80)) for k in range(300)]
    rows = alone + [alone[5], (900, alone[6][1]), (901, edited(rng, alone[7][1], 1))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, may = [], near_copies._may_be_in

    def watched(table, wanted, names):
        if "doc_id" in table.columns:
            seen.append(may(table, wanted, names))
            return seen[-1]
        return may(table, wanted, names)

    near_copies._may_be_in = watched
    try:
        kept = near_copies.keep_one(frame)
    finally:
        near_copies._may_be_in = may
    assert Counter(r["doc_id"] for r in kept.collect()) == kept_by_brute_force(rows)
    assert len(seen) == 1 and seen[0].filter("__hit").count() <= 6


def tables_of_components(monkeypatch):
    """Names of the tables that the search for components writes from now on."""
    names, store = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: names.append(name) or store(df, name))
    return names


def test_components_write_a_table_a_round(spark, monkeypatch):
    """Stars are done when they are written; a round of others is one table, and no round only confirms the last."""
    names = tables_of_components(monkeypatch)
    for pairs, most in (([], 1), ([(0, k) for k in range(1, 40)] + [(50, 60), (60, 50)], 1), ([(k, k + 1) for k in range(64)], 8)):
        names.clear()
        found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
        assert found == grouped(pairs, {x for p in pairs for x in p})
        assert 1 <= len(names) <= most


def test_links_are_grouped_anew_by_label_alone(spark, monkeypatch):
    """Later rounds hang texts on the groups that are known, so few tables are written; groups are those of the links."""
    names = tables_of_components(monkeypatch)
    rows = [r[:2] for r in near_rows() if r[0] is not None]
    plain = stored(spark.createDataFrame([(k, k, k, t) for k, t in rows], "key bigint, t bigint, k bigint, text string"), "plain")
    classes = near_copies._classes(plain, "bigint")
    found, label = near_copies.linked(classes, lambda ids: plain.select("text").mapInArrow(near_copies._sets, "id bigint, shingles binary").dropDuplicates(["id"]).join(ids, "id"))
    pairs = {(r["a"], r["b"]) for r in found.collect()}
    ids = [r["id"] for r in classes.collect()]
    got = {r["id"]: r["label"] for r in label.collect()}
    assert len(pairs) > 20 and all(k != v for k, v in got.items())
    assert {k: got.get(k, k) for k in ids} == grouped(pairs, ids)
    assert len(names) <= 2 * (len(near_copies.ROUNDS) + 1)
