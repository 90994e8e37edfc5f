"""Groups of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

As in ``simhash`` a fingerprint has a bit for each place, set if it is set in over half of the shingles'
hashes; here it has ``BITS`` of them.  The distances to fixed reference fingerprints are tabled, pairs are
discarded by the largest difference of a coordinate, then by more than ``RADIUS`` differing bits, and survivors
are verified on the whole shingle sets.  A bit of two sets of similarity 0.8 differs with probability 0.15,
0.19 at most for small sets, so 1024 bits differ in more than 300 with probability below 1e-15.

Candidates share a key.  Blocks of equal bits as in ``simhash`` are no use at 15 per cent of differing bits.
A fingerprint has 64 groups of 16 bits instead, and a group's symbol is the bit whose count stands farthest
from half, and on which side: it is the same for two sets of similarity 0.8 with probability 0.53.  A key is five
symbols, and each of ``KEYS`` keys takes other groups: nine in ten pairs at 0.8 share one, nearly all at 0.9.

The pairs near the limit that no key finds are looked for by MinHash afterwards: ``BANDS`` bands of ``ROWS``
minima each, so a pair of similarity s shares none with probability (1 - s**ROWS)**BANDS, 3 in a million at
0.8.  Pairs of both kinds are also discarded by parity bits: each shingle flips one, and two sets differ in
at most as many as there are shingles in one set only, which bounds the similarity of short texts from above.

A group is found without listing its pairs.  In ``ROUNDS`` rounds each bucket has a leader, picked by
a hash from the group with most texts in it, and its texts outside that group are compared with the leader:
at most one pair for every text and bucket.  The first rounds have a few buckets of SimHash keys alone, so that a
large group hangs together before its other buckets are read; the last ones have those of all keys and
bands.  As the buckets of a text have different leaders, a group hangs together after that.  What is left are links between different groups of a bucket: these are looked for in one
join that discards as above before it puts out a pair, so only pairs that are links, or nearly, leave it.

Little travels.  A text stays in a bucket only if the sizes of its neighbours in it, by number of shingles, leave
room for a link.  Shingle sets are made anew in each round, for the texts of pairs that no fingerprint discards.
Texts are found, and the rows that stay are picked, by a bitmap of ``MARK_BITS`` bits that goes to every task: a
clash only lets a row through to an exact join that it did not need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, pieces, stored, text_of
from tidemark.llm.components import pointers
from tidemark.llm.one_permutation import SHINGLE, shingle_hashes

#: Similarity from which two texts link, in per cent of the shingles of both.
LEAST_PERCENT = 80
BANDS, ROWS = 32, 5
BITS, PIVOTS = 1024, 8
#: SimHash: bits in which two fingerprints may differ, keys, bits of a group and groups of a key.
RADIUS, KEYS, GROUP, PER_KEY = 300, 96, 16, 5
#: How many places, keys before bands, have buckets in each round.
ROUNDS = (4, 32, KEYS + BANDS, KEYS + BANDS)
#: Bits of the bitmaps that rows are picked by (4 MB): a fixed size, whatever the size of the corpus.
MARK_BITS = 25

_seeds = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ADD, _TIMES = (_seeds[0::2] >> np.uint64(32)).astype(np.uint32)[:, None], (_seeds[1::2] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_REFERENCE = mix64(np.arange(1, PIVOTS * BITS // 64 + 1, dtype=np.uint64) * _FOLD).view(np.uint8).reshape(PIVOTS, BITS // 8)
_WORDS = mix64(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
#: Groups of each key: a few random orders of all groups, cut into keys.
_ORDERS = mix64(np.arange(KEYS * PER_KEY * BITS // GROUP, dtype=np.uint64) ^ _FOLD).reshape(-1, BITS // GROUP).argsort(axis=1)
_GROUPS = _ORDERS[:, : BITS // GROUP // PER_KEY * PER_KEY].reshape(-1, PER_KEY)[:KEYS]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text in lower case; fewer than five words are one shingle."""
    return [np.unique(h) for h in shingle_hashes([t.lower() for t in texts], SHINGLE)]


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set; 0 for the empty one."""
    return int(mix64(mix64(shingles).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]) if len(shingles) else 0


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of the signature; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(low, ((high[None, at : at + 1024] ^ _ADD) * _TIMES).min(axis=1), out=low)
    keys = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        keys = mix64(keys * _FOLD + column)
    return keys.view(np.int64)


def balances(shingles: np.ndarray) -> np.ndarray:
    """For each of the ``BITS`` places: by how much the hashes with the bit set outnumber the others."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 255):  # as many as a byte can count
        hashes = mix64(shingles[at : at + 255, None] ^ _WORDS)
        counts += np.unpackbits(hashes.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * counts - len(shingles)


def simhash(balance: np.ndarray) -> np.ndarray:
    """SimHash bits, set where over half of the hashes have the bit, as signed 64-bit words."""
    return np.packbits(balance > 0).view(np.int64)


def keys(balance: np.ndarray) -> np.ndarray:
    """The keys of a fingerprint, from the bit of each group that stands farthest from half."""
    groups = balance.reshape(-1, GROUP)
    strongest = np.abs(groups).argmax(axis=1)
    symbols = 2 * strongest + (groups[np.arange(len(groups)), strongest] > 0)
    return symbols[_GROUPS] @ (2 * GROUP) ** np.arange(PER_KEY)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """Parity bits of a set, as signed 64-bit words."""
    flips = np.bincount((mix64(shingles) >> np.uint64(8)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def distances(bits: np.ndarray) -> np.ndarray:
    """Hamming distances of a fingerprint to the reference fingerprints."""
    return np.bitwise_count(bits.view(np.uint8) ^ _REFERENCE).sum(axis=1, dtype=np.int32)


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with hashes of each row's text and key, which name the row in joins."""
    return docs.withColumns({"__t": F.xxhash64(text_of(docs, text)), "__k": F.xxhash64(F.col(key))})


def _may_be_in(rows: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``__hit``: false only where ``wanted`` has no row of the same ``names``.

    The bitmap is a table of at most 2**MARK_BITS / 32768 rows of 4 KB, which Spark broadcasts.
    """
    place = F.xxhash64(*names).bitwiseAND(F.lit((1 << MARK_BITS) - 1)) + 1
    marks = wanted.groupBy(F.bitmap_bucket_number(place).alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__marks"))
    placed = rows.withColumns({"__part": F.bitmap_bucket_number(place), "__bit": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.substring("__marks", (F.floor(F.col("__bit") / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(marks), "__part", "left").withColumn("__hit", hit).drop("__part", "__bit", "__marks")


#: Keys, bands, SimHash bits, their distances to the reference fingerprints, parity bits.
SIGNATURE = ("keys", "bands", "bits", "far", "parity")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch):
            sets = shingle_sets(texts)
            columns = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            sums = [balances(s) for s in sets]
            prints = [simhash(x) for x in sums]
            lists = [([keys(x) if len(s) else [] for s, x in zip(sets, sums)], pa.int32()), ([bands(s) for s in sets], pa.int64())]
            lists += [(prints, pa.int64()), ([distances(x) for x in prints], pa.int32()), ([fingerprint(s) for s in sets], pa.int64())]
            columns += [pa.array(x, pa.list_(kind)) for x, kind in lists]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "t", "k")), *columns], names=["key", "t", "k", "id", "n", *SIGNATURE])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in pieces(batch):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= LEAST_PERCENT * (len(x) + len(y) - both))
        yield batch.drop_columns(["x", "y"]).filter(pa.array(keep, pa.bool_()))


def _checked(pairs: DataFrame, sets_of) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    pairs = stored(pairs, "plausible")
    names = [c for c in pairs.columns if c in ("a", "b", *LABELS)]
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    x, y = (sets.select(F.col("id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    return stored(pairs.join(x, "a").join(y, "b").select(*names, "x", "y").mapInArrow(_similar, ", ".join(f"{c} bigint" for c in names)), "similar")


def _sizes_fit(n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles can be similar enough."""
    return 100 * F.least(n, m) >= LEAST_PERCENT * F.greatest(n, m)


def _may_link(x: str, y: str):
    """Whether two signatures leave room for the similarity."""
    get = lambda side, c: F.col(f"{side}.{c}")
    both = get(x, "n") + get(y, "n")
    apart = F.greatest(*(F.abs(get(x, "far")[k] - get(y, "far")[k]) for k in range(PIVOTS)))

    def differ(bits: str):
        words = [F.bit_count(get(x, bits)[k].bitwiseXOR(get(y, bits)[k])) for k in range(BITS // 64)]
        return sum(words[1:], words[0])

    # Similarity p per cent of sets of n and m shingles leaves (n + m) * (100 - p) / (100 + p) that are in one only.
    room = (100 + LEAST_PERCENT) * differ("parity") <= (100 - LEAST_PERCENT) * both
    return _sizes_fit(get(x, "n"), get(y, "n")) & (apart <= RADIUS) & (differ("bits") <= RADIUS) & room


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose signatures leave room for the similarity."""
    x, y = classes.alias("x"), classes.alias("y")
    found = pairs.distinct().join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & _may_link("x", "y"))
    return found.select(pairs.columns)


#: What a and b belonged to when their pair was found.
LABELS = ("of_a", "of_b")


def _ordered(x: Column, y: Column) -> list[Column]:
    """a, b and their labels, from two structs of id and label."""
    low, high = F.least(x, y), F.greatest(x, y)
    return [low["id"].alias("a"), high["id"].alias("b"), low["label"].alias("of_a"), high["label"].alias("of_b")]


def _joined(label: DataFrame | None, new: DataFrame) -> DataFrame:
    """``label`` (id, label; an id without a row is its own) after new links: labels are linked, texts hang on theirs."""
    edges = new.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    if label is not None:
        edges = edges.unionByName(label.select(F.col("id").alias("a"), F.col("label").alias("b")))
    return pointers(edges).select(F.col("node").alias("id"), F.col("component").alias("label"))


def links(classes: DataFrame, sets_of) -> DataFrame:
    """(a, b): links that connect every group of ``classes`` (id, n and a signature); ``sets_of`` gives the sets of some ids, others may come too."""
    return linked(classes, sets_of)[0]


def linked(classes: DataFrame, sets_of) -> tuple[DataFrame, DataFrame]:
    """The ``links`` and the groups that they make: (id, label), without the ids that are their own label."""
    # Places below KEYS are those of SimHash keys; a class without words has neither keys nor bands.
    members = classes.select("id", "n", F.posexplode(F.concat(F.col("keys").cast("array<bigint>"), "bands")).alias("band", "h"))
    # In a bucket in order of size, one that fits neither neighbour fits no other.
    bucket = Window.partitionBy("band", "h")
    by_size = bucket.orderBy("n")
    beside = members.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    fits = (F.col("less").isNotNull() & _sizes_fit(F.col("less"), F.col("n"))) | (F.col("more").isNotNull() & _sizes_fit(F.col("n"), F.col("more")))
    shared = stored(beside.filter(fits).select("band", "h", "id", "n"), "buckets")
    prints = classes.select("id", "n", "bits", "far", "parity").join(shared.select("id").distinct(), "id", "left_semi")
    prints = stored(prints, "prints")
    mixed, found, label = shared.withColumn("label", F.col("id")), None, None
    for k, places in enumerate(ROUNDS):
        # Groups, leaders and texts of a bucket travel once; with no NULL left, both sides of the join are one exchange.
        buckets = mixed.filter(F.col("band") < places).dropna().repartition("band", "h")
        order = F.xxhash64("id", "band", F.lit(k))
        groups = buckets.groupBy("band", "h", "label").agg(F.count("*").alias("size"), F.min_by(F.struct("id", "n"), order).alias("first"))
        lead = groups.groupBy("band", "h").agg(F.max_by(F.struct("first.id", "first.n", "label"), F.struct("size", F.xxhash64("first.id", "band", F.lit(k)))).alias("lead"))
        outside = buckets.join(lead.hint("merge"), ["band", "h"]).filter((F.col("label") != F.col("lead.label")) & _sizes_fit(F.col("n"), F.col("lead.n")))
        pairs = outside.select(*_ordered(F.struct("id", "label"), F.struct("lead.id", "lead.label")))
        new = _checked(_plausible(pairs, prints), sets_of)
        if found is not None and new.isEmpty():
            continue
        found, label = new if found is None else found.unionByName(new), _joined(label, new)
        labelled = mixed.select("band", "h", "id", "n").join(label, "id", "left").select("band", "h", "id", "n", F.coalesce("label", "id").alias("label"))
        several = F.min("label").over(bucket) != F.max("label").over(bucket)
        mixed = stored(labelled.withColumn("several", several).filter("several").drop("several"), "mixed")
    rest = mixed.drop("n").join(prints, "id")
    x, y = rest.alias("x"), rest.alias("y")
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label"))
    between = x.join(y, on & _may_link("x", "y")).select(*_ordered(F.struct("x.id", "x.label"), F.struct("y.id", "y.label"))).distinct()
    new = _checked(between, sets_of)
    if not new.isEmpty():
        found, label = found.unionByName(new), _joined(label, new)
    return found.select("a", "b"), label


def _classes(plain: DataFrame, kind: str) -> DataFrame:
    """(id, head, n and a signature) of each shingle set of ``plain`` (key, t, k, text); ``head`` is its smallest row."""
    ddl = "keys array<int>, bands array<bigint>, bits array<bigint>, far array<int>, parity array<bigint>"
    rows = plain.mapInArrow(_signed, f"key {kind}, t bigint, k bigint, id bigint, n bigint, {ddl}")
    head = F.min(F.struct(F.isnull("key").alias("nokey"), "key", "t", "k")).alias("head")
    return stored(rows.groupBy("id").agg(head, *(F.first(c).alias(c) for c in ("n", *SIGNATURE))), "classes")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: of each group that chains of links connect, the one with the smallest key.

    Texts with the same shingles are one group, those without words included.  Of rows that
    repeat a key one stays at most.  A row without a key stays, one of its group, where no row
    of the group has a key.
    """
    named = _named(docs, key, text)
    plain = named.select(F.col(key).alias("key"), F.col("__t").alias("t"), F.col("__k").alias("k"), text_of(named, text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    classes = _classes(plain, kind)

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "id", "left_semi").select("head.t", "head.k")
        texts = _may_be_in(plain.select("t", "k", "text"), wanted, ["t", "k"]).filter("__hit").select("text")
        return texts.mapInArrow(_sets, "id bigint, shingles binary").dropDuplicates(["id"])

    root = classes.select("id", "head").join(linked(classes, sets_of)[1], "id", "left")
    heads = root.groupBy(F.coalesce("label", "id").alias("root")).agg(F.min("head").alias("head")).select("head.*")
    # Of texts that repeat a key and lead several groups, one stays.
    once = heads.groupBy("k", F.when(F.col("nokey"), F.col("t")).alias("own")).agg(F.min("t").alias("t"))
    once = stored(once.select(F.col("t").alias("__t"), F.col("k").alias("__k")), "kept")
    # Rows to drop and rows that repeat go through joins; all others stay where they are.
    names = named.groupBy("__t", "__k").agg(F.count("*").alias("n")).join(once.withColumn("stays", F.lit(True)), ["__t", "__k"], "left")
    picked = _may_be_in(named, names.filter("stays IS NULL OR n > 1"), ["__t", "__k"])
    alone = picked.filter("NOT __hit")
    doubtful = picked.filter("__hit").join(once, ["__t", "__k"], "left_semi").dropDuplicates(["__t", "__k"])
    return alone.select(docs.columns).unionByName(doubtful.select(docs.columns))
