import glob
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import WORDS, messy_rows
from tidemark.llm import resharding, warc
from tidemark.llm.common import new_folder

# WARC


@pytest.fixture(scope="module")
def pages(spark):
    from tidemark.storage import ship_package

    ship_package(spark)
    rng = random.Random(6)
    big = ["<html>" + "".join(rng.choices("abcdé\r\n", k=n)) + "</html>" for n in (990, 1200, 5000, 90_000)]
    html = [None, "", "small", "x" * 999, "x" * 1000, "é" * 500, "é" * 499 + "x", "WARC/1.1\r\n\r\nWARC/1.1\r\n" * 60]
    html += [rng.choice(big) for _ in range(40)] + ["x" * 1000, "x" * 999, "small"]
    rows = [(k * 3 + 7, rng.choice([None, "http://a/é", "http://b\r\nX: y"]), h, "extra", 1) for k, h in enumerate(html)]
    rows += [rows[10], (None, None, big[1], "extra", 1), (None, None, None, "extra", 1)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, n int").repartition(4)


def test_archives_round_trip(spark, pages):
    folder = new_folder(spark, "warc")
    warc.write_archives(pages, folder)
    got = Counter(tuple(r) for r in warc.resolved(warc.read_archives(spark, folder)).collect())
    rows = pages.collect()
    largest = {}
    for r in rows:
        raw = (r["html"] or "").encode()
        if len(raw) >= 1000 and r["page_id"] is not None:
            largest[raw] = max(largest.get(raw, -1), r["page_id"])
    want = Counter()
    for r in rows:
        raw = (r["html"] or "").encode()
        again = r["page_id"] is not None and r["page_id"] < largest.get(raw, -1)
        want[r["page_id"], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", largest[raw] if again else None] += 1
    assert got == want and any(k[3] == "revisit" for k in got)


def test_files_are_plain_warc(spark, pages):
    folder = new_folder(spark, "warc")
    warc.write_archives(pages, folder)
    payloads, kinds = Counter(), Counter()
    for name in glob.glob(f"{folder.removeprefix('file://')}/part-*"):
        with gzip.open(name) as f:
            for record in warc.parse(f.read()):
                kinds[record["warc-type"]] += 1
                head, _, body = record["block"].partition(b"\r\n\r\n")
                assert head.startswith(b"HTTP/1.1 200 OK")
                if record["warc-type"] == "response":
                    assert record["warc-payload-digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
                    payloads[body] += 1
                else:
                    assert not body and record["warc-refers-to"].startswith("<urn:uuid:")
    assert sum(kinds.values()) == pages.count()
    big = [b for b in payloads if len(b) >= 1000 and payloads[b] > 1]
    assert len(big) <= 1  # only the page without an id stores a payload a second time


def test_broken_archives_raise():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r["block"] for r in warc.parse(record * 2)] == [b"abc", b"abc"]
    for bad in (record[:-2], record[:-6], b"HTTP" + record):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
    assert warc._unpack(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"


def test_missing_response_and_empty_table(spark, pages):
    rows = [(1, "r1", "revisit", "d", "nowhere", None, None)]
    got = warc.resolved(spark.createDataFrame(rows, warc.HEADER_DDL)).first()
    assert got["payload_bytes"] is None and got["refers_to"] is None and got["payload_digest"] == "d"
    folder = new_folder(spark, "warc")
    warc.write_archives(pages.filter("n < 0"), folder)
    assert warc.resolved(warc.read_archives(spark, folder)).count() == 0


# Resharding


def check_shards(rows, docs, shards):
    want = Counter((r["doc_id"], r["text"], r["extra"]) for r in docs.collect())
    assert Counter((r["doc_id"], r["text"], r["extra"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r[resharding.NEW]].append(r[resharding.SLOT])
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for held in slots.values():
        assert sorted(held) == list(range(len(held)))


@pytest.mark.parametrize("old,new", [(3, 5), (5, 3), (4, 4), (1, 8)])
def test_reshard(spark, old, new):
    rows = [(k, r[1], "e") for k, r in enumerate(messy_rows(WORDS))] + [(None, None, None)] + [(7, "same", "s")] * 30
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra string").repartition(4)
    hot = F.when(F.col("doc_id") % 3 != 0, 0).otherwise(F.coalesce(F.col("doc_id"), F.lit(0)) % old)
    first, second = new_folder(spark, "old"), new_folder(spark, "new")
    resharding.lay_out(docs, first, hot)
    got = resharding.reshard(docs, first, second, new).collect()
    check_shards(got, docs, new)


def test_columns_of_any_name(spark):
    names = ["first", "end", "base", "hit", "moved", "shard", "class", "rows", "lo", "extra"]
    docs = spark.createDataFrame([(k, "t" * (k % 7), *range(10)) for k in range(60)], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names)).repartition(3)
    first = new_folder(spark, "old")
    resharding.lay_out(docs, first, F.lit(0))
    got = resharding.reshard(docs, first, new_folder(spark, "new"), 4)
    check_shards(got.collect(), docs, 4)
    assert sorted(map(tuple, got.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))


def test_reshard_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, extra string")
    first = new_folder(spark, "old")
    resharding.lay_out(docs, first, F.lit(0))
    assert resharding.reshard(docs, first, new_folder(spark, "new"), 8).count() == 0


def test_files_that_keep_their_rows_are_not_written_again(spark):
    docs = spark.createDataFrame([(k, "t" * (k % 9), "e") for k in range(400)], "doc_id bigint, text string, extra string").repartition(8)
    first, second = new_folder(spark, "old"), new_folder(spark, "new")
    resharding.lay_out(docs, first, F.col("doc_id") % 4)  # already even: 100 rows each
    check_shards(resharding.reshard(docs, first, second, 4).collect(), docs, 4)
    assert not glob.glob(f"{second.removeprefix('file://')}/*/part-*")


def brute_cost(classes, shards):
    """Cheapest split over all ways to give rows, one at a time, by exhaustive search."""
    rows = [(s, -(-b // r)) for s, _, r, b in classes for _ in range(r)]
    base, odd = divmod(len(rows), shards)

    def best(k, load, over):
        if k == len(rows):
            return 0
        found = float("inf")
        for j in range(shards):
            limit = load[j] < base
            if limit or (load[j] == base and over < odd):
                nxt = tuple(x + (i == j) for i, x in enumerate(load))
                found = min(found, (0 if rows[k][0] == j else rows[k][1]) + memo(k + 1, nxt, over + (not limit)))
        return found

    cache = {}

    def memo(*a):
        if a not in cache:
            cache[a] = best(*a)
        return cache[a]

    return memo(0, (0,) * shards, 0)


@pytest.mark.parametrize("seed", range(8))
def test_the_plan_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    shards = rng.randint(2, 3)
    classes = []
    for shard in range(rng.randint(1, 4)):
        for kind in range(rng.randint(1, 2)):
            n = rng.randint(1, 3)
            classes.append((shard, kind, n, n * rng.randint(1, 50)))
    plan = resharding.transfers(classes, shards)
    cost = {(s, k): -(-b // n) for s, k, n, b in classes}
    assert sum(n * cost[s, k] for s, k, j, n in plan if j != s) == brute_cost(classes, shards)
    took = Counter()
    for s, k, _, n in plan:
        took[s, k] += n
    assert took == Counter({(s, k): n for s, k, n, _ in classes})
