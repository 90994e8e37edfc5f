import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import WORDS, messy_rows, words
from tidemark.llm import attention, quality_rules

SPACES = " \t\n\x0b\x0c\r"


def measured(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def bucket(v):
    drop = max(0, v.bit_length() - 6)
    return v >> drop << drop


def quartiles(values):
    values = sorted(map(bucket, values))
    at = lambda q: next(v for k, v in enumerate(values, 1) if k * 4 >= len(values) * q)
    return at(1), at(3)


def verdicts(rows):
    made = []
    for r in rows:
        n, chars, symbols, lines, repeats = measured(r["text"])
        rates = None
        if n:
            rates = dict(zip(quality_rules.RULES, (symbols * 1000 // n, (r["text"] or "").count("!") * 1000 // n, chars * 100 // n, lines * 1000 // n, repeats * 1000 // n)))
        made.append((r["doc_id"], r["lang"] or "", r["source"] or "", (n, chars, symbols, lines, repeats), rates))
    out = []
    for key, lang, source, base, rates in made:
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        over = False
        for rule, step in quality_rules.RULES.items():
            for group in ([m for m in made if m[1:3] == (lang, source)], [m for m in made if m[1] == lang], made):
                values = [m[4][rule] for m in group if m[4]]
                if len(values) >= quality_rules.LEAST_DOCUMENTS or group is made:
                    break
            if rates:
                a, b = quartiles(values)
                over |= rates[rule] > b + quality_rules.SPREAD * max(b - a, step)
        out.append((key, *base, failed, not failed and not over))
    return out


def test_measures_and_verdicts(messy, empty):
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = Counter(tuple(r) for r in quality_rules.judged(messy).select(*shown).collect())
    assert got == Counter(verdicts(messy.collect()))
    assert quality_rules.judged(empty).count() == 0


def test_kept_rows_are_unchanged(messy, empty):
    kept = Counter(quality_rules.keep_good(messy).collect())
    good = {v[0] for v in verdicts(messy.collect()) if v[-1]}
    assert kept == Counter(r for r in messy.collect() if r["doc_id"] in good)
    assert quality_rules.keep_good(empty).columns == messy.columns


def test_rows_that_share_a_key_have_their_own_verdict(spark):
    good, bad = " ".join(f"word{k}" for k in range(80)), "too short"
    rows = [(k, t, "en", "s") for k in (None, None, 7) for t in (good, bad)] + [(8, bad, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert Counter(quality_rules.keep_good(docs).collect()) == Counter({(None, good, "en", "s"): 2, (7, good, "en", "s"): 1})


def test_buckets_are_narrow_and_ordered(spark):
    values = [*range(2000), 10**6, 10**9 + 7, 2**50 + 1]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", quality_rules.bucket(F.col("v")).alias("b")).collect()
    for r in got:
        assert r["b"] == bucket(r["v"]) <= r["v"] <= r["b"] * 33 / 32 + 1


def test_sketches_merge(messy):
    rated = quality_rules.rates(quality_rules.measures(messy))
    parts = quality_rules.sketches(rated.filter("doc_id % 2 = 0")).unionByName(quality_rules.sketches(rated.filter("coalesce(doc_id % 2, 1) <> 0")))
    whole = quality_rules.sketches(rated)
    by = ["lang", "source"]
    assert Counter(quality_rules.merged(parts, by).collect()) == Counter(quality_rules.merged(whole, by).collect())


def test_no_python_in_the_plan(messy, capsys):
    quality_rules.judged(messy).explain()
    assert "Python" not in capsys.readouterr().out.replace("messy", "")


def test_passages_cover_the_whole_text():
    texts = [(r[1] or "").encode() for r in messy_rows(WORDS)]
    x, bag = attention.passages(texts)
    assert len(bag) == len(texts) + 1 and bag[-1] == len(x) and (np.diff(bag) > 0).all()
    for k, t in enumerate(texts):
        n = len(t.split())
        assert bag[k + 1] - bag[k] == max(1, n // attention.PASSAGE + (n % attention.PASSAGE >= attention.REST))
        alone, _ = attention.passages([t])
        assert np.allclose(alone, x[bag[k] : bag[k + 1]])


def test_gradients():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, attention.WIDTH)).astype(np.float32)
    bag, y = np.array([0, 3, 4, 9, 12]), np.array([1.0, 0, 1, 0])
    model = attention.fit(x, bag, y, epochs=400)
    assert ((model.score(x, bag) > 0.5) == (y > 0.5)).all()
    assert np.array_equal(model.score(x, bag), attention.fit(x, bag, y, epochs=400).score(x, bag))


@pytest.fixture(scope="module")
def marked(spark):
    from tidemark.storage import ship_package

    ship_package(spark)
    base = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


def test_held_out_accuracy(marked):
    docs, labels = marked
    model = attention.train(docs, labels)
    rows = attention.scored(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in held)
    assert len(held) > 50 and right / len(held) > 0.97
    kept = attention.keep_good(docs, model, 0.3)
    assert kept.columns == docs.columns
    assert kept.count() == attention.scored(docs, model).filter("score >= 0.3").count()


def test_held_out_labels_are_not_read(marked):
    docs, labels = marked
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = attention.train(docs, labels), attention.train(docs, turned)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_awkward_rows(spark, messy, empty):
    labels = spark.createDataFrame([(k, k % 2, "?") for k in range(30)] + [(None, 1, "?"), (3, None, "?")], "doc_id bigint, quality int, text string")
    model = attention.train(messy, labels)
    scores = attention.scored(messy, model).collect()
    assert len(scores) == messy.count() and all(0 <= r["score"] <= 1 for r in scores)
    same = {}
    for r, s in zip(sorted(messy.collect(), key=lambda r: r["doc_id"] or -1), sorted(scores, key=lambda r: r["doc_id"] or -1)):
        assert same.setdefault(r["text"] or "", s["score"]) == s["score"] or not (r["text"] or "").strip()
    assert attention.scored(empty, model).count() == 0
    none = attention.train(messy, labels.filter("doc_id < 0"))
    assert {r["score"] for r in attention.scored(messy, none).collect()} == {0.5}


def plain_score(model, x):
    """One document, one passage after the other."""
    w = {k: v.astype(float) for k, v in model.weights.items()}
    hidden, logits = [], []
    for row in x:
        row = np.clip((row - model.mean) / model.scale, -8, 8)
        h = np.array([np.tanh(sum(row[i] * w["encode"][i][k] for i in range(len(row))) + w["encode_bias"][k]) for k in range(len(w["encode_bias"]))])
        look = np.tanh(h @ w["look"])
        gate = 1 / (1 + np.exp(-(h @ w["gate"] + w["gate_bias"])))
        hidden.append(h)
        logits.append(float((look * gate) @ w["attend"]))
    weights = np.exp(np.array(logits) - max(logits))
    z = sum(a * h for a, h in zip(weights / weights.sum(), hidden))
    return 1 / (1 + np.exp(-float(z @ w["judge"] + w["judge_bias"][0])))


def small_model(seed=1, bags=(1, 3, 2, 5, 1, 4)):
    rng = np.random.default_rng(seed)
    bag = np.concatenate([[0], np.cumsum(bags)])
    x = rng.normal(size=(bag[-1], attention.WIDTH))
    y = np.arange(len(bags)) % 2 * 1.0
    model = attention.fit(x, bag, y, epochs=15)
    return x, bag, y, attention.Model(model.mean.astype(float), model.scale.astype(float), {k: v.astype(float) for k, v in model.weights.items()})


def test_scores_against_single_passages():
    x, bag, _, model = small_model()
    got = model.score(x, bag)
    assert got == pytest.approx([plain_score(model, x[a:b]) for a, b in zip(bag, bag[1:])])


def test_gradient_against_differences():
    x, bag, y, model = small_model(3)

    def loss():
        s = model.score(x, bag)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grad = attention.gradient(model, x, bag, y)
    rng = np.random.default_rng(0)
    for name, w in model.weights.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in w.shape)
            kept = w[at]
            w[at] = kept + 1e-5
            up = loss()
            w[at] = kept - 1e-5
            down = loss()
            w[at] = kept
            assert np.asarray(grad[name])[at] == pytest.approx((up - down) / 2e-5, abs=1e-7), name


def test_fit_is_bounded_in_rows_and_passages(spark):
    """Rows that repeat a key are one document; long ones give passages from all over."""
    rows = [(k % 5, "good words here " * 10 + str(k % 3)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id bigint, quality int")
    _, bag, y = attention._sampled(docs, labels, "doc_id", "text", "quality", 2000)
    assert len(y) <= 5 and len(bag) == len(y) + 1
    x = np.arange(2000.0)[:, None]
    assert attention.spaced(x, 100)[:, 0].tolist() == list(range(0, 2000, 20)) and len(attention.spaced(x[:40], 100)) == 40
