"""Scalar local-level models of any number of series of any length.

A series is cut into buckets of ``WIDTH`` steps.  What a bucket does to the state before it is one
small element, and elements compose: an associative operation.  The state at the start of every
bucket is the composition of all elements before it, found level by level (buckets of buckets),
so no list is longer than ``WIDTH`` and a long series is spread over its buckets.  Inside a bucket the
plain recursion is then replayed.  The smoother does the same from the end.

Series need a row for every step, the value of a missing one is NULL (see ``panel.dense_monthly``).
The level before the first step is ``START`` with variance ``SPREAD``.  All functions are JVM-side folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.factor import em_converged
from tidemark.schema import SERIES
from tidemark.storage import materialise

WIDTH = 64
START, SPREAD = 0.0, 1e6
#: Starting values of a fit: the share of a series' variance that is noise; the rest moves the level.
NOISE_SHARE = 0.5

_STEP = "struct<t:bigint, x:double, before:double, spread:double, a:double, p:double>"
_SMOOTH = "struct<t:bigint, x:double, level:double, variance:double, lag_cov:double, filtered:double, filtered_variance:double, change2:double, loglik:double>"


def month_number(period: Column) -> Column:
    """Consecutive number of a month."""
    return (F.year(period) * 12 + F.month(period) - 1).cast("bigint")


def every_step(rows: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """``rows`` (keys, t, ...) with a row for every step from a series' first to its last, a bucket of steps at a time."""
    ends = rows.groupBy(*keys).agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    starts = ends.withColumn("_start", F.explode(F.expr(f"sequence(_low, _high, {width}L)")))
    grid = starts.select(*keys, F.explode(F.sequence("_start", F.least(F.col("_start") + width - 1, "_high"))).alias("t"))
    return grid.join(rows, [*keys, "t"], "left")


# ---------------------------------------------------------------- the scan


def compositions(
    items: DataFrame, keys: list[str], compose: Callable[[Column, Column], Column], identity: Column, levels: int, width: int
) -> DataFrame:
    """(keys, pos, before): what all elements ``e`` at smaller positions ``pos`` compose to; ``identity`` at the first.

    ``levels`` is how often positions can be divided by ``width`` until one bucket is left.
    """
    bucket = F.floor(F.col("pos") / width).cast("bigint")
    one = F.struct(F.col("pos").alias("pos"), F.col("e").alias("e"))
    lists = items.groupBy(*keys, bucket.alias("up")).agg(F.sort_array(F.collect_list(one)).alias("es"))
    if levels > 1:
        whole = F.aggregate("es", identity, lambda s, x: compose(s, x["e"]))
        above = lists.select(*keys, F.col("up").alias("pos"), whole.alias("e"))
        first = compositions(above, keys, compose, identity, levels - 1, width).withColumnRenamed("pos", "up")
        lists = lists.join(first, [*keys, "up"])
    else:
        lists = lists.withColumn("before", identity)
    kind = lists.schema["before"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<pos:bigint, before:{kind}>>")

    def walk(s: Column, x: Column) -> Column:
        return F.struct(
            compose(s["now"], x["e"]).alias("now"),
            F.array_append(s["out"], F.struct(x["pos"].alias("pos"), s["now"].alias("before"))).alias("out"),
        )

    walked = F.aggregate("es", F.struct(F.col("before").alias("now"), empty.alias("out")), walk)["out"]
    return lists.select(*keys, F.explode(walked).alias("o")).select(*keys, "o.pos", "o.before")


def _struct(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _forward() -> Column:
    """The filter element that changes nothing."""
    return _struct(a=F.lit(1.0), b=F.lit(0.0), c=F.lit(0.0), eta=F.lit(0.0), j=F.lit(0.0))


def _backward() -> Column:
    return _struct(g=F.lit(1.0), c=F.lit(0.0), h=F.lit(1.0), d=F.lit(0.0))


def _then(i: Column, j: Column) -> Column:
    """Filter elements of two stretches, the earlier one first: level after = a * level before + b with variance
    c, and what the observations say about the level before, as eta and j."""
    k = 1 / (1 + i["c"] * j["j"])
    return _struct(
        a=j["a"] * k * i["a"],
        b=j["a"] * k * (i["b"] + i["c"] * j["eta"]) + j["b"],
        c=j["a"] * j["a"] * k * i["c"] + j["c"],
        eta=i["a"] * k * (j["eta"] - j["j"] * i["b"]) + i["eta"],
        j=i["a"] * i["a"] * k * j["j"] + i["j"],
    )


def _one(x: Column, q: Column, r: Column) -> Column:
    """Filter element of one step."""
    f, seen = q + r, x.isNotNull()
    return _struct(
        a=F.when(seen, r / f).otherwise(1.0),
        b=F.when(seen, q / f * x).otherwise(0.0),
        c=F.when(seen, q * r / f).otherwise(q),
        eta=F.when(seen, x / f).otherwise(0.0),
        j=F.when(seen, 1 / f).otherwise(0.0),
    )


def _later(i: Column, j: Column) -> Column:
    """Smoother elements: level = g * (level after the stretch) + c, variance = h * (variance after) + d."""
    return _struct(g=j["g"] * i["g"], c=j["g"] * i["c"] + j["c"], h=j["h"] * i["h"], d=j["h"] * i["d"] + j["d"])


# ---------------------------------------------------------------- filter and smoother


def bucketed(obs: DataFrame, t: Column, value: str = "value", keys: list[str] = SERIES, width: int = WIDTH) -> DataFrame:
    """(keys, bucket, xs): the steps of each bucket of each series in order, stored."""
    rows = obs.select(*keys, t.cast("bigint").alias("t"), F.col(value).cast("double").alias("x"))
    grouped = rows.groupBy(*keys, F.floor(F.col("t") / width).cast("bigint").alias("bucket"))
    return materialise(grouped.agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("xs")), "buckets")


def levels_of(buckets: DataFrame, width: int = WIDTH) -> int:
    """How many levels of buckets a scan needs; positions count from the first bucket of all."""
    ends = buckets.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
    span, levels = (ends["high"] or 0) - (ends["low"] or 0) + 1, 1
    while width**levels < span:
        levels += 1
    return levels


def _positions(buckets: DataFrame, backward: bool = False) -> Column:
    edge = buckets.agg((F.max if backward else F.min)("bucket")).scalar()
    return edge - F.col("bucket") if backward else F.col("bucket") - edge


def filter_buckets(buckets: DataFrame, keys: list[str], levels: int, width: int = WIDTH) -> DataFrame:
    """``buckets`` with columns q and r, and the filtered ``path`` of each bucket's steps.

    A step has the level and variance ``before`` (``spread``) and after its value (``a``, ``p``).
    """
    q, r = F.col("q"), F.col("r")
    element = F.aggregate("xs", _forward(), lambda s, x: _then(s, _one(x["x"], q, r)))
    items = buckets.select(*keys, _positions(buckets).alias("pos"), element.alias("e"))
    before = compositions(items, keys, _then, _forward(), levels, width)
    led = buckets.withColumn("pos", _positions(buckets)).join(before, [*keys, "pos"])
    k = 1 / (1 + SPREAD * F.col("before.j"))
    a0 = F.col("before.a") * k * (START + SPREAD * F.col("before.eta")) + F.col("before.b")
    p0 = F.col("before.a") * F.col("before.a") * k * SPREAD + F.col("before.c")

    def step(s: Column, x: Column) -> Column:
        p = s["p"] + q
        f, seen = p + r, x["x"].isNotNull()
        level = F.when(seen, s["a"] + p / f * (x["x"] - s["a"])).otherwise(s["a"])
        spread = F.when(seen, p * r / f).otherwise(p)
        row = _struct(t=x["t"], x=x["x"], before=s["a"], spread=p, a=level, p=spread)
        return _struct(a=level, p=spread, path=F.array_append(s["path"], row))

    path = F.aggregate("xs", _struct(a=a0, p=p0, path=F.array().cast(f"array<{_STEP}>")), step)["path"]
    return led.select(*keys, "bucket", "q", "r", path.alias("path"))


def smooth_buckets(paths: DataFrame, keys: list[str], levels: int, width: int = WIDTH) -> DataFrame:
    """(keys, bucket, q, r, path): each step's level, variance and covariance with the step before it, given all values."""
    q, r = F.col("q"), F.col("r")
    paths = materialise(paths, "filtered")
    back = F.reverse("path")

    def fold(s: Column, x: Column) -> Column:
        g = x["p"] / (x["p"] + q)
        return _later(s, _struct(g=g, c=(1 - g) * x["a"], h=g * g, d=x["p"] * (1 - g)))

    items = paths.select(*keys, _positions(paths, True).alias("pos"), F.aggregate(back, _backward(), fold).alias("e"))
    after = compositions(items, keys, _later, _backward(), levels, width)
    end = F.element_at("path", -1)
    # After the last step nothing is known but the filtered level and one more step's variance.
    last = paths.groupBy(*keys).agg(F.max_by(_struct(level=end["a"], variance=end["p"] + q), "bucket").alias("last"))
    led = paths.withColumn("pos", _positions(paths, True)).join(after, [*keys, "pos"]).join(last, keys)
    start = _struct(
        level=F.col("before.g") * F.col("last.level") + F.col("before.c"),
        variance=F.col("before.h") * F.col("last.variance") + F.col("before.d"),
        out=F.array().cast(f"array<{_SMOOTH}>"),
    )

    def step(s: Column, x: Column) -> Column:
        g = x["p"] / (x["p"] + q)
        level, variance = g * s["level"] + (1 - g) * x["a"], g * g * s["variance"] + x["p"] * (1 - g)
        held = (x["spread"] - q) / x["spread"]  # the same gain, of the step before
        moved = (1 - held) * (level - x["before"])
        f, miss = x["spread"] + r, x["x"] - x["before"]
        row = _struct(
            t=x["t"], x=x["x"], level=level, variance=variance, lag_cov=held * variance, filtered=x["a"], filtered_variance=x["p"],
            change2=moved * moved + (1 - held) * (1 - held) * variance + (x["spread"] - q) * (1 - held),
            loglik=-0.5 * (F.log(f) + miss * miss / f),
        )
        return _struct(level=level, variance=variance, out=F.array_append(s["out"], row))

    path = F.reverse(F.aggregate(back, start, step)["out"])
    return led.select(*keys, "bucket", "q", "r", path.alias("path"))


def with_variances(buckets: DataFrame, level_var, noise_var) -> DataFrame:
    return buckets.withColumns({"q": F.lit(level_var).cast("double"), "r": F.lit(noise_var).cast("double")})


def local_level_scan(
    obs: DataFrame, t: Column, level_var: float, noise_var: float, value: str = "value", keys: list[str] = SERIES, width: int = WIDTH
) -> DataFrame:
    """Last level, its variance, likelihood and number of values of each series, however long."""
    buckets = bucketed(obs, t, value, keys, width)
    paths = filter_buckets(with_variances(buckets, level_var, noise_var), keys, levels_of(buckets, width), width)
    r = F.col("r")

    def add(s: Column, x: Column) -> Column:
        f, miss = x["spread"] + r, x["x"] - x["before"]
        return s + F.when(x["x"].isNotNull(), -0.5 * (F.log(f) + miss * miss / f)).otherwise(0.0)

    end = F.element_at("path", -1)
    sums = paths.select(
        *keys, "bucket", _struct(a=end["a"], p=end["p"]).alias("end"), F.aggregate("path", F.lit(0.0), add).alias("ll"),
        F.size(F.filter("path", lambda x: x["x"].isNotNull())).alias("n"),
    )
    out = sums.groupBy(*keys).agg(F.max_by("end", "bucket").alias("end"), F.sum("ll").alias("ll"), F.sum("n").cast("int").alias("n"))
    return out.select(*keys, F.col("end.a").alias("level"), F.col("end.p").alias("variance"), F.col("ll").alias("loglik"), F.col("n").alias("observations"))


def smooth_levels(
    obs: DataFrame, t: Column, level_var: float, noise_var: float, value: str = "value", keys: list[str] = SERIES, width: int = WIDTH
) -> DataFrame:
    """(keys, t, value, filtered, filtered_variance, level, variance, lag_cov) of every step given the whole series.

    ``lag_cov`` is the covariance of the level with the level of the step before, at the first step with the one
    the series starts from.
    """
    buckets = bucketed(obs, t, value, keys, width)
    levels = levels_of(buckets, width)
    paths = filter_buckets(with_variances(buckets, level_var, noise_var), keys, levels, width)
    smooth = smooth_buckets(paths, keys, levels, width).select(*keys, F.explode("path").alias("s"))
    return smooth.select(
        *keys, "s.t", F.col("s.x").alias(value), "s.filtered", "s.filtered_variance", "s.level", "s.variance", "s.lag_cov"
    )


def value_weights(paths: DataFrame, keys: list[str], levels: int, width: int = WIDTH) -> DataFrame:
    """(keys, t, weight): what each value counts in the last filtered level; missing ones count 0.

    A value enters with its step's gain, and every later value takes its own gain off what was there.
    """
    r = F.col("r")
    gain = lambda x: F.when(x["x"].isNotNull(), x["spread"] / (x["spread"] + r)).otherwise(0.0)
    back = F.reverse("path")
    kept = F.aggregate(back, F.lit(1.0), lambda s, x: s * (1 - gain(x)))
    items = paths.select(*keys, _positions(paths, True).alias("pos"), kept.alias("e"))
    after = compositions(items, keys, lambda i, j: i * j, F.lit(1.0), levels, width)

    def step(s: Column, x: Column) -> Column:
        row = _struct(t=x["t"], weight=gain(x) * s["left"])
        return _struct(left=s["left"] * (1 - gain(x)), out=F.array_append(s["out"], row))

    start = _struct(left=F.col("before"), out=F.array().cast("array<struct<t:bigint, weight:double>>"))
    led = paths.withColumn("pos", _positions(paths, True)).join(after, [*keys, "pos"])
    return led.select(*keys, F.explode(F.aggregate(back, start, step)["out"]).alias("w")).select(*keys, "w.*")


# ---------------------------------------------------------------- news


def level_news(
    cells: DataFrame, keys: list[str], t: Column, level_var: float, noise_var: float, width: int = WIDTH
) -> tuple[DataFrame, DataFrame]:
    """Each update of a local level's last step split over the cells behind it: (updates, changed cells).

    ``cells`` has the old and new value of every step of a series up to the target step, one series for each of
    ``keys``.  Old values that were revised are read again first (``y_old`` to ``y_rev``), then new ones are released.
    A release counts by what the model did not expect of it, given all revised values; as the level is linear in the
    values, weights come from the filter's gains, and revisions and releases add up to ``y_new`` exactly.  A
    value that is withdrawn keeps its old reading.
    """
    old, new = F.col("old"), F.coalesce("new", "old")
    views = F.array(
        *(F.struct(F.lit(n).alias("view"), v.cast("double").alias("value")) for n, v in (("old", old), ("rev", F.when(old.isNotNull(), new)), ("new", new)))
    )
    plain = cells.select(*keys, t.cast("bigint").alias("t"), F.explode(views).alias("v")).select(*keys, "t", "v.*")
    by = [*keys, "view"]
    buckets = bucketed(plain, F.col("t"), "value", by, width)
    levels = levels_of(buckets, width)
    paths = materialise(filter_buckets(with_variances(buckets, level_var, noise_var), by, levels, width), "views")
    end = F.element_at("path", -1)["a"]
    at = paths.groupBy(*by).agg(F.max_by(end, "bucket").alias("y")).groupBy(*keys).agg(
        *(F.max(F.when(F.col("view") == n, F.col("y"))).alias(f"y_{n}") for n in ("old", "rev", "new"))
    )
    weights = value_weights(paths.where("view <> 'old'"), by, levels, width)
    expected = smooth_buckets(paths.where("view = 'rev'"), by, levels, width).select(*keys, F.explode("path").alias("s"))
    expected = expected.select(*keys, "s.t", F.col("s.level").alias("expected"))
    changed = cells.select(*keys, t.cast("bigint").alias("t"), "old", new.alias("actual")).where("NOT old <=> actual")
    kind = F.when(F.col("old").isNull(), "release").otherwise("revision")
    changed = changed.withColumn("kind", kind).withColumn("view", F.when(F.col("old").isNull(), "new").otherwise("rev"))
    detail = changed.join(weights, [*by, "t"]).join(expected, [*keys, "t"]).withColumn(
        "forecast", F.when(F.col("kind") == "release", F.col("expected")).otherwise(F.col("old"))
    )
    detail = detail.select(*keys, "t", "kind", "forecast", "actual", "weight", (F.col("weight") * (F.col("actual") - F.col("forecast"))).alias("impact"))
    detail = materialise(detail, "news-cells")
    sums = detail.groupBy(*keys).agg(
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("impact"))), F.lit(0.0)).alias(f"impact_{k}s") for k in ("revision", "release")),
        *(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("revision", "release")),
    )
    return at.join(sums, keys, "left").na.fill(0.0, ["impact_revisions", "impact_releases"]).na.fill(0, ["revisions", "releases"]), detail


# ---------------------------------------------------------------- fitting


def _sums(smooth: DataFrame, keys: list[str]) -> DataFrame:
    """Per series what a round of the fit needs: numbers of steps and values, squared changes and misses, likelihood."""

    def add(s: Column, x: Column) -> Column:
        seen, miss = x["x"].isNotNull(), x["x"] - x["level"]
        return _struct(
            steps=s["steps"] + 1.0,
            values=s["values"] + F.when(seen, 1.0).otherwise(0.0),
            change2=s["change2"] + x["change2"],
            miss2=s["miss2"] + F.when(seen, miss * miss + x["variance"]).otherwise(0.0),
            loglik=s["loglik"] + F.coalesce(x["loglik"], F.lit(0.0)),
        )

    zero = _struct(**{n: F.lit(0.0) for n in ("steps", "values", "change2", "miss2", "loglik")})
    one = smooth.select(*keys, "q", "r", F.aggregate("path", zero, add).alias("s"))
    return one.groupBy(*keys).agg(
        F.first("q").alias("q"), F.first("r").alias("r"), *(F.sum(f"s.{n}").alias(n) for n in ("steps", "values", "change2", "miss2", "loglik"))
    )


def starting_variances(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q, r): a series' variance, split; one without two different values isn't fitted."""
    values = buckets.select(*keys, F.explode("xs").alias("s")).groupBy(*keys).agg(F.var_samp("s.x").alias("v"))
    return values.where(F.col("v") > 0).select(*keys, (F.col("v") * (1 - NOISE_SHARE)).alias("q"), (F.col("v") * NOISE_SHARE).alias("r"))


def fit_local_level(
    obs: DataFrame,
    t: Column,
    rounds: int,
    threshold: float = 1e-4,
    value: str = "value",
    keys: list[str] = SERIES,
    width: int = WIDTH,
    trace: DataFrame | None = None,
) -> DataFrame:
    """Trace of the fit of every series by expectation maximisation: (keys, iteration, level_var, noise_var, next_level_var,
    next_noise_var, loglik, change, converged, decreased).

    Each round smooths all series that have not converged under their variances and takes the expected
    squared changes and misses as the next ones, so the likelihood can't fall.  Every round is a stored
    table; ``trace``, the result of an earlier call, is gone on from where it ends.  A series
    stops by the rule of ``em_converged`` on its own likelihood, all stop after ``rounds`` iterations.
    """
    buckets = bucketed(obs, t, value, keys, width)
    levels = levels_of(buckets, width)
    done: list[DataFrame] = []
    plain = [*keys, "iteration", "level_var", "noise_var", "next_level_var", "next_noise_var", "loglik"]
    first = 1
    if trace is None:
        state = starting_variances(buckets, keys)
    else:
        done.append(materialise(trace.select(*plain), "trace"))
        first = (done[0].agg(F.max("iteration")).first()[0] or 0) + 1
        state = _open(done[0], keys, threshold)
    for k in range(first, rounds + 1):
        active = buckets.join(state, keys)
        smooth = smooth_buckets(filter_buckets(active, keys, levels, width), keys, levels, width)
        sums = _sums(smooth, keys).select(
            *keys, F.lit(k).alias("iteration"), F.col("q").alias("level_var"), F.col("r").alias("noise_var"),
            (F.col("change2") / F.col("steps")).alias("next_level_var"), (F.col("miss2") / F.col("values")).alias("next_noise_var"), "loglik",
        )
        done.append(materialise(sums, f"round-{k}"))
        state = _open(_union(done), keys, threshold)
        if k < rounds and k >= 4 and state.isEmpty():
            break
    return em_converged(_union(done), threshold, keys).select(*plain, "change", "converged", "decreased")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _open(trace: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, q, r) for the next round of the series that have not converged."""
    ended = em_converged(trace, threshold, keys).groupBy(*keys).agg(
        F.max_by(F.struct("next_level_var", "next_noise_var"), "iteration").alias("v"), F.max("converged").alias("converged")
    )
    return ended.where("NOT converged").select(*keys, F.col("v.next_level_var").alias("q"), F.col("v.next_noise_var").alias("r"))
