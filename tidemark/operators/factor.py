"""Factor-model building blocks that scale within a panel as joins and aggregates.

``z`` panels have model, vintage, series_id, period and a standardised value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.impact import with_category
from tidemark.schema import PANEL, SERIES, TENT
from tidemark.storage import materialise

LAG_NAMES = [f"f{k}" for k in range(len(TENT))]
#: Fixed value: a likelihood that falls by more than this counts as falling.
FALL = -1e-3


def block_table(spec: DataFrame, blocks: list[str]) -> DataFrame:
    """Series by block matrix of 0/1 loadings."""
    cols = [F.array_contains("blocks", b).cast("int").alias(b) for b in blocks]
    return spec.select("model", "series_id", *cols)


def in_blocks(z: DataFrame, spec: DataFrame) -> DataFrame:
    """Observations once for every block that their series loads on, with the block's name."""
    members = spec.select("model", "series_id", F.explode("blocks").alias("block"))
    return z.join(members, ["model", "series_id"])


# ---------------------------------------------------------------- covariance


def panel_gram(z: DataFrame, value: str = "z", by: list[str] = PANEL) -> DataFrame:
    """Sample covariance of every pair of series over their common periods (i <= j).

    The pairs of one block of series are the result, so a block is meant to be
    small; ``by`` names what makes a block.
    """
    known = z.where(F.col(value).isNotNull())
    keys = [*by, "period"]
    left = known.select(*keys, F.col("series_id").alias("series_i"), F.col(value).alias("_i"))
    right = known.select(*keys, F.col("series_id").alias("series_j"), F.col(value).alias("_j"))
    both = left.join(right, keys).where(F.col("series_i") <= F.col("series_j"))
    return both.groupBy(*by, "series_i", "series_j").agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp("_i", "_j").alias("cov")
    )


#: Squarings of the covariance matrix, which raise it to the power 2**SQUARINGS, and the largest
#: share of a unit vector by which its image may miss a multiple of it.
SQUARINGS, TOLERANCE = 14, 1e-7
#: So many squarings are one query; their result is stored.
STORED = 2


def square_matrix(gram: DataFrame, by: list[str] = PANEL) -> DataFrame:
    """Both triangles of a covariance table as entries (i, j, v); NULL counts as 0."""
    v = F.coalesce("cov", F.lit(0.0)).alias("v")
    upper = gram.select(*by, F.col("series_i").alias("i"), F.col("series_j").alias("j"), v)
    lower = gram.where("series_i <> series_j").select(*by, F.col("series_j").alias("i"), F.col("series_i").alias("j"), v)
    return upper.unionByName(lower)


def leading_vector(gram: DataFrame, by: list[str] = PANEL) -> DataFrame:
    """Leading eigenvector of each block's covariance, signed to a non-negative sum.

    The matrices of all blocks, shifted by their largest row sum so that no
    eigenvalue is negative, are squared together by a join and a sum, and
    scaled to trace 1, until only the leading direction is left; each square is
    stored, as the next one reads it twice.  The largest column is the vector,
    of equal ones the first by name; a sum of 0 leaves its sign.
    Where its image is no multiple of it within ``TOLERANCE`` the rows fail; a
    block without any variance has NULL loadings.
    """
    entries = materialise(square_matrix(gram, by), "gram")
    rows = entries.groupBy(*by, "i").agg(F.sum(F.abs("v")).alias("_s")).groupBy(*by).agg(F.max("_s").alias("_s"))
    diagonal = F.when(F.col("i") == F.col("j"), F.col("_s")).otherwise(0.0)
    power = entries.join(rows, by).select(*by, "i", "j", (F.col("v") + diagonal).alias("v"))
    for k in range(SQUARINGS):
        left = power.select(*by, "i", F.col("j").alias("k"), F.col("v").alias("_l"))
        right = power.select(*by, F.col("i").alias("k"), "j", F.col("v").alias("_r"))
        product = left.join(right, [*by, "k"]).groupBy(*by, "i", "j").agg(F.sum(F.col("_l") * F.col("_r")).alias("v"))
        trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).over(Window.partitionBy(*by))
        power = product.withColumn("v", F.try_divide("v", trace))
        if k % STORED == STORED - 1:
            power = materialise(power, "power")
    largest = power.where("i = j").groupBy(*by).agg(F.min_by("i", F.struct(-F.round("v", 9), "i")).alias("j"))
    series = entries.select(*by, "i").distinct()
    column = series.join(power.join(largest, [*by, "j"]).select(*by, "i", "v"), [*by, "i"], "left")
    column = column.withColumn("v", F.coalesce("v", F.lit(0.0)))
    block = Window.partitionBy(*by)
    sign = F.when(F.round(F.sum("v").over(block), 9) < 0, -1.0).otherwise(1.0)
    unit = column.select(*by, "i", F.try_divide(sign * F.col("v"), F.sqrt(F.sum(F.col("v") * F.col("v")).over(block))).alias("x"))
    image = entries.join(unit.select(*by, F.col("i").alias("j"), F.col("x").alias("_x")), [*by, "j"]).groupBy(*by, "i").agg(
        F.sum(F.col("v") * F.col("_x")).alias("gx")
    )
    both = unit.join(image, [*by, "i"])
    value = F.sum(F.col("x") * F.col("gx")).over(block)
    miss = F.sqrt(F.sum(F.pow(F.col("gx") - F.col("value") * F.col("x"), 2)).over(block)) / F.nullif(F.abs("value"), F.lit(0.0))
    checked = both.withColumn("value", value).withColumn("miss", miss)
    failed = F.raise_error(F.lit("the leading direction of a block was not reached")).cast("double")
    return checked.select(
        *by, F.col("i").alias("series_id"), F.when(F.col("miss") > TOLERANCE, failed).otherwise(F.col("x")).alias("loading")
    )


#: Directions that are iterated beside the ones asked for, degree of the polynomial of a round, rounds at most.
GUARD, DEGREE, ROUNDS = 3, 8, 30
#: The largest share of the largest value of a block that counts as 0.
SMALLEST = 1e-13
#: Sweeps of rotations over the small matrix of a block; eight leave nothing off its diagonal.
SWEEPS = 8


def diagonalised(matrix: Column, p: int) -> Column:
    """Rotations that make a symmetric p x p matrix (a flat array) diagonal: struct of ``m``, the matrix, and ``v``.

    Column k of ``v`` belongs to entry (k, k) of ``m``.  One array fold over the pairs of each sweep.
    """
    unit = F.array(*(F.lit(float(k // p == k % p)) for k in range(p * p)))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(p) for b in range(a + 1, p)]

    def turn(s: Column, pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        off = s["m"][a * p + b]
        theta = F.try_divide(s["m"][b * p + b] - s["m"][a * p + a], 2 * off)
        t = F.when(theta < 0, -1.0).otherwise(1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1))
        cos = F.coalesce(1 / F.sqrt(t * t + 1), F.lit(1.0))
        rotation = F.struct(s["m"].alias("m"), s["v"].alias("v"), cos.alias("c"), F.coalesce(t * cos, F.lit(0.0)).alias("s"))

        def columns(x: Column, r: Column) -> Column:
            def cell(value: Column, k: Column) -> Column:
                row, col = (k - k % p), k % p
                return (
                    F.when(col == a, r["c"] * value - r["s"] * x[row + b])
                    .when(col == b, r["s"] * x[row + a] + r["c"] * value)
                    .otherwise(value)
                )

            return F.transform(x, cell)

        def rows(x: Column, r: Column) -> Column:
            def cell(value: Column, k: Column) -> Column:
                row, col = F.floor(k / p).cast("int"), k % p
                return (
                    F.when(row == a, r["c"] * value - r["s"] * x[b * p + col])
                    .when(row == b, r["s"] * x[a * p + col] + r["c"] * value)
                    .otherwise(value)
                )

            return F.transform(x, cell)

        # One-element arrays name what is used many times, so that it is computed once.
        turned = F.transform(F.array(rotation), lambda r: F.struct(columns(r["m"], r).alias("m"), columns(r["v"], r).alias("v"), r["c"].alias("c"), r["s"].alias("s")))
        return F.transform(turned, lambda r: F.struct(rows(r["m"], r).alias("m"), r["v"].alias("v")))[0]

    if p == 1:
        return F.struct(matrix.alias("m"), unit.alias("v"))
    return F.aggregate(F.flatten(F.array_repeat(F.array(*pairs), SWEEPS)), F.struct(matrix.alias("m"), unit.alias("v")), turn)


def _names(letter: str, p: int) -> list[str]:
    return [f"{letter}{a}" for a in range(p)]


def _image(entries: DataFrame, state: DataFrame, p: int, by: list[str]) -> DataFrame:
    """Rows (by, i) with the directions x0, x1, ... and their images y0, y1, ...: one join, N^2 products a block."""
    given = state.select(*by, F.col("i").alias("j"), "x")
    own = F.col("i") == F.col("j")
    return entries.join(given, [*by, "j"]).groupBy(*by, "i").agg(
        *(F.sum(F.when(own, F.col("x")[a])).alias(f"x{a}") for a in range(p)),
        *(F.sum(F.col("v") * F.col("x")[a]).alias(f"y{a}") for a in range(p)),
    )


def _orthonormal(image: DataFrame, p: int, by: list[str]) -> DataFrame:
    """(by, i, x, was, value, miss): the images made orthonormal, by falling length.

    ``value`` and ``miss`` say how near the directions ``was`` were to eigenvectors.  A direction whose image has
    no length of its own becomes 0.
    """
    x, y = ([F.col(n) for n in _names(letter, p)] for letter in "xy")
    products = [F.sum(y[a] * y[b]).alias(f"s{a}_{b}") for a in range(p) for b in range(a, p)]
    small = image.groupBy(*by).agg(*products, *(F.sum(x[a] * y[a]).alias(f"h{a}") for a in range(p)), *(F.max(F.abs(x[a])).alias(f"m{a}") for a in range(p)))
    matrix = F.array(*(F.col(f"s{min(a, b)}_{max(a, b)}") for a in range(p) for b in range(p)))
    h = [F.when(F.col(f"m{a}") > 0, F.col(f"h{a}")) for a in range(p)]
    miss = [F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(f"s{a}_{a}") - h[a] * h[a], h[a] * h[a]))) for a in range(p)]
    solved = small.select(*by, F.array(*h).alias("value"), F.array(*miss).alias("miss"), diagonalised(matrix, p).alias("d"))
    places = F.sequence(F.lit(0), F.lit(p - 1))
    ordered = solved.withColumn("o", F.sort_array(F.transform(places, lambda k: F.struct(F.col("d.m")[k * p + k].alias("l"), k.alias("k"))), asc=False))
    scale = lambda o: F.when(o["l"] > SMALLEST * F.col("o")[0]["l"], 1 / F.sqrt(o["l"])).otherwise(0.0)
    weights = F.transform("o", lambda o: F.transform(places, lambda a: F.col("d.v")[a * p + o["k"]] * scale(o)))
    turned = F.transform("w", lambda w: sum((w[a] * y[a] for a in range(1, p)), w[0] * y[0]))
    return image.join(ordered.select(*by, "value", "miss", weights.alias("w")), by).select(
        *by, "i", turned.alias("x"), F.array(*x).alias("was"), "value", "miss"
    )


def _filtered(entries: DataFrame, state: DataFrame, r: int, p: int, by: list[str]) -> DataFrame:
    """The directions under a Chebyshev polynomial of the matrix, orthonormal again.

    It stays within 1 between the lowest value seen (0 at most) and the second of the values behind the ``r``
    largest, and grows fast above, so that the largest values win, not the largest in size.
    """
    known = F.sort_array(F.filter("value", lambda v: v.isNotNull()), asc=False)
    size = F.array_max(F.transform("value", lambda v: F.abs(v)))
    low = F.least(F.lit(0.0), 1.05 * F.array_min("value"))
    high = F.coalesce(F.get(known, F.lit(r + 1)), F.lit(0.0))
    half = F.greatest((high - low) / 2, 0.05 * size)
    own = "CASE WHEN i = j THEN"
    sums = [f"sum((v - {own} c ELSE 0 END) * x{a}) AS y{a}" for a in range(p)] + [f"sum({own} x{a} END) AS w{a}" for a in range(p)]
    sums += [f"sum({own} u{a} END) AS u{a}" for a in range(p)] + ["max(e) AS e", "max(c) AS c"]
    step = state.select(*by, "i", *(F.lit(0.0).alias(n) for n in _names("u", p)), *(F.col("x")[a].alias(f"x{a}") for a in range(p)), half.alias("e"), (low + half).alias("c"))
    for k in range(DEGREE):
        image = entries.join(step.withColumnRenamed("i", "j"), [*by, "j"]).groupBy(*by, "i").agg(*map(F.expr, sums))
        fresh = [f"coalesce(try_divide({2 if k else 1} * y{a}, e), 0) - u{a} AS x{a}" for a in range(p)]
        step = image.selectExpr(*by, "i", *(f"w{a} AS u{a}" for a in range(p)), *fresh, "e", "c")
    # Stored before the small matrices: their long expressions would be planned again behind every join.
    step = materialise(step.selectExpr(*by, "i", *_names("x", p), *(f"x{a} AS y{a}" for a in range(p))), "filtered")
    return _orthonormal(step, p, by).select(*by, "i", "x")


def leading_vectors(gram: DataFrame, r: int = 1, by: list[str] = PANEL) -> DataFrame:
    """(by, factor from 1, series_id, loading, value): the leading ``r`` eigenvectors of each block's covariance.

    Subspace iteration for all blocks together: r + GUARD directions start from hashes of the names; a round
    filters them by a polynomial of the matrix (``DEGREE`` joins of N^2 products each) and makes them orthonormal
    again through the small matrix of their products, one row a block, which also separates them.  A round is
    one query, whose result is stored, until the image of every vector misses a multiple of it by at most
    ``TOLERANCE``; after ``ROUNDS`` the rows fail.  A vector has a non-negative sum; where that is 0, its largest
    entry is positive, of equal ones the first by name.  Vectors of the value 0 are not
    determined and left out, so a block without variance has none; no block has more than series.
    """
    p = r + GUARD
    entries = materialise(square_matrix(gram, by), "gram")
    start = F.array(*(F.xxhash64("i", F.lit(a)) / float(1 << 63) for a in range(p)))
    state = _orthonormal(_image(entries, entries.select(*by, "i").distinct().withColumn("x", start), p, by), p, by)
    state = materialise(_orthonormal(_image(entries, state, p, by), p, by), "directions")
    for _ in range(ROUNDS):
        if state.where(~_settled(r)).isEmpty():
            break
        filtered = _filtered(entries, state, r, p, by)
        state = materialise(_orthonormal(_image(entries, filtered, p, by), p, by), "directions")
    return _named_vectors(state, r, by)


def _best(r: int) -> Column:
    """Value and place of the ``r`` largest, without directions that are 0."""
    placed = F.transform("value", lambda v, k: F.struct(v.alias("v"), (-k).alias("k")))
    return F.slice(F.sort_array(F.filter(placed, lambda s: s["v"].isNotNull()), asc=False), 1, r)


def _settled(r: int) -> Column:
    size = F.array_max(F.transform("value", lambda v: F.abs(v)))
    near = lambda s: (F.abs(s["v"]) <= SMALLEST * size) | (F.col("miss")[-s["k"]] <= TOLERANCE)
    return F.coalesce(F.forall(_best(r), near), F.lit(True))


def _named_vectors(state: DataFrame, r: int, by: list[str]) -> DataFrame:
    most = F.array_max(F.transform("value", lambda v: F.abs(v)))
    picked = state.select(*by, "i", "was", _settled(r).alias("ok"), most.alias("_most"), F.posexplode(_best(r)).alias("_f", "_b"))
    picked = picked.where(F.abs(F.col("_b.v")) > SMALLEST * F.col("_most"))
    x = F.col("was")[-F.col("_b.k")].alias("x")
    flat = picked.select(*by, (F.col("_f") + 1).alias("factor"), F.col("i").alias("series_id"), F.col("_b.v").alias("value"), "ok", x)
    vector = Window.partitionBy(*by, "factor")
    total = F.round(F.sum("x").over(vector), 9)
    largest = F.min(F.struct(-F.round(F.abs("x"), 9), "series_id", F.col("x").alias("x"))).over(vector)["x"]
    sign = F.when((total < 0) | ((total == 0) & (largest < 0)), -1.0).otherwise(1.0)
    unit = sign * F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(vector))
    failed = F.raise_error(F.lit("the leading directions of a block were not reached")).cast("double")
    return flat.select(*by, "factor", "series_id", F.when(F.col("ok"), unit).otherwise(failed).alias("loading"), "value")


def factor_scores(z: DataFrame, loadings: DataFrame, value: str = "z", by: list[str] = PANEL) -> DataFrame:
    """Factor by period: the block projected on the loadings."""
    return z.join(loadings, [*by, "series_id"]).groupBy(*by, "period").agg(
        F.sum(F.col(value) * F.col("loading")).alias("f")
    )


def first_factor(z: DataFrame, value: str = "z", by: list[str] = PANEL) -> tuple[DataFrame, DataFrame]:
    """Loadings and scores of the first principal component of every block."""
    loadings = leading_vector(panel_gram(z, value, by), by)
    return loadings, factor_scores(z, loadings, value, by)


# ---------------------------------------------------------------- regressions


def factor_lags(factor: DataFrame, by: list[str] = PANEL) -> DataFrame:
    """f_t .. f_{t-4}; one factor's calendar per group."""
    by_time = Window.partitionBy(*by).orderBy("period")
    return factor.withColumns({n: F.lag("f", k).over(by_time) for k, n in enumerate(LAG_NAMES)})


def tent_sum() -> Column:
    return sum((F.col(n) * w for n, w in zip(LAG_NAMES[1:], TENT[1:])), F.col(LAG_NAMES[0]) * TENT[0])


def restricted_loadings(
    quarterly: DataFrame, lags: DataFrame, value: str = "z", filled: str | None = None, by: list[str] = PANEL
) -> DataFrame:
    """Loadings of quarterly series on five lags, proportional to (1, 2, 3, 2, 1).

    The restriction leaves one free number, the slope on the tent sum of the
    lags.  With fewer than seven observations the ``filled`` column is used.
    """
    ready = lags.where(F.col(LAG_NAMES[-1]).isNotNull()).select(
        *by, "period", tent_sum().alias("tent")
    )
    tent = F.col("tent")

    def slope(c: str) -> Column:
        square = F.sum(F.when(F.col(c).isNotNull(), tent * tent))
        return F.try_divide(F.sum(F.col(c) * tent), square)

    thin = slope(filled) if filled else F.lit(None).cast("double")
    keys = [*by, "series_id"]
    fitted = quarterly.join(ready, [*by, "period"]).groupBy(*keys).agg(
        F.when(F.count(value) >= len(TENT) + 2, slope(value)).otherwise(thin).alias("b")
    )
    return fitted.select(*keys, "b", *[(F.col("b") * w).alias(f"c{k}") for k, w in enumerate(TENT)])


def ar1(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """x_t on x_{t-1} without intercept and the variance of the residual, in one aggregate."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("period"))
    both = df.withColumn("_x", F.col(value)).withColumn("_l", before).where(
        F.col("_x").isNotNull() & F.col("_l").isNotNull()
    )
    x, lagged = F.col("_x"), F.col("_l")
    sums = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x * lagged).alias("sxl"), F.sum(lagged * lagged).alias("sll"),
        F.var_samp(x).alias("vx"), F.var_samp(lagged).alias("vl"), F.covar_samp(x, lagged).alias("vxl"),
    )
    b = F.try_divide(F.col("sxl"), F.col("sll"))
    spread = F.col("vx") - 2 * F.col("b") * F.col("vxl") + F.col("b") * F.col("b") * F.col("vl")
    return sums.withColumn("b", b).select(*keys, "n", "b", spread.alias("residual_variance"))


def block_residuals(z: DataFrame, loadings: DataFrame, lags: DataFrame, value: str = "z", by: list[str] = PANEL) -> DataFrame:
    """Subtract the fitted part of a block; months without five lags stay as they are.

    ``loadings`` has one row per series with c0..c4.  Series outside the block
    pass through.
    """
    coefs, series = [f"c{k}" for k in range(len(TENT))], [*by, "series_id"]
    ready = lags.where(F.col(LAG_NAMES[-1]).isNotNull()).select(*by, "period", *LAG_NAMES)
    joined = z.join(loadings.select(*series, *coefs), series, "left").join(
        ready, [*by, "period"], "left"
    )
    fitted = sum(
        (F.col(c) * F.col(f) for c, f in zip(coefs[1:], LAG_NAMES[1:])), F.col("c0") * F.col("f0")
    )
    return joined.withColumn("residual", F.col(value) - F.coalesce(fitted, F.lit(0.0))).drop(
        *coefs, *LAG_NAMES
    )


BLOCK = [*PANEL, "block"]


def waves(spec: DataFrame, blocks: list[str]) -> list[list[str]]:
    """The blocks in order, those that follow each other without a common series together."""
    pairs = spec.select("model", "series_id", F.explode("blocks").alias("a")).join(
        spec.select("model", "series_id", F.explode("blocks").alias("b")), ["model", "series_id"]
    )
    # One row for each pair of blocks that meet.
    meet = {(r["a"], r["b"]) for r in pairs.select("a", "b").distinct().collect()}
    out: list[list[str]] = []
    for block in blocks:
        if out and not any((block, other) in meet for other in out[-1]):
            out[-1].append(block)
        else:
            out.append([block])
    return out


def block_chain(z: DataFrame, spec: DataFrame, blocks: list[str], value: str = "z") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(residuals, loadings, factors) of blocks taken one after the other, each on what those before it left.

    A block's factor is the first principal component of its monthly members' residuals; monthly members load on
    the month's factor, quarterly ones on five lags in the proportion of the tent.  The fitted part is then taken
    off all members, so a series of several blocks goes into each with what is left.  Blocks without a
    common series don't see each other and are solved together.  ``z`` has the series' frequency.
    """
    rest = z.withColumn("residual", F.col(value))
    loadings, factors = [], []
    for wave in waves(spec, blocks):
        members = materialise(in_blocks(rest, spec).where(F.col("block").isin(wave)), "members")
        monthly, quarterly = members.where("frequency = 'm'"), members.where("frequency = 'q'")
        vectors = materialise(leading_vector(panel_gram(monthly, "residual", BLOCK), BLOCK), "vectors")
        lags = materialise(factor_lags(factor_scores(monthly, vectors, "residual", BLOCK), BLOCK), "block-lags")
        tents = restricted_loadings(quarterly, lags, "residual", by=BLOCK).drop("b")
        flat = vectors.select(*BLOCK, "series_id", F.col("loading").alias("c0"), *(F.lit(0.0).alias(f"c{k}") for k in range(1, len(TENT))))
        loadings.append(flat.unionByName(tents))
        factors.append(lags)
        left = block_residuals(members.drop(value).withColumnRenamed("residual", "_left"), loadings[-1], lags, "_left", BLOCK)
        left = left.select(*SERIES, "period", F.col("residual").alias("_new"), F.lit(True).alias("_in"))
        both = rest.join(left, [*SERIES, "period"], "left")
        rest = materialise(both.withColumn("residual", F.when(F.col("_in"), F.col("_new")).otherwise(F.col("residual"))).drop("_new", "_in"), "residuals")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return rest, union(loadings), union(factors)


def em_converged(trace: DataFrame, threshold: float = 1e-4, keys: list[str] = ["model", "est_vintage"]) -> DataFrame:
    """Relative likelihood change per iteration; the rule holds from the fourth one on.  ``keys`` name a fit."""
    run = Window.partitionBy(*keys).orderBy("iteration")
    now, before = F.col("loglik"), F.lag("loglik").over(run)
    level = (F.abs(now) + F.abs(before)) / 2
    return trace.withColumn("change", F.try_divide(F.abs(now - before), level)).withColumns(
        {
            "converged": F.coalesce(
                (F.col("iteration") >= 4) & (F.col("change") < threshold), F.lit(False)
            ),
            "decreased": F.coalesce(now - before < FALL, F.lit(False)),
        }
    )


# ---------------------------------------------------------------- local level


def local_level(obs: DataFrame, level_var: float, noise_var: float, value: str = "value") -> DataFrame:
    """Scalar Kalman filter of every series as one JVM-side fold over its months.

    The level starts at zero with a large variance; missing months only add
    level variance.
    """
    series = obs.groupBy(*SERIES).agg(
        F.sort_array(F.collect_list(F.struct("period", F.col(value).alias("x")))).alias("xs")
    )
    start = F.struct(
        F.lit(0.0).alias("a"), F.lit(1e6).alias("p"), F.lit(0.0).alias("ll"), F.lit(0).alias("n")
    )

    def step(s: Column, row: Column) -> Column:
        p, x = s["p"] + level_var, row["x"]
        f, miss = p + noise_var, x - s["a"]
        hit = x.isNotNull()
        return F.struct(
            F.when(hit, s["a"] + p / f * miss).otherwise(s["a"]).alias("a"),
            F.when(hit, p * noise_var / f).otherwise(p).alias("p"),
            F.when(hit, s["ll"] - 0.5 * (F.log(f) + miss * miss / f)).otherwise(s["ll"]).alias("ll"),
            F.when(hit, s["n"] + 1).otherwise(s["n"]).alias("n"),
        )

    out = series.withColumn("s", F.aggregate("xs", start, step))
    return out.select(
        *SERIES, F.col("s.a").alias("level"), F.col("s.p").alias("variance"),
        F.col("s.ll").alias("loglik"), F.col("s.n").alias("observations"),
    )


# ---------------------------------------------------------------- parameter tables

# params: model, est_vintage, name, i, j, v.  Rows of C are spec positions (from 0), its
# columns states; block b occupies the states 5b .. 5b+4.


def _matrix(params: DataFrame, name: str) -> DataFrame:
    return params.where(F.col("name") == name)


def _named(spec: DataFrame) -> DataFrame:
    return spec.select("model", "series_id", "frequency", (F.col("spec_pos") - 1).alias("i"))


def loading_tables(params: DataFrame, spec: DataFrame, blocks: list[str]) -> tuple[DataFrame, DataFrame]:
    """Monthly loadings per block, and the five lag loadings of quarterly series on the first block."""
    width = len(TENT)
    keys = ["model", "est_vintage", "series_id"]
    rows = _matrix(params, "C").where(F.col("j") < width * len(blocks)).join(
        _named(spec), ["model", "i"]
    )
    monthly = rows.where((F.col("frequency") == "m") & (F.col("j") % width == 0)).groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("j") == width * b, F.col("v"))), F.lit(0.0)).alias(name)
            for b, name in enumerate(blocks)
        ]
    )
    quarterly = rows.where((F.col("frequency") == "q") & (F.col("j") < width)).groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("j") == k, F.col("v"))), F.lit(0.0)).alias(f"f1_lag{k}")
            for k in range(width)
        ]
    )
    return monthly, quarterly


def ar_tables(params: DataFrame, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """AR coefficient and residual variance of every factor and every idiosyncratic term."""
    diagonal = params.where((F.col("i") == F.col("j")) & F.col("name").isin("A", "Q"))
    table = diagonal.groupBy("model", "est_vintage", F.col("i").alias("state")).agg(
        F.coalesce(F.sum(F.when(F.col("name") == "A", F.col("v"))), F.lit(0.0)).alias("ar"),
        F.sum(F.when(F.col("name") == "Q", F.col("v"))).alias("residual_variance"),
    ).where(F.col("residual_variance").isNotNull())
    first_idio = len(TENT) * n_blocks
    return table.where(F.col("state") < first_idio), table.where(F.col("state") >= first_idio)


def common_component(params: DataFrame, states: DataFrame, spec: DataFrame, n_factor_states: int) -> DataFrame:
    """C_i f_t in units, by series and month: a join on the state index and a sum.

    ``states`` has model, est_vintage, period, j, state.
    """
    names = _named(spec).select("model", "i", "series_id")
    loadings = _matrix(params, "C").where(F.col("j") < n_factor_states).select(
        "model", "est_vintage", "i", "j", "v"
    )
    keys = ["model", "est_vintage"]
    scale = (
        params.where(F.col("name").isin("Mx", "Wx"))
        .groupBy(*keys, "i")
        .agg(
            F.sum(F.when(F.col("name") == "Mx", F.col("v"))).alias("mx"),
            F.sum(F.when(F.col("name") == "Wx", F.col("v"))).alias("wx"),
        )
    )
    common = loadings.join(states, [*keys, "j"]).groupBy(*keys, "i", "period").agg(
        F.sum(F.col("v") * F.col("state")).alias("common_z")
    )
    return common.join(scale, [*keys, "i"]).join(names, ["model", "i"]).select(
        *keys, "series_id", "period", "common_z",
        (F.col("wx") * F.col("common_z") + F.col("mx")).alias("common"),
    )


def common_and_residual(common: DataFrame, obs: DataFrame) -> DataFrame:
    """Observed value split into common and own part with their shares."""
    keys = ["model", "est_vintage", "series_id", "period"]
    both = common.join(obs.select(*keys, F.col("value").alias("total")), keys)
    rest = F.col("total") - F.col("common")
    return both.select(
        *keys, "total", "common", rest.alias("residual"),
        F.try_divide("common", "total").alias("share_common"),
        F.try_divide(rest, F.col("total")).alias("share_residual"),
    )


def component_share(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weight per component and its share of the total, 0 when the total is 0."""
    sums = weights.groupBy(*keys, "category").agg(F.sum("weight").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(*keys))
    return sums.withColumn("share_common", F.coalesce(F.try_divide(F.col("weight"), total), F.lit(0.0)))


def component_contributions(
    params: DataFrame, spec: DataFrame, target: str, mapping: DataFrame, summary: DataFrame,
    n_factor_states: int,
) -> DataFrame:
    """Target's common part split over components by the similarity of loadings.

    The weight of a series is the inner product of its loadings with the
    target's; the target itself is left out.  ``summary`` has the target's
    total, common and residual for each (model, est_vintage), by period or not.
    """
    keys = ["model", "est_vintage"]
    named = _matrix(params, "C").where(F.col("j") < n_factor_states).join(
        _named(spec).select("model", "i", "series_id"), ["model", "i"]
    )
    own = named.where(F.col("series_id") == target).select(*keys, "j", F.col("v").alias("target_v"))
    others = named.where(F.col("series_id") != target)
    weights = others.join(own, [*keys, "j"]).groupBy(*keys, "series_id").agg(
        F.sum(F.col("v") * F.col("target_v")).alias("weight")
    )
    shares = component_share(with_category(weights, mapping), keys)
    return cross_summary(summary, shares, keys).withColumn(
        "contribution", F.col("share_common") * F.col("common")
    )


def cross_summary(summary: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """One summary row per key beside each of the key's parts."""
    return summary.join(parts, keys)
