"""Sequence operators over series(series_id, t, v, flag) with dense 1-based positions t.

Bounded look-around runs on chunks with copied borders, running totals on chunk totals, so one
long series spreads over many tasks (see `scale`).
"""
from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import bin_index, col, dbl, entropy_bits, ratio, trunc
from .marginal import with_stats
from .scale import CHUNK, materialize, names, running, value_bucket, value_cuts, with_local

S = "series_id"


def running_count(series: DataFrame, key: str = S, flag: str = "flag", size: int = CHUNK) -> DataFrame:
    """Events so far and the inverse signal 1 / max(count, 1)."""
    d = running(series, key, "t", {"count": (flag, "sum")}, size)
    return d.withColumn("inverse", 1.0 / F.greatest(F.col("count"), F.lit(1)))


def increments(series: DataFrame, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """v(t) - v(t-1) from the second position on."""
    d = with_local(series, key, "t", {"_p": lambda w: F.lag(v).over(w)}, before=1, size=size)
    return d.filter("_p is not null").withColumn("inc", col(v) - F.col("_p")).drop("_p")


def residual(series: DataFrame, smooth: DataFrame, key: str = S, v: str = "v") -> DataFrame:
    """Difference to another series at equal positions."""
    return series.join(smooth.select(key, "t", col(v).alias("_s")), [key, "t"]).withColumn(
        "residual", col(v) - F.col("_s")).drop("_s")


def moving_average_clamped(series: DataFrame, window: int, key: str = S, v: str = "v",
                           size: int = CHUNK, out: str = "ma") -> DataFrame:
    """Centred mean over `window` positions, the first and last value standing in beyond the ends."""
    h = window // 2
    ends = series.groupBy(key).agg(F.min_by(v, "t").alias("_first"), F.max_by(v, "t").alias("_last"),
                                   F.max("t").alias("_n"))
    d = with_local(series, key, "t", {"_s": lambda w: F.sum(v).over(w.rangeBetween(-h, h))},
                   before=h, after=h, size=size).join(ends, key)
    low = F.greatest(F.lit(0), h + 1 - F.col("t"))
    high = F.greatest(F.lit(0), F.col("t") + h - F.col("_n"))
    return d.withColumn(out, (F.col("_s") + low * F.col("_first") + high * F.col("_last")) / (2 * h + 1)).drop(
        "_s", "_first", "_last", "_n")


def detrend_available(series: DataFrame, radius: int = 10, key: str = S, v: str = "v",
                      size: int = CHUNK, out: str = "detrended") -> DataFrame:
    """Minus the mean of the samples present within +-radius of t; gaps stay gaps."""
    d = with_local(series, key, "t", {"_m": lambda w: F.avg(v).over(w.rangeBetween(-radius, radius))},
                   before=radius, after=radius, size=size)
    return d.withColumn(out, col(v) - F.col("_m")).drop("_m")


def _reference(series, key, v, ref):
    x = F.when(F.col("t") <= ref, col(v))
    return with_stats(series, key, _m=F.avg(x), _var=F.var_pop(x), _ms=F.avg(x * x))


def standardize(series: DataFrame, key: str = S, v: str = "v", ref: int = 200, target_rms: float = 1.0) -> DataFrame:
    """Against the first `ref` positions: standardised, centred, and rescaled to `target_rms`.
    Zero variance gives zeros."""
    d = _reference(series, key, v, ref)
    sd, rms = F.sqrt("_var"), F.sqrt("_ms")
    return d.select(
        *series.columns,
        F.when(F.col("_var") < 1e-15, 0.0).otherwise((col(v) - F.col("_m")) / F.nullif(sd, F.lit(0.0))).alias("standard"),
        (col(v) - F.col("_m")).alias("centred"),
        F.when(rms < 1e-15, 0.0).otherwise(col(v) * (target_rms / F.nullif(rms, F.lit(0.0)))).alias("scaled"))


def zscore_full(series: DataFrame, key: str = S, v: str = "v", target_rms: float = 1.0) -> DataFrame:
    """Whole-series z-score and the centred values rescaled to `target_rms`."""
    d = with_stats(series, key, _m=F.avg(v), _sd=F.stddev_pop(v))
    z = F.when(F.col("_sd") < 1e-15, 0.0).otherwise((col(v) - F.col("_m")) / F.nullif(F.col("_sd"), F.lit(0.0)))
    return d.select(*series.columns, z.alias("z"), (z * target_rms).alias("rms_matched"))


def match_moments(series: DataFrame, target: DataFrame, key: str = S, v: str = "v", ref: int = 200) -> DataFrame:
    """Rescale to the reference mean and deviation of another series."""
    first = target.filter(F.col("t") <= ref).groupBy(key).agg(F.avg(v).alias("_tm"), F.stddev_pop(v).alias("_ts"))
    d = _reference(series, key, v, ref).join(first, key)
    sd = F.sqrt("_var")
    z = (col(v) - F.col("_m")) / F.nullif(sd, F.lit(0.0))
    return d.select(*series.columns, F.when(sd < 1e-15, 0.0).otherwise(F.col("_tm") + F.col("_ts") * z).alias("matched"))


def autocorr(series: DataFrame, lags=(1, 2, 3, 4, 8), key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """(key, lag, acf) with the global mean and the full-length variance; 0 for a flat series."""
    lags = list(lags)
    d = with_stats(series.select(key, "t", v), key, _m=F.avg(v), _ss=F.var_pop(v) * F.count(v))
    d = d.withColumn("_c", col(v) - F.col("_m"))
    d = with_local(d, key, "t", {f"_l{k}": (lambda w, k=k: F.lead("_c", k).over(w)) for k in lags},
                   after=max(lags), size=size)
    a = d.groupBy(key).agg(F.max("_ss").alias("_ss"), *[
        F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_c{k}") for k in lags])
    arms = F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"),
                              F.when(F.col("_ss") < 1e-18, 0.0).otherwise(ratio(f"_c{k}", "_ss", 0.0)).alias("acf"))
                     for k in lags])
    return a.select(key, F.explode(arms).alias("_a")).select(key, "_a.lag", "_a.acf")


def permutation_entropy(series: DataFrame, order: int = 3, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """Normalised entropy of ordinal patterns over order+1 points, ties by position.

    The pattern is the permutation that sorts the points, read off pairwise comparisons.
    """
    m = order + 1
    d = with_local(series.select(key, "t", v), key, "t",
                   {f"_x{i}": (lambda w, i=i: F.lead(v, i).over(w)) for i in range(1, m)}, after=order, size=size)
    x = [col(v)] + [F.col(f"_x{i}") for i in range(1, m)]
    d = d.filter(x[-1].isNotNull())
    # one bit per pair i < j (later point strictly smaller) identifies the permutation
    code = None
    bit = 1
    for i in range(m):
        for j in range(i + 1, m):
            term = F.when(x[j] < x[i], bit).otherwise(0)
            code = term if code is None else code + term
            bit *= 2
    n = d.groupBy(key, code.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    e = n.groupBy(key).agg((entropy_bits(F.col("_n")) / math.log2(math.factorial(m))).alias("perm_entropy"))
    return series.select(key).distinct().join(e, key, "left").fillna(0.0)


def binned(series: DataFrame, bins: int, key: str = S, v: str = "v", out: str = "bin") -> DataFrame:
    d = with_stats(series.select(key, "t", v), key, _lo=F.min(v), _hi=F.max(v))
    return d.select(key, "t", v, bin_index(v, "_lo", "_hi", bins).alias(out))


def transition_entropy(series: DataFrame, bins: int = 8, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """Entropy of consecutive bin pairs over log2 of their number."""
    d = with_local(binned(series, bins, key, v), key, "t", {"_nx": lambda w: F.lead("bin").over(w)}, after=1, size=size)
    n = d.filter("_nx is not null").groupBy(key, "bin", "_nx").agg(F.count(F.lit(1)).alias("_n"))
    tot = F.sum("_n").cast("double")
    e = n.groupBy(key).agg(F.when(tot > 1, entropy_bits(F.col("_n")) / F.nullif(F.log2(tot), F.lit(0.0)))
                           .otherwise(0.0).alias("transition_entropy"))
    return series.select(key).distinct().join(e, key, "left").fillna(0.0)


def ordered_mean(series: DataFrame, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """(key, _m): the mean, its values added in the order of positions within a chunk, and chunks in their order."""
    upto = W.partitionBy(key, "_chunk").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = series.select(key, "t", F.floor(F.col("t").cast("bigint") / size).alias("_chunk"), v)
    d = d.withColumn("_s", F.sum(v).over(upto)).groupBy(key, "_chunk").agg(F.max_by("_s", "t").alias("_s"), F.count(v).alias("_n"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") > 0, F.struct("_chunk", "_s")))), lambda c: c["_s"])
    return d.groupBy(key).agg((F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.sum("_n").cast("double"), F.lit(0.0))).alias("_m"))


def cycle_period(series: DataFrame, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """Mean gap between upward crossings of the mean; the length when there are fewer than two.

    The gaps telescope, so only the first and last crossing and their number are needed.  A value can be equal to the mean, so
    the mean must not depend on how the rows lie in tasks.
    """
    d = series.select(key, "t", v).join(ordered_mean(series, key, v, size), key)
    d = with_local(d, key, "t", {"_p": lambda w: F.lag(v).over(w)}, before=1, size=size)
    at = F.when((F.col("_p") < F.col("_m")) & (F.col("_m") <= col(v)), F.col("t"))
    a = d.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count(at).alias("_c"), F.min(at).alias("_a"), F.max(at).alias("_b"))
    return a.select(key, F.when(F.col("_c") < 2, dbl("_n")).otherwise(
        (F.col("_b") - F.col("_a")) / F.nullif((F.col("_c") - 1).cast("double"), F.lit(0.0))).alias("period"))


def islands(df: DataFrame, keys, pos: str, value: str, size: int = CHUNK) -> DataFrame:
    """Runs of equal consecutive values: (keys, value, start, length).

    A run start is a local comparison; its number is a running count over chunk totals; the run
    itself is then one aggregate group that combines on the map side.
    """
    keys = names(keys)
    d = with_local(df, keys, pos, {"_p": lambda w: F.lag(value).over(w)}, before=1, size=size)
    d = d.withColumn("_new", F.when(F.col("_p").eqNullSafe(F.col(value)), 0).otherwise(1))
    d = running(d, keys, pos, {"_run": ("_new", "sum")}, size)
    return d.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(pos).alias("start"),
                                        F.count(F.lit(1)).alias("length")).drop("_run")


def sign_run_entropy(series: DataFrame, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """-sum (c/T) log2 (c/T) over run lengths of the increment sign, c = runs of that length and
    T = all steps.  (T is not the number of runs, so this is a score, not an entropy.)"""
    sg = increments(series.select(key, "t", v), key, v, size).select(
        key, (F.col("t") - 1).alias("t"), F.when(F.col("inc") >= 0, 1).otherwise(0).alias("sg"))
    runs = islands(sg, key, "t", "sg", size)
    c = runs.groupBy(key, "length").agg(F.count(F.lit(1)).cast("double").alias("c"))
    c = c.withColumn("steps", F.col("c") * F.col("length"))
    e = c.groupBy(key).agg(((F.ln(F.sum("steps")) * F.sum("c") - F.sum(F.col("c") * F.ln("c")))
                            / F.sum("steps") / math.log(2.0)).alias("sign_run_entropy"))
    return series.select(key).distinct().join(e, key, "left").fillna(0.0)


def run_length_stats(df: DataFrame, keys, pos: str, value: str, size: int = CHUNK) -> DataFrame:
    """Run lengths of a quantised value: mean, deviation, number of runs, and runs per element
    (times 2 for the 16-bit-over-8-bit coding ratio)."""
    r = islands(df, keys, pos, value, size)
    return r.groupBy(*names(keys)).agg(
        F.avg("length").alias("run_mean"), F.stddev_pop("length").alias("run_std"),
        F.count(F.lit(1)).alias("runs"), (F.count(F.lit(1)) / F.sum("length")).alias("runs_per_element"),
        (2.0 * F.count(F.lit(1)) / F.sum("length")).alias("rle_ratio"))


def byte_level(v) -> Column:
    return trunc(col(v) * 256.0).bitwiseAND(255)


def step_stats(series: DataFrame, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """Drift |last - first|, mean |step|, frozen flag, and skewness / excess kurtosis of the steps."""
    inc = increments(series.select(key, "t", v), key, v, size)
    flat = F.stddev_pop("inc") < 1e-18
    st = inc.groupBy(key).agg(
        F.avg(F.abs("inc")).alias("mean_abs_step"),
        F.when((F.count("inc") < 3) | flat, 0.0).otherwise(F.skewness("inc")).alias("inc_skew"),
        F.when((F.count("inc") < 4) | flat, 0.0).otherwise(F.kurtosis("inc")).alias("inc_kurt"))
    base = series.groupBy(key).agg(
        F.abs(F.max_by(v, "t") - F.min_by(v, "t")).alias("drift"),
        F.when(F.max(v) - F.min(v) < 1e-12, 1.0).otherwise(0.0).alias("frozen"))
    return base.join(st, key, "left").fillna(0.0)


def var_of_var(frames: DataFrame, key: str = S) -> DataFrame:
    """Sample variance, over cells, of each cell's sample variance over time."""
    v = F.when(F.count("v") < 2, 0.0).otherwise(F.var_samp("v"))
    c = frames.groupBy(key, "idx").agg(v.alias("cv"), F.when(F.max("v") - F.min("v") < 1e-12, 1.0).otherwise(0.0).alias("fz"))
    return c.groupBy(key).agg(F.when(F.count("cv") < 2, 0.0).otherwise(F.var_samp("cv")).alias("var_of_var"),
                              F.avg("fz").alias("frozen_fraction"))


def mean_series(frames: DataFrame, key: str = S) -> DataFrame:
    return frames.groupBy(key, "t").agg(F.avg("v").alias("v"))


def cell_indices(total: int, n: int) -> list[int]:
    return [int((k + 0.5) * total / n) for k in range(n)]


def cell_series(frames: DataFrame, total: int, n: int) -> DataFrame:
    """n evenly spaced cells: a literal IN list, pushed to the scan."""
    return frames.filter(F.col("idx").isin(cell_indices(total, n)))


def recurrence_density(series: DataFrame, frac: float = 0.1, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """Share of pairs at least two steps apart that lie closer than frac * sd; 1 for a flat series."""
    d = with_stats(series.select(key, "t", v), key, _sd=F.stddev_pop(v), _n=F.count(v))
    d = d.withColumn("_tol", frac * F.col("_sd"))
    close = count_close_pairs(d.filter("_sd >= 1e-18"), key, v, "_tol", size)
    base = d.groupBy(key).agg(F.max("_n").alias("n"), F.max("_sd").alias("sd"))
    total = (F.col("n") - 1) * (F.col("n") - 2) / 2.0
    return base.join(close, key, "left").select(
        key, F.when(F.col("n") < 3, 0.0).when(F.col("sd") < 1e-18, 1.0).otherwise(
            ratio(F.coalesce("pairs", F.lit(0)), total, 0.0)).alias("density"))


def count_close_pairs(df: DataFrame, key: str, v: str, tol: str, size: int = CHUNK, cells: int = 64) -> DataFrame:
    """(key, pairs): pairs with |v_i - v_j| < tol and positions at least two apart, none emitted.

    With G(x) = number of values below x, a value v has G(v + tol) - G(v) - own partners above it.
    Both ranks come from one pass over value buckets (values and probes v + tol side by side);
    adjacent positions are counted separately and taken off.
    """
    vc = df.groupBy(key, v).agg(F.count(F.lit(1)).alias("_n"), F.max(tol).alias("_tol"))
    cuts = value_cuts(vc, key, v, cells)
    n = F.col("_n")
    both = F.explode(F.array(
        F.struct(col(v).alias("x"), F.lit(1).alias("kind"), n.alias("w"), (-n).alias("sign")),
        F.struct((col(v) + F.col("_tol")).alias("x"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("w"), n.alias("sign"))))
    d = vc.select(key, both.alias("_e")).select(key, "_e.*").join(cuts, key)
    d = d.withColumn("_b", value_bucket("x")).drop("_cuts")
    tot = d.groupBy(key, "_b").agg(F.sum("w").alias("_t"))
    earlier = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = tot.select(key, "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))
    local = W.partitionBy(key, "_b").orderBy("x", "kind").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("w").over(local), F.lit(0))).join(base, [key, "_b"])
    below = F.col("_off") + F.col("_in")
    w = F.col("w")
    ranked = d.groupBy(key).agg(F.sum(F.col("sign") * below).alias("_a"),
                                F.sum(-w * w + (w * (w - 1) / 2).cast("bigint")).alias("_c"))
    near = increments(df, key, v, size).groupBy(key).agg(
        F.count(F.when(F.abs("inc") < F.col(tol), 1)).alias("_adj"))
    return ranked.join(near, key, "left").select(
        key, (F.col("_a") + F.col("_c") - F.coalesce("_adj", F.lit(0))).alias("pairs"))


def embed(series: DataFrame, dim: int = 3, delay: int = 2, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """Delay vectors x0..x(dim-1) starting at t."""
    d = with_local(series.select(key, "t", col(v).alias("x0")), key, "t",
                   {f"x{i}": (lambda w, i=i: F.lead("x0", i * delay).over(w)) for i in range(1, dim)},
                   after=(dim - 1) * delay, size=size)
    return d.filter(F.col(f"x{dim - 1}").isNotNull())


def count_close_points(points: DataFrame, key: str, radii: dict, dim: int = 3, spare: int = 16, deepest: int = 40) -> DataFrame:
    """(key, <name> per radius): unordered pairs of points closer than each radius column, the last of which is the largest.

    Distinct points with counts fall into cells as wide as the largest radius; a cell meets itself and half of its
    neighbours.  Two cells whose boxes lie wholly within or wholly beyond a radius are settled by the product of
    their counts; the others are halved along each axis and their parts meet again.  Points meet points only once at most
    `spare` pairs for each distinct point are left in such cells (or after `deepest` halvings), so the work does not grow
    with the number of pairs.  Where the first cells hold so few points that all pairs of neighbours are at most four times as many, they meet at once; slabs along
    as few axes as allow this are taken for cells, as a point is sent to 2, 5 or 14 neighbours of 1, 2 or 3 axes.  Box distances are evaluated like point distances, so rounding keeps their order and
    counts are exact.  Points with a null or non-finite coordinate are close to none.
    """
    xs, rs = [f"x{i}" for i in range(dim)], list(dict.fromkeys(radii.values()))
    rmax = list(radii.values())[-1]
    usable = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(x)) < float("inf"), F.lit(False)) for x in xs])
    p = materialize(points.filter(usable).groupBy(key, *xs, *rs).agg(F.count(F.lit(1)).alias("n")))
    def cell(level, axes=dim):
        # a little wider than the radius: a quotient that is rounded over a cell border loses no pair
        return F.struct(*[F.floor(F.col(x) / (F.col(rmax) * (1 + 1e-9)) * 2.0 ** level).alias(x) for x in xs[:axes]])

    def cells(level, side):
        """Cells of a level with the cell above, counts and box, as columns of one side of a pair."""
        d = p.groupBy(key, *rs, cell(level).alias(side), cell(max(level - 1, 0)).alias(f"up_{side}")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), *[F.min(x).alias(f"lo_{x}") for x in xs], *[F.max(x).alias(f"hi_{x}") for x in xs])
        box = F.struct("n", "m", *[f"{e}_{x}" for e in ("lo", "hi") for x in xs]).alias(f"box_{side}")
        return d.select(key, *(rs if side == "a" else []), side, f"up_{side}", box)

    def length(parts):
        return F.sqrt(reduce(lambda a, b: a + b, [t * t for t in parts]))

    def judged(pairs):
        """Adds, for each radius still open, whether all pairs of the two cells are closer (`in`) or some may be (`open`)."""
        lo, hi = (lambda side, x: F.col(f"box_{side}.lo_{x}")), (lambda side, x: F.col(f"box_{side}.hi_{x}"))
        near = length([F.greatest(F.lit(0.0), lo("a", x) - hi("b", x), lo("b", x) - hi("a", x)) for x in xs])
        far = length([F.greatest(hi("a", x) - lo("b", x), hi("b", x) - lo("a", x)) for x in xs])
        d = pairs.withColumns({"_near": near, "_far": far})
        return d.withColumns({f"in_{n}": F.col(f"open_{n}") & (F.col("_far") < F.col(r)) for n, r in radii.items()}).withColumns(
            {f"open_{n}": F.col(f"open_{n}") & (F.col("_near") < F.col(r)) & ~(F.col("_far") < F.col(r)) for n, r in radii.items()}).drop("_near", "_far")

    opens = [f"open_{n}" for n in radii]
    undecided = reduce(lambda a, b: a | b, [F.col(o) for o in opens])

    def half(axes=dim):
        return [o for o in itertools.product((-1, 0, 1), repeat=axes) if o >= (0,) * axes]

    def met(c, axes=dim):
        return F.explode(F.array(*[F.struct(*[(F.col(f"{c}.{x}") + k).alias(x) for x, k in zip(xs, o)]) for o in half(axes)]))

    def members(level, up, point, count, axes=dim):
        return p.select(key, *(rs if up == "up_a" else []), cell(level, axes).alias(up), F.struct(*xs).alias(point), F.col("n").alias(count))

    def counted(met_points):
        """Pairs of points of two cells, by radius still open."""
        j = met_points.filter((F.col("up_a") != F.col("up_b")) | (F.col("p") <= F.col("q")))
        d = length([F.col(f"p.{x}") - F.col(f"q.{x}") for x in xs])
        both = F.when(F.col("p") == F.col("q"), F.shiftright(F.col("np") * (F.col("np") - 1), 1)).otherwise(F.col("np") * F.col("nq"))
        return j.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col(f"open_{n}") & (d < F.col(r)), both)), F.lit(0)).alias(n) for n, r in radii.items()])

    for axes in range(1, dim + 1):
        crowd = p.groupBy(key, cell(0, axes).alias("a")).agg(F.count(F.lit(1)).alias("m")).agg(
            F.coalesce(F.sum("m"), F.lit(0)).alias("points"), F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0)).alias("squares")).first()
        distinct = crowd["points"]
        if len(half(axes)) * crowd["squares"] <= 4 * spare * distinct:
            return counted(members(0, "up_a", "p", "np", axes).withColumn("up_b", met("up_a", axes)).join(members(0, "up_b", "q", "nq", axes), [key, "up_b"]).withColumns(
                {o: F.lit(True) for o in opens}))
    pairs = cells(0, "a").withColumn("b", met("a")).join(cells(0, "b"), [key, "b"]).withColumns({o: F.lit(True) for o in opens})
    settled, level = [], 0
    while True:
        pairs = materialize(judged(pairs.drop("up_a", "up_b")).filter(reduce(lambda a, b: a | b, [F.col(f"{k}_{n}") for n in radii for k in ("in", "open")])))
        na, nb = F.col("box_a.n"), F.col("box_b.n")
        both = F.when(F.col("a") == F.col("b"), F.shiftright(na * (na - 1), 1)).otherwise(na * nb)
        settled.append(pairs.groupBy(key).agg(*[F.sum(F.when(F.col(f"in_{n}"), both)).alias(n) for n in radii]))
        left = pairs.filter(undecided)
        candidates = left.agg(F.coalesce(F.sum(F.col("box_a.m") * F.col("box_b.m")), F.lit(0))).first()[0]
        left = left.select(key, F.col("a").alias("up_a"), F.col("b").alias("up_b"), *opens)
        if candidates <= spare * distinct or level == deepest:
            break
        level += 1
        pairs = left.join(cells(level, "a"), [key, "up_a"]).join(cells(level, "b"), [key, "up_b"]).filter(
            (F.col("up_a") != F.col("up_b")) | (F.col("a") <= F.col("b")))
    if candidates:
        settled.append(counted(left.join(members(level, "up_a", "p", "np"), [key, "up_a"]).join(members(level, "up_b", "q", "nq"), [key, "up_b"])))
    return reduce(DataFrame.unionByName, settled).groupBy(key).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in radii])


def corr_dimension(series: DataFrame, dim: int = 3, delay: int = 2, key: str = S, v: str = "v",
                   small: float = 0.1, large: float = 0.4, size: int = CHUNK) -> DataFrame:
    """Log-log slope of the correlation sum between two radii (in sample deviations); 0 when undefined."""
    d = with_stats(series.select(key, "t", v), key, _sd=F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    pts = embed(d, dim, delay, key, v, size).join(d.groupBy(key).agg(F.max(sd).alias("_s")), key)
    pts = pts.withColumns({"_r1": small * F.col("_s"), "_r2": large * F.col("_s")})
    c = count_close_points(pts, key, {"n1": "_r1", "n2": "_r2"}, dim)
    m = pts.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    a, b = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    slope = F.when((F.col("m") < 10) | (a <= 0) | (a >= b), 0.0).otherwise(
        F.ln(b / F.nullif(a.cast("double"), F.lit(0.0))) / math.log(large / small))
    return series.select(key).distinct().join(m, key, "left").join(c, key, "left").select(
        key, F.coalesce(slope, F.lit(0.0)).alias("corr_dim"), a.alias("close_small"), b.alias("close_large"))


def log_growth(series: DataFrame, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """Mean log ratio of successive |increments|; the sum telescopes to its two ends."""
    inc = increments(series.select(key, "t", v), key, v, size)
    e = lambda c: F.ln(F.abs(c) + 1e-15)
    a = inc.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min_by("inc", "t").alias("_a"), F.max_by("inc", "t").alias("_b"))
    out = a.select(key, F.when(F.col("_n") < 2, 0.0).otherwise(
        (e(F.col("_b")) - e(F.col("_a"))) / F.nullif((F.col("_n") - 1).cast("double"), F.lit(0.0))).alias("log_growth"))
    return series.select(key).distinct().join(out, key, "left").fillna(0.0)


def return_time_std(series: DataFrame, bins: int = 4, key: str = S, v: str = "v", size: int = CHUNK) -> DataFrame:
    """Sample deviation of the gaps between visits to the same state, 0 with fewer than three gaps.

    The last visit per state is a running maximum per state, so a long series is never one group.
    """
    d = running(binned(series, bins, key, v), key, "t",
                {f"_l{s}": (F.when(F.col("bin") == s, F.col("t")), "max") for s in range(bins)}, size, exclusive=True)
    last = F.coalesce(*[F.when(F.col("bin") == s, F.col(f"_l{s}")) for s in range(bins)])
    gap = F.col("t") - last
    return d.groupBy(key).agg(F.when(F.count(gap) > 2, F.stddev_samp(gap)).otherwise(0.0).alias("return_time_std"))


def frame_divergence(frame_grids: DataFrame, cells: int, key: str = S, size: int = CHUNK, stride: int = 1) -> DataFrame:
    """Mean and variance over time of the mean |frame change| on every `stride`-th cell (all by default), and the
    share of cells left unchanged by the last step.  One row per frame, the previous frame by a lag."""
    d = with_local(frame_grids.select(key, "t", "vals"), key, "t", {"_p": lambda w: F.lag("vals").over(w)}, before=1, size=size)
    idx = F.sequence(F.lit(0), F.lit(cells - 1), F.lit(stride))
    total = F.aggregate(idx, F.lit(0.0), lambda a, i: a + F.abs(F.get("vals", i) - F.get("_p", i)))
    same = F.size(F.filter(F.zip_with("vals", "_p", lambda a, b: a == b), lambda s: s)) / F.size("vals")
    d = d.filter("_p is not null").select(key, "t", (total / F.size(idx)).alias("dv"), same.alias("same"))
    return d.groupBy(key).agg(F.avg("dv").alias("divergence"),
                              F.when(F.count("dv") > 2, F.var_samp("dv")).otherwise(0.0).alias("divergence_var"),
                              F.max_by("same", "t").alias("unchanged_fraction"))


def circular_shift(series: DataFrame, shift, key: str = S) -> DataFrame:
    """out(t) = in(((t - 1 - shift) mod n) + 1): positions are relabelled, nothing is joined by value."""
    n = series.groupBy(key).agg(F.max("t").alias("_n"))
    s = shift if isinstance(shift, Column) else F.lit(shift)
    return series.join(n, key).withColumn("t", (F.pmod(F.col("t") - 1 + s, F.col("_n")) + 1).cast("bigint")).drop("_n")


def reverse(series: DataFrame, key: str = S) -> DataFrame:
    n = series.groupBy(key).agg(F.max("t").alias("_n"))
    return series.join(n, key).withColumn("t", F.col("_n") + 1 - F.col("t")).drop("_n")


def event_positions_gaps(series: DataFrame, key: str = S, v: str = "v", eps: float = 1e-18, size: int = CHUNK) -> DataFrame:
    """(key, k, pos, amp, gap): non-zero positions in order with the circular gap to the next one.

    Events get dense numbers from a running count, after which 'next event' is one step away.
    """
    live = F.when(F.abs(col(v)) > eps, 1).otherwise(0)
    d = running(series.select(key, "t", col(v).alias("amp")).withColumn("_e", live if v == "amp" else F.when(
        F.abs("amp") > eps, 1).otherwise(0)), key, "t", {"k": ("_e", "sum")}, size)
    e = d.filter("_e = 1").select(key, "k", F.col("t").alias("pos"), "amp")
    ends = d.groupBy(key).agg(F.max("t").alias("_n"), F.min(F.when(F.col("_e") == 1, F.col("t"))).alias("_first"))
    e = with_local(e, key, "k", {"_nx": lambda w: F.lead("pos").over(w)}, after=1, size=size).join(ends, key)
    return e.select(key, "k", "pos", "amp",
                    F.coalesce(F.col("_nx") - F.col("pos"), F.col("_n") - F.col("pos") + F.col("_first")).alias("gap"))


def monotone_profile(profile: DataFrame, key: str, pos: str = "t", v: str = "v", tol: float = 1e-12, size: int = CHUNK) -> DataFrame:
    """Is the profile non-decreasing within tol, and its end-to-end change."""
    d = with_local(profile.select(key, pos, v), key, pos, {"_p": lambda w: F.lag(v).over(w)}, before=1, size=size)
    return d.groupBy(key).agg(
        F.bool_and(F.coalesce(col(v) >= F.col("_p") - tol, F.lit(True))).alias("monotone"),
        (F.max_by(v, pos) - F.min_by(v, pos)).alias("gradient"))


def running_best(log: DataFrame, key: str, pos: str = "t", score: str = "score", size: int = CHUNK) -> DataFrame:
    """Best score so far, whether this row improved on it, and steps since the last improvement."""
    d = running(log, key, pos, {"_prev": (score, "max")}, size, exclusive=True)
    better = F.col(score).isNotNull() & (F.col("_prev").isNull() | (F.col(score) > F.col("_prev")))
    d = d.withColumn("improved", better).withColumn("best", F.greatest("_prev", score))
    d = running(d, key, pos, {"_at": (F.when(F.col("improved"), F.col(pos)), "max")}, size)
    return d.withColumn("since", F.col(pos) - F.col("_at")).drop("_prev", "_at")


def state_revisit(frame_grids: DataFrame, decimals: int = 9, key: str = S, floor_norm: float = 1e-6) -> DataFrame:
    """Share of frames whose rounded state occurred before; frames with norm <= floor_norm are ignored."""
    k = float(10 ** decimals)
    norm = F.sqrt(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x * x))
    state = F.sha2(F.concat_ws(",", F.transform("vals", lambda x: F.floor(x * k + 0.5).cast("string"))), 256)
    live = frame_grids.filter(norm > floor_norm).select(key, state.alias("_s"))
    n = live.groupBy(key, "_s").agg(F.count(F.lit(1)).alias("_n"))
    r = n.groupBy(key).agg((1.0 - F.count(F.lit(1)) / F.sum("_n")).alias("revisit"))
    return frame_grids.select(key).distinct().join(r, key, "left").fillna(0.0)
