"""Aggregations over the values of a sample, series or log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import bin_index, clamp, col, entropy_bits, entropy_nats, trunc
from .degrade import to_float16, to_float32
from .scale import names, rank_quantiles


def with_stats(df: DataFrame, keys, **aggs) -> DataFrame:
    """Join group aggregates back.  The statistics side is one row per group; whether it is
    broadcast is decided from its measured size at run time."""
    return df.join(df.groupBy(*names(keys)).agg(*[a.alias(n) for n, a in aggs.items()]), names(keys))


def moments(df: DataFrame, keys, v: str = "v") -> DataFrame:
    """Mean, population variance, skewness and excess kurtosis; 0 where the variance is 0."""
    return df.groupBy(*names(keys)).agg(
        F.avg(v).alias("mean"), F.var_pop(v).alias("var"),
        F.when(F.var_pop(v) > 0, F.skewness(v)).otherwise(0.0).alias("skew"),
        F.when(F.var_pop(v) > 0, F.kurtosis(v)).otherwise(0.0).alias("kurt"))


def hist_entropy(df: DataFrame, keys, v: str = "v", bins: int = 32, span: str = "minmax",
                 base: str = "bits", normalise: bool = False, out: str = "entropy") -> DataFrame:
    """Histogram entropy.  span: 'minmax' per group or 'unit' for [0, 1) with clamping."""
    import math
    keys = names(keys)
    if span == "unit":
        b = clamp(trunc(col(v) * float(bins)), 0, bins - 1)
        d = df.select(*keys, b.alias("_b"))
    else:
        s = with_stats(df.select(*keys, v), keys, _lo=F.min(v), _hi=F.max(v))
        d = s.select(*keys, bin_index(v, "_lo", "_hi", bins).alias("_b"))
    c = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    e = entropy_bits(F.col("_n")) if base == "bits" else entropy_nats(F.col("_n"))
    if normalise:
        e = e / (math.log2(bins) if base == "bits" else math.log(bins))
    return c.groupBy(*keys).agg(e.alias(out))


def value_counts(df: DataFrame, keys, v: str = "v") -> DataFrame:
    return df.groupBy(*names(keys), v).agg(F.count(F.lit(1)).alias("n"))


def quantization_level(df: DataFrame, keys, v: str = "v", approximate: bool = False) -> DataFrame:
    """Bit depth suggested by the number of distinct values."""
    if approximate:
        d = df.groupBy(*names(keys)).agg(F.approx_count_distinct(v).alias("distinct_values"))
    else:
        d = value_counts(df, keys, v).groupBy(*names(keys)).agg(F.count(F.lit(1)).alias("distinct_values"))
    n = F.col("distinct_values")
    return d.withColumn("level", F.when(n <= 16, 4).when(n <= 256, 8).when(n <= 65536, 16).otherwise(32))


def repeated_fraction(df: DataFrame, keys, v: str = "v") -> DataFrame:
    return value_counts(df, keys, v).groupBy(*names(keys)).agg(
        (1.0 - F.count(F.lit(1)) / F.sum("n")).alias("repeated"))


def recurrence(df: DataFrame, keys, v: str = "v", scale: float = 256.0) -> DataFrame:
    """Exact recurrence rate and entropy of trunc(v * scale)."""
    q = df.select(*names(keys), trunc(col(v) * scale).alias("q"))
    return value_counts(q, keys, "q").groupBy(*names(keys)).agg(
        (1.0 - F.count(F.lit(1)) / F.sum("n")).alias("exact"), entropy_bits(F.col("n")).alias("entropy"))


def near_recurrence(df: DataFrame, keys, v: str = "v", idx: str = "idx", scale: float = 256.0) -> DataFrame:
    """Share of values with a later value within one quantum.

    Only the last index per quantum matters: spread it to its two neighbours, no pair enumeration.
    """
    keys = names(keys)
    q = df.select(*keys, idx, trunc(col(v) * scale).alias("q"))
    last = q.groupBy(*keys, "q").agg(F.max(idx).alias("m"))
    reach = (last.select(*keys, F.explode(F.array(F.col("q") - 1, F.col("q"), F.col("q") + 1)).alias("q"), "m")
             .groupBy(*keys, "q").agg(F.max("m").alias("m")))
    return q.join(reach, keys + ["q"]).groupBy(*keys).agg(
        F.avg(F.when(F.col("m") > F.col(idx), 1.0).otherwise(0.0)).alias("near"))


def dominant_level(df: DataFrame, keys, v: str = "v") -> DataFrame:
    """Levels at 1e-5 with the largest share, and the count of 1e-2 levels over min(n, 100)."""
    keys = names(keys)
    fine = value_counts(df.select(*keys, trunc(col(v) * 100000.0 + 0.5).alias("q")), keys, "q").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("levels"), (F.max("n") / F.sum("n")).alias("dominant"))
    coarse = value_counts(df.select(*keys, trunc(col(v) * 100.0).alias("q")), keys, "q").groupBy(*keys).agg(
        (F.count(F.lit(1)) / F.least(F.sum("n"), F.lit(100))).alias("level_ratio"))
    return fine.join(coarse, keys)


def precision_diff(df: DataFrame, keys, v: str = "v") -> DataFrame:
    x = col(v)
    return df.groupBy(*names(keys)).agg(F.avg(F.abs(x - to_float32(x))).alias("float32_diff"),
                                        F.avg(F.abs(x - to_float16(x))).alias("float16_diff"))


def entropy_sensitivity(df: DataFrame, keys, v: str = "v", bins: int = 16) -> DataFrame:
    """|entropy - entropy after 8-bit quantisation| on [0, 1), normalised; both from one pass."""
    import math
    keys = names(keys)
    x = col(v)
    b = lambda c: clamp(trunc(c * float(bins)), 0, bins - 1)
    arms = F.array(F.struct(F.lit("raw").alias("arm"), b(x).alias("b")),
                   F.struct(F.lit("q8").alias("arm"), b(F.floor(x * 256.0) / 255.0).alias("b")))
    d = df.select(*keys, F.explode(arms).alias("_a")).select(*keys, "_a.arm", "_a.b")
    e = (d.groupBy(*keys, "arm", "b").agg(F.count(F.lit(1)).alias("n"))
         .groupBy(*keys, "arm").agg(entropy_nats(F.col("n")).alias("h")))
    h, q = F.max(F.when(F.col("arm") == "raw", F.col("h"))), F.max(F.when(F.col("arm") == "q8", F.col("h")))
    return e.groupBy(*keys).agg(F.when(h > 0, F.abs(h - q) / math.log(bins)).otherwise(0.0).alias("sensitivity"))


def quantile_interp(df: DataFrame, keys, v: str, probs: dict) -> DataFrame:
    """Linearly interpolated quantiles, exact, from distinct-value counts."""
    return rank_quantiles(df, keys, v, {n: (lambda t, p=p: (t - 1) * p) for n, p in probs.items()})


def quantile_index(df: DataFrame, keys, v: str, probs: dict) -> DataFrame:
    """sorted[int(p * n)], capped at the last element."""
    return rank_quantiles(df, keys, v, {
        n: (lambda t, p=p: F.least(F.floor(t * F.lit(p)), t - 1)) for n, p in probs.items()})


def grouped_counts(df: DataFrame, sets: list[list[str]], measure: Column | None = None) -> DataFrame:
    """Counts over several key sets in one pass; `set_id` is the grouping bit vector."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    g = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    aggs = [F.count(F.lit(1)).alias("n"), F.grouping_id(*cols).alias("set_id")]
    if measure is not None:
        aggs.append(measure)
    return g.agg(*aggs)


def best_of(log: DataFrame, keys, score: str = "score", tie: str = "candidate_id",
            keep: tuple = (), ok: Column | None = None) -> DataFrame:
    """Best scored row per key, ties to the smaller id.  An aggregate, not a sort per group."""
    good = log.filter(F.col(score).isNotNull() & (ok if ok is not None else F.col("status") == "OK"))
    best = F.max(F.struct(F.col(score), (-F.col(tie)).alias("_t"), *[F.col(c) for c in keep]))
    return good.groupBy(*names(keys)).agg(best.alias("_b")).select(
        *names(keys), (-F.col("_b._t")).alias(tie), F.col(f"_b.{score}").alias(score),
        *[F.col(f"_b.{c}").alias(c) for c in keep])


def count_by_role(log: DataFrame, keys) -> DataFrame:
    return log.groupBy(*names(keys)).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "OK", 1)).alias("n_ok"))


def reference_stats(series: DataFrame, keys, ref: int = 200, v: str = "v", t: str = "t") -> DataFrame:
    """Mean, rms, min, max and non-zero count over the first `ref` positions (filter is pushed down)."""
    x = col(v)
    return series.filter(F.col(t).between(1, ref)).groupBy(*names(keys)).agg(
        F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rms"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.count(F.when(F.abs(x) > 1e-18, 1)).alias("nonzero"))


def compare_series(a: DataFrame, b: DataFrame, keys, v: str = "v") -> DataFrame:
    """Differences of two series at equal positions."""
    from .fields import guarded_corr
    keys = names(keys)
    j = a.select(*keys, "t", F.col(v).alias("_a")).join(b.select(*keys, "t", F.col(v).alias("_b")), keys + ["t"])
    d = F.col("_a") - F.col("_b")
    return j.groupBy(*keys).agg(F.max(F.abs(d)).alias("max_abs"), F.avg(F.abs(d)).alias("mean_abs"),
                                F.sqrt(F.avg(d * d)).alias("rmse"), guarded_corr("_a", "_b").alias("corr"),
                                F.count(F.lit(1)).alias("n"))


def event_magnitude(series: DataFrame, keys, horizons: list[int], v: str = "v") -> DataFrame:
    """Count, rms and extreme non-zero magnitudes of the first h positions, for every horizon h."""
    keys = names(keys)
    hs = F.filter(F.array(*[F.lit(h).cast("bigint") for h in horizons]), lambda h: h >= F.col("t"))
    d = series.select(*keys, F.col(v).alias("_v"), F.explode(hs).alias("horizon"))
    a = F.when(F.abs("_v") > 1e-18, F.abs("_v"))
    return d.groupBy(*keys, "horizon").agg(
        F.count(a).alias("events"), F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("rms"),
        F.coalesce(F.max(a), F.lit(0.0)).alias("max_abs"), F.coalesce(F.min(a), F.lit(0.0)).alias("min_abs"))


def baseline_stats(df: DataFrame, keys, v: str = "v") -> DataFrame:
    return df.groupBy(*names(keys)).agg(
        F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"))
