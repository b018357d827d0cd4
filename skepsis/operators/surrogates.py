"""Fourier surrogates of series of any length.

The transform is the four-step form: N = N1 * N2 splits one length-N transform into N2 transforms of
length N1, a twiddle, and N1 transforms of length N2.  Each step is a groupBy, and a group holds about
sqrt(N) values, so a series is never collected into one task; numpy only transforms those groups.
"""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_uniform
from ..functions.numeric import clamp, col
from .degrade import exponent2
from .scale import dense_position, materialize, names


def next_pow2(n) -> Column:
    n = col(n).cast("double")
    p = F.pow(F.lit(2.0), exponent2(n))
    return F.when(p == n, p).otherwise(2.0 * p).cast("bigint")


def _group_fft(inverse: bool):
    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def run(i: pd.Series, re: pd.Series, im: pd.Series, size: pd.Series) -> pd.DataFrame:
        import numpy as np
        out_re, out_im = [], []
        for at, a, b, n in zip(i, re, im, size):
            x = np.zeros(int(n), dtype=complex)
            x[at] = a + 1j * b
            y = np.fft.ifft(x) * len(x) if inverse else np.fft.fft(x)
            out_re.append(y.real)
            out_im.append(y.imag)
        return pd.DataFrame({"re": out_re, "im": out_im})

    return lambda size: run(F.col("_c.i"), F.col("_c.re"), F.col("_c.im"), F.col(size))


def fft(df: DataFrame, keys, n: str = "n", inverse: bool = False) -> DataFrame:
    """(keys, n, i, re, im) -> (keys, n, i, re, im): i is the 0-based index, n a power of two per key.
    Absent indices count as zero.  The inverse divides by n."""
    keys = names(keys)
    p = exponent2(F.col(n).cast("double")).cast("int")
    n1 = F.pow(F.lit(2.0), F.floor(p / 2).cast("double")).cast("bigint")
    d = df.withColumns({"_n1": n1, "_n2": (F.col(n) / n1).cast("bigint")})
    i = F.col("i")
    d = d.withColumns({"_m2": i % F.col("_n2"), "_m1": F.floor(i / F.col("_n2"))})
    run = _group_fft(inverse)
    g = d.groupBy(*keys, n, "_n1", "_n2", "_m2").agg(F.collect_list(F.struct(F.col("_m1").alias("i"), "re", "im")).alias("_c"))
    s = g.select(*keys, n, "_n1", "_n2", "_m2", run("_n1").alias("_f")).select(
        *keys, n, "_n1", "_n2", "_m2", F.posexplode(F.arrays_zip("_f.re", "_f.im")).alias("_k", "_y"))
    ang = (2.0 if inverse else -2.0) * math.pi * F.col("_m2") * F.col("_k") / F.col(n)
    re, im = F.col("_y.re"), F.col("_y.im")
    s = s.select(*keys, n, "_n1", "_n2", "_m2", F.col("_k").cast("bigint").alias("_k1"),
                 (re * F.cos(ang) - im * F.sin(ang)).alias("re"), (re * F.sin(ang) + im * F.cos(ang)).alias("im"))
    g = s.groupBy(*keys, n, "_n1", "_n2", "_k1").agg(F.collect_list(F.struct(F.col("_m2").alias("i"), "re", "im")).alias("_c"))
    o = g.select(*keys, n, "_n1", "_k1", run("_n2").alias("_f")).select(
        *keys, n, "_n1", "_k1", F.posexplode(F.arrays_zip("_f.re", "_f.im")).alias("_k", "_y"))
    scale = F.col(n) if inverse else F.lit(1.0)
    return o.select(*keys, n, (F.col("_k1") + F.col("_n1") * F.col("_k")).alias("i"),
                    (F.col("_y.re") / scale).alias("re"), (F.col("_y.im") / scale).alias("im"))


def spectrum(series: DataFrame, keys, v: str = "v", t: str = "t", lengths: DataFrame | None = None) -> DataFrame:
    """Transform of a 1-based dense series, padded with zeros to a power of two."""
    keys = names(keys)
    if lengths is None:
        lengths = series.groupBy(*keys).agg(F.max(t).alias("_len"))
    n = lengths.select(*keys, next_pow2("_len").alias("n"))
    d = series.select(*keys, (F.col(t) - 1).cast("bigint").alias("i"), F.col(v).alias("re"), F.lit(0.0).alias("im"))
    return fft(d.join(n, keys), keys)


def _back(spec: DataFrame, keys, lengths: DataFrame, t: str = "t") -> DataFrame:
    keys = names(keys)
    out = fft(spec, keys, inverse=True).join(lengths, keys).filter(F.col("i") < F.col("_len"))
    return out.select(*keys, (F.col("i") + 1).alias(t), F.col("re").alias("v"))


def phase_surrogate(series: DataFrame, keys, seed, v: str = "v", t: str = "t") -> DataFrame:
    """Same amplitude spectrum, random phases.

    Phases are keyed draws of the positive frequency, the negative one takes the conjugate; the
    constant and the Nyquist term keep their signed real value, so the mean is preserved.
    """
    keys = names(keys)
    series = materialize(series.select(*keys, t, v))
    lengths = materialize(series.groupBy(*keys).agg(F.max(t).alias("_len")))
    s = spectrum(series, keys, v, t, lengths)
    k, n = F.col("i"), F.col("n")
    half = F.least(k, n - k)
    ph = 2.0 * math.pi * hash_uniform(seed, *[F.col(c) for c in keys], half) - math.pi
    mag = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    fixed = (k == 0) | (k * 2 == n)
    sign = F.when(k * 2 < n, 1.0).otherwise(-1.0)
    s = s.withColumns({"_mag": mag, "_ph": ph}).select(
        *keys, "n", "i", F.when(fixed, F.col("re")).otherwise(F.col("_mag") * F.cos("_ph")).alias("re"),
        F.when(fixed, 0.0).otherwise(sign * F.col("_mag") * F.sin("_ph")).alias("im"))
    return _back(s, keys, lengths, t)


def trajectory_surrogate(frames: DataFrame, seed, key: str = "series_id") -> DataFrame:
    """`phase_surrogate` of every cell's time series."""
    return phase_surrogate(frames, [key, "idx"], seed)


def spectrum_match(source: DataFrame, target: DataFrame, keys, v: str = "v", t: str = "t", bound: float = 1.5) -> DataFrame:
    """Source phases with the target's magnitudes assigned by rank, clamped to +-bound."""
    keys = names(keys)
    lengths = materialize(source.groupBy(*keys).agg(F.max(t).alias("_len")))

    def ranked(spec):
        m = materialize(spec).withColumn("_mag", F.floor(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) * 1e9 + 0.5) / 1e9)
        return dense_position(m, keys, ["_mag", "i"], F.floor(F.ln(F.col("_mag") + 1e-9) * 8.0), out="_r")
    s = ranked(spectrum(source, keys, v, t, lengths))
    g = ranked(spectrum(target, keys, v, t)).select(*keys, "_r", F.col("_mag").alias("_new"))
    j = s.join(g, keys + ["_r"])
    f = F.col("_new") / F.nullif(F.col("_mag"), F.lit(0.0))
    j = j.select(*keys, "n", "i", F.coalesce(F.col("re") * f, F.col("_new")).alias("re"), F.coalesce(F.col("im") * f, F.lit(0.0)).alias("im"))
    return _back(j, keys, lengths, t).withColumn("v", clamp("v", -bound, bound))
