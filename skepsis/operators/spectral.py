"""Cosine and Fourier operators.

The bases are small literal matrices sized by the field shape (w x w and h x h), never by the data,
and are applied to each sample's array in place: no join and no shuffle.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import hash_uniform
from ..functions.numeric import col, let, ratio
from .scale import names


def cosine_matrix(n: int) -> list[list[float]]:
    """Unnormalised DCT-II rows."""
    return [[math.cos(math.pi * k * (2 * i + 1) / (2 * n)) for i in range(n)] for k in range(n)]


def orthonormal_matrix(n: int) -> list[list[float]]:
    return [[math.sqrt((1.0 if k == 0 else 2.0) / n) * c for c in row] for k, row in enumerate(cosine_matrix(n))]


def transposed(m):
    return [list(r) for r in zip(*m)]


def lit_matrix(m) -> Column:
    return F.expr(f"array({', '.join('array(' + ', '.join(f'{float(x)!r}D' for x in row) + ')' for row in m)})")


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def as_rows(vals, w: int, h: int) -> Column:
    v = col(vals)
    return F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.slice(v, y * w + 1, w))


def transform_rows(vals, matrix, w: int, h: int) -> Column:
    """[y][k] = sum_x matrix[k][x] * field[y][x] from a flat row-major array."""
    return apply_to_rows(as_rows(vals, w, h), matrix)


def apply_to_rows(rows, matrix) -> Column:
    m = lit_matrix(matrix)
    return F.transform(rows, lambda row: F.transform(m, lambda b: _dot(row, b)))


def transform_columns(rows, matrix, width: int) -> Column:
    """[v][u] = sum_y matrix[v][y] * rows[y][u]."""
    m = lit_matrix(matrix)
    ks = F.sequence(F.lit(0), F.lit(width - 1))
    return let(rows, lambda r: F.transform(m, lambda mv: F.transform(ks, lambda u: F.aggregate(
        F.zip_with(mv, r, lambda c, row: c * F.get(row, u)), F.lit(0.0), lambda s, p: s + p))))


def dct2_rows(vals, w: int, h: int) -> Column:
    """Orthonormal 2-D DCT-II as [v][u]."""
    return transform_columns(transform_rows(vals, orthonormal_matrix(w), w, h), orthonormal_matrix(h), w)


def idct2_flat(coeff_rows, w: int, h: int) -> Column:
    """Inverse of `dct2_rows`, flattened row-major."""
    rows = apply_to_rows(coeff_rows, transposed(orthonormal_matrix(w)))
    return F.flatten(transform_columns(rows, transposed(orthonormal_matrix(h)), w))


def _long(df, keys, rows, a, b, value):
    d = df.select(*keys, F.posexplode(rows).alias(a, "_row"))
    return d.select(*keys, F.col(a).cast("bigint").alias(a), F.posexplode("_row").alias("_k", value)).select(
        *keys, a, F.col("_k").cast("bigint").alias(b), value)


def row_dct(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    """(keys, y, k, c): unnormalised DCT-II of every row."""
    return _long(grids, names(keys), transform_rows("vals", cosine_matrix(w), w, h), "y", "k", "c")


def dct2(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    """(keys, v, u, c): orthonormal 2-D coefficients."""
    return _long(grids, names(keys), dct2_rows("vals", w, h), "vv", "uu", "c")


def idct2(coeffs: DataFrame, keys, w: int, h: int) -> DataFrame:
    """Reconstruct fields from (keys, vv, uu, c); absent coefficients count as zero."""
    keys = names(keys)
    my, mx = orthonormal_matrix(h), orthonormal_matrix(w)
    packed = coeffs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.struct((F.col("vv") * w + F.col("uu")).alias("i"), F.col("c").alias("c")))).alias("m"))
    flat = F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)),
                       lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0.0)))
    return packed.withColumn("_f", flat).select(*keys, idct2_flat(as_rows("_f", w, h), w, h).alias("vals"))


def dct_bands(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    """Row-spectrum energy shares below w/4, below w/2 and above, and the high/low ratio."""
    d = row_dct(grids, keys, w, h)
    e = F.col("c") * F.col("c")
    k = F.col("k")
    a = d.groupBy(*names(keys)).agg(
        F.sum(e).alias("tot"), F.sum(F.when(k < w // 4, e).otherwise(0.0)).alias("lo"),
        F.sum(F.when((k >= w // 4) & (k < w // 2), e).otherwise(0.0)).alias("mid"),
        F.sum(F.when(k >= w // 2, e).otherwise(0.0)).alias("hi"))
    return a.select(*names(keys), ratio("lo", "tot", 0.0).alias("dct_low"), ratio("mid", "tot", 0.0).alias("dct_mid"),
                    ratio("hi", "tot", 0.0).alias("dct_high"), ratio("hi", "lo", 0.0).alias("high_low_ratio"))


def dct_low_energy(grids: DataFrame, keys, w: int, h: int, keep: int = 3) -> DataFrame:
    """Energy inside and outside the keep x keep block, and the share of the 8 lowest non-constant modes."""
    d = dct2(grids, keys, w, h)
    e = F.col("c") * F.col("c")
    block = (F.col("vv") < keep) & (F.col("uu") < keep)
    dc = (F.col("vv") == 0) & (F.col("uu") == 0)
    a = d.groupBy(*names(keys)).agg(
        F.sum(F.when(block, e).otherwise(0.0)).alias("low"), F.sum(F.when(block, 0.0).otherwise(e)).alias("high"),
        F.sum(F.when(block & ~dc, e).otherwise(0.0)).alias("low_ac"), F.sum(F.when(dc, 0.0).otherwise(e)).alias("ac"))
    return a.select(*names(keys), "low", "high", ratio("low_ac", "ac", 0.0).alias("low_share_ac"))


def band_filter_column(vals, w: int, h: int, keep: int, highpass: bool) -> Column:
    def mask(row, v):
        return F.transform(row, lambda c, u: F.when(((v < keep) & (u < keep)) != F.lit(highpass), c).otherwise(0.0))
    return idct2_flat(F.transform(dct2_rows(vals, w, h), mask), w, h)


def band_filter(grids: DataFrame, w: int, h: int, keep: int = 3, highpass: bool = False) -> DataFrame:
    return grids.withColumn("vals", band_filter_column("vals", w, h, keep, highpass))


def sign_surrogate(grids: DataFrame, key: str, w: int, h: int, seed: int) -> DataFrame:
    """Keep |coefficient|, randomise the sign of all but the constant mode."""
    sid = F.col(key)

    def flip(row, v):
        return F.transform(row, lambda c, u: F.when(
            ((v == 0) & (u == 0)) | (hash_uniform(seed, sid, v, u) >= 0.5), c).otherwise(-c))
    return grids.withColumn("vals", idct2_flat(F.transform(dct2_rows("vals", w, h), flip), w, h))


def spectral_sparsity(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    """row0: share of first-row coefficients above 1% of the largest; low_modes: share of the 15
    lowest non-constant 2-D modes above 10% of their largest."""
    first = F.transform(F.get(transform_rows("vals", cosine_matrix(w), w, h), 0), lambda c: F.abs(c))
    modes = F.flatten(transform_columns(transform_rows("vals", cosine_matrix(w)[:4], w, h), cosine_matrix(h)[:4], 4))
    modes = F.transform(F.slice(modes, 2, 15), lambda c: F.abs(c))
    d = grids.select(*names(keys), first.alias("a"), modes.alias("b"))

    def share(a, thr, scaled):
        n = let(F.array_max(a), lambda m: F.size(F.filter(
            a, lambda c: (c / F.nullif(m, F.lit(0.0)) > thr) if scaled else (c > m * thr))))
        return F.when(F.array_max(a) == 0, 0.0).otherwise(n / F.size(a))
    return d.select(*names(keys), share("a", 0.01, True).alias("row0"), share("b", 0.1, False).alias("low_modes"))


def spectral_slope(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    """Log-energy against log-frequency slope of the first row, constant mode left out."""
    d = row_dct(grids, keys, w, h).filter((F.col("y") == 0) & (F.col("k") > 0))
    d = d.filter(F.abs("c") > 1e-10).select(*names(keys), F.ln(F.col("k").cast("double")).alias("f"),
                                            F.ln(F.col("c") * F.col("c")).alias("e"))
    s = d.groupBy(*names(keys)).agg(ratio(F.covar_pop("f", "e"), F.var_pop("f"), 0.0).alias("slope"))
    return grids.select(*names(keys)).join(s, names(keys), "left").fillna(0.0)


def spectral_peaks(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    """Interior local maxima of the summed |row spectrum| above 10% of its largest value, over w."""
    d = row_dct(grids, keys, w, h).groupBy(*names(keys), "k").agg(F.sum(F.abs("c")).alias("a"))
    g = d.groupBy(*names(keys)).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "a"))),
                                                lambda s: s["a"]).alias("s"))
    top = F.array_max(F.slice("s", 2, w - 1))
    at = lambda k: F.get(F.col("s"), k)
    n = let(top, lambda m: F.size(F.filter(F.sequence(F.lit(1), F.lit(w - 2)), lambda k: (
        at(k) > at(k - 1)) & (at(k) > at(k + 1)) & (at(k) > m * 0.1))))
    return g.select(*names(keys), F.when(top == 0, 0.0).otherwise(n / float(w)).alias("peaks"))


def dominant_modes(grids: DataFrame, keys, w: int, h: int, k: int = 10) -> DataFrame:
    """The k strongest non-constant 2-D modes with rank, energy and running share of the energy.

    A sample has w*h modes, so its ranking group is bounded.
    """
    keys = names(keys)
    d = dct2(grids, keys, w, h).withColumn("idx", F.col("vv") * w + F.col("uu")).filter("idx > 0")
    d = d.withColumn("energy", F.col("c") * F.col("c"))
    win = W.partitionBy(*keys)
    order = win.orderBy(F.desc("energy"), "idx")
    d = d.withColumns({"rank": F.row_number().over(order), "tot": F.sum("energy").over(win),
                       "cum": F.sum("energy").over(order.rowsBetween(W.unboundedPreceding, 0))})
    return d.filter(F.col("rank") <= k).select(*keys, F.col("rank").cast("bigint"), "uu", "vv", "energy",
                                               ratio("cum", "tot", 0.0).alias("concentration"))


def highpass_corr(pair_grids: DataFrame, w: int, h: int, keep: int = 3, key: str = "pair_id") -> DataFrame:
    """Pearson of two fields without their keep x keep block.

    The basis is orthonormal and the constant mode is in the block, so the correlation is the
    cosine of the remaining coefficients: no inverse transform.
    """
    def rest(a):
        rows = F.transform(dct2_rows(F.col(a), w, h), lambda row, v: F.transform(
            row, lambda c, u: F.when((v < keep) & (u < keep), 0.0).otherwise(c)))
        return F.flatten(rows)
    d = pair_grids.select(key, rest("f").alias("a"), rest("t").alias("b"))
    den = F.sqrt(_dot("a", "a") * _dot("b", "b"))
    return d.select(key, F.when(den < 1e-15, 0.0).otherwise(_dot("a", "b") / F.nullif(den, F.lit(0.0))).alias("corr"))
