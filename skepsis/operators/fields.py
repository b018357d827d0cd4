"""Two-dimensional field operators.

A field arrives as one row holding its row-major array, so neighbours are read from the same row
while the cells are generated: no window, no self-join, and the only shuffle carries per-task
partial aggregates.  `to_grids` packs a long cell table into that shape once.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import clamp, col, let, ratio
from .scale import names


def checked(vals, w: int, h: int) -> Column:
    """The array, or an error when its length is not w*h or an entry is missing or not finite."""
    v = col(vals)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = (F.size(v) == w * h) & ~bad
    return F.when(ok, v).otherwise(
        F.raise_error(F.lit(f"field must hold {w * h} finite values")).cast("array<double>"))


def explode_arrays(grids: DataFrame, w: int, h: int, vals: str = "vals", strict: bool = True) -> DataFrame:
    """Array column -> cells(y, x, idx, v); every other column is kept."""
    keys = [c for c in grids.columns if c != vals]
    v = checked(vals, w, h) if strict else F.col(vals)
    out = grids.select(*keys, F.posexplode(v).alias("idx", "v"))
    return out.select(*keys, F.floor(F.col("idx") / w).alias("y"), (F.col("idx") % w).cast("bigint").alias("x"),
                      F.col("idx").cast("bigint").alias("idx"), "v")


def to_grids(cells: DataFrame, keys, w: int, h: int, vals: str = "vals") -> DataFrame:
    """Cells -> one array per sample; `checked` keeps the group to exactly w*h rows."""
    packed = F.array_sort(F.collect_list(F.struct("idx", "v")))
    g = cells.groupBy(*names(keys)).agg(packed.alias("_p"))
    return g.select(*names(keys), checked(F.transform("_p", lambda s: s["v"]), w, h).alias(vals))


def explode_pairs(pairs: DataFrame, w: int, h: int, key: str = "pair_id") -> DataFrame:
    out = pairs.select(key, F.posexplode(F.arrays_zip(checked("f", w, h).alias("f"), checked("t", w, h).alias("t")))
                       .alias("idx", "c"))
    return out.select(key, F.floor(F.col("idx") / w).alias("y"), (F.col("idx") % w).cast("bigint").alias("x"),
                      F.col("idx").cast("bigint").alias("idx"), F.col("c.f").alias("f"), F.col("c.t").alias("t"))


def array_mean(vals) -> Column:
    v = col(vals)
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def array_var(vals, mu) -> Column:
    v = col(vals)
    return let(mu, lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))) / F.size(v)


def neighbours(df: DataFrame, keys, w: int, h: int, offsets: dict, arrays=("vals",), keep=()) -> DataFrame:
    """One row per cell with its value and the values at `offsets[name] = (dy, dx)`, NULL outside.

    With one array the columns are v and the offset names; with several they carry the array name
    as a prefix (f, f_r, t, t_r ...).
    """
    keys = names(keys)
    single = len(arrays) == 1
    d = df.select(*keys, *keep, *arrays, F.posexplode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("idx", "_i"))
    idx = F.col("idx")
    y, x = F.floor(idx / w), idx % w
    out = []
    for a in arrays:
        out.append(F.get(F.col(a), idx).alias("v" if single else a))
        for n, (dy, dx) in offsets.items():
            inside = (y + dy).between(0, h - 1) & (x + dx).between(0, w - 1)
            out.append(F.when(inside, F.get(F.col(a), idx + (dy * w + dx))).alias(n if single else f"{a}_{n}"))
    return d.select(*keys, *keep, y.alias("y"), x.cast("bigint").alias("x"), idx.cast("bigint").alias("idx"), *out)


RIGHT_DOWN = {"r": (0, 1), "d": (1, 0)}


def _inner_gradients(grids, keys, w, h):
    n = neighbours(grids, keys, w, h, RIGHT_DOWN).filter((F.col("x") < w - 1) & (F.col("y") < h - 1))
    return n.withColumns({"gx": F.col("r") - F.col("v"), "gy": F.col("d") - F.col("v")})


def gradient_stats(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    """Mean and standard deviation of |forward differences| on the (h-1) x (w-1) interior."""
    g = _inner_gradients(grids, keys, w, h)
    g = g.select(*names(keys), F.explode(F.array(F.abs("gx"), F.abs("gy"))).alias("g"))
    return g.groupBy(*names(keys)).agg(F.avg("g").alias("grad_mean"), F.stddev_pop("g").alias("grad_std"))


def laplacian_stats(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    n = neighbours(grids, keys, w, h, {"l": (0, -1), "r": (0, 1), "u": (-1, 0), "d": (1, 0)})
    n = n.filter(F.col("x").between(1, w - 2) & F.col("y").between(1, h - 2))
    lap = F.col("l") + F.col("r") + F.col("u") + F.col("d") - 4 * F.col("v")
    return n.groupBy(*names(keys)).agg(F.avg(lap).alias("lap_mean"), F.stddev_pop(lap).alias("lap_std"))


def anisotropy(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    """contrast: |mean gx^2 - mean gy^2| over their sum; horizontal: gradient energy share along x;
    directional: largest |directional correlation| minus the mean one, both diagonals pooled."""
    keys = names(keys)
    g = grids.withColumn("mu", array_mean("vals")).withColumn("var", array_var("vals", "mu"))
    n = neighbours(g, keys, w, h, {**RIGHT_DOWN, "dr": (1, 1), "dl": (1, -1)}, keep=("mu", "var"))
    gx, gy = F.col("r") - F.col("v"), F.col("d") - F.col("v")
    inner = (F.col("x") < w - 1) & (F.col("y") < h - 1)
    v0 = F.col("v") - F.col("mu")
    c = {o: v0 * (F.col(o) - F.col("mu")) for o in ("r", "d", "dr", "dl")}
    a = n.groupBy(*keys).agg(
        F.avg(F.when(inner, gx * gx)).alias("vx"), F.avg(F.when(inner, gy * gy)).alias("vy"),
        F.sum(gx * gx).alias("gh"), F.sum(gy * gy).alias("gv"), F.max("var").alias("var"),
        F.avg(c["r"]).alias("ch"), F.avg(c["d"]).alias("cv"),
        F.coalesce(F.sum(c["dr"]), F.lit(0.0)).alias("d1"), F.coalesce(F.sum(c["dl"]), F.lit(0.0)).alias("d2"),
        (F.count("dr") + F.count("dl")).alias("nd"))
    flat = F.col("var") < 1e-15
    var = F.nullif(F.col("var"), F.lit(0.0))
    ah, av = F.abs(F.col("ch") / var), F.abs(F.col("cv") / var)
    ad = F.abs(ratio(F.col("d1") + F.col("d2"), F.col("nd")) / var)
    spread = clamp(F.greatest(ah, av, ad) - (ah + av + ad) / 3.0, 0.0, 1.0)
    return a.select(*keys,
                    ratio(F.abs(F.col("vx") - F.col("vy")), F.col("vx") + F.col("vy"), 0.0).alias("contrast"),
                    ratio("gh", F.col("gh") + F.col("gv"), 0.5).alias("horizontal"),
                    F.when(flat, 0.0).otherwise(spread).alias("directional"))


def edge_density(grids: DataFrame, keys, w: int, h: int, threshold: float = 0.1) -> DataFrame:
    g = _inner_gradients(grids, keys, w, h)
    edge = F.when(F.abs("gx") + F.abs("gy") > threshold, 1.0).otherwise(0.0)
    return g.groupBy(*names(keys)).agg(F.avg(edge).alias("edge_density"))


def local_variance(grids: DataFrame, keys, w: int, h: int, window: int = 3) -> DataFrame:
    """Mean variance of all full window x window blocks, read from the row of the block's corner."""
    offs = {f"b{i}": (i // window, i % window) for i in range(window * window)}
    n = neighbours(grids, keys, w, h, offs).filter((F.col("y") <= h - window) & (F.col("x") <= w - window))
    block = F.array(*[F.col(o) for o in offs])
    n = n.withColumn("_m", array_mean(block)).withColumn("_v", array_var(block, "_m"))
    return n.groupBy(*names(keys)).agg(F.avg("_v").alias("local_variance"))


def row_acf(grids: DataFrame, keys, w: int, h: int, max_lag: int = 5) -> DataFrame:
    """(keys, lag, acf): autocorrelation along rows with the global mean and variance."""
    keys = names(keys)
    g = grids.withColumn("mu", array_mean("vals")).withColumn("var", array_var("vals", "mu"))
    n = neighbours(g, keys, w, h, {f"l{k}": (0, k) for k in range(1, max_lag + 1)}, keep=("mu", "var"))
    v0 = F.col("v") - F.col("mu")
    a = n.groupBy(*keys).agg(F.max("var").alias("var"), *[
        F.avg(v0 * (F.col(f"l{k}") - F.col("mu"))).alias(f"c{k}") for k in range(1, max_lag + 1)])
    return a.select(*keys, F.posexplode(F.array(*[ratio(f"c{k}", "var", 0.0) for k in range(1, max_lag + 1)]))
                    .alias("_k", "acf")).select(*keys, (F.col("_k") + 1).cast("bigint").alias("lag"), "acf")


def guarded_corr(a: str, b: str) -> Column:
    """Aggregate: Pearson correlation, 0 when either side is constant."""
    den = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.coalesce(F.covar_pop(a, b) / F.nullif(den, F.lit(0.0)), F.lit(0.0))


def flat_lag1_pearson(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    """Correlation of the flattened field with itself one index later (row ends wrap to row starts)."""
    keys = names(keys)
    d = grids.select(*keys, "vals", F.posexplode("vals").alias("idx", "v"))
    d = d.select(*keys, "v", F.get(F.col("vals"), F.col("idx") + 1).alias("nxt")).filter("nxt is not null")
    return d.groupBy(*keys).agg(guarded_corr("v", "nxt").alias("lag1"))


def gradient_energy(grids: DataFrame, keys, w: int, h: int) -> DataFrame:
    n = neighbours(grids, keys, w, h, RIGHT_DOWN)
    gx, gy = F.col("r") - F.col("v"), F.col("d") - F.col("v")
    return n.groupBy(*names(keys)).agg(
        (F.coalesce(F.sum(gx * gx), F.lit(0.0)) + F.coalesce(F.sum(gy * gy), F.lit(0.0))).alias("gradient_energy"))


def neighbour_similarity(grids: DataFrame, keys, w: int, h: int, tol: float = 0.1) -> DataFrame:
    """Share of 4-neighbour pairs closer than tol (each undirected pair counted once)."""
    n = neighbours(grids, keys, w, h, RIGHT_DOWN)
    n = n.select(*names(keys), "v", F.explode(F.array("r", "d")).alias("o")).filter("o is not null")
    return n.groupBy(*names(keys)).agg(
        F.avg(F.when(F.abs(F.col("v") - F.col("o")) < tol, 1.0).otherwise(0.0)).alias("similarity"))


# -- connected components -------------------------------------------------------------------------

def region_sizes(w: int, h: int, threshold: float = 0.5):
    """Function of an array column -> (n_components, mean_size, max_size) of its 4-connected regions with v >= threshold.

    An Arrow batch of fields is one forest: every pair of neighbours hooks the larger root of the two onto the
    smaller one and paths are halved until nothing changes, so rounds grow with the logarithm of a region's size.
    """
    n = w * h
    cell = np.arange(n).reshape(h, w)
    a = np.concatenate([cell[:, :-1].ravel(), cell[:-1].ravel()])
    b = np.concatenate([cell[:, 1:].ravel(), cell[1:].ravel()])

    @F.pandas_udf("n_components bigint, mean_size double, max_size bigint")
    def sizes(vals: pd.Series) -> pd.DataFrame:
        m = len(vals)
        on = np.stack(vals.to_list()).reshape(m, n) >= threshold if m else np.zeros((0, n), bool)
        base = np.arange(m, dtype=np.int64)[:, None] * n
        both = on[:, a] & on[:, b]
        p, q = (base + a)[both], (base + b)[both]
        root = np.arange(m * n, dtype=np.int64)
        while len(p):
            rp, rq = root[p], root[q]
            open_ = rp != rq
            p, q, rp, rq = p[open_], q[open_], rp[open_], rq[open_]
            np.minimum.at(root, np.maximum(rp, rq), np.minimum(rp, rq))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
        size = np.bincount(root[on.ravel()], minlength=m * n).reshape(m, n)
        count, top = (size > 0).sum(axis=1), size.max(axis=1, initial=0)
        return pd.DataFrame({"n_components": count, "mean_size": on.sum(axis=1) / np.maximum(count, 1), "max_size": top})
    return sizes


def components(grids: DataFrame, keys, w: int, h: int, threshold: float = 0.5) -> DataFrame:
    """4-connected regions with v >= threshold: count, mean size, largest size (0 when there are none).  Row-local."""
    return grids.select(*names(keys), region_sizes(w, h, threshold)(checked("vals", w, h)).alias("_r")).select(*names(keys), "_r.*")


# -- scores of a field against a target -----------------------------------------------------------

def score01(c) -> Column:
    return clamp((c + 1.0) / 2.0, 0.0, 1.0)


def _cosine01(dot: Column, na: Column, nb: Column) -> Column:
    den = F.sqrt(na * nb)
    return F.when(den < 1e-15, 0.5).otherwise(score01(dot / F.nullif(den, F.lit(0.0))))


def pearson01(pairs: DataFrame, key: str = "pair_id", f: str = "f", t: str = "t") -> DataFrame:
    return pairs.groupBy(key).agg(_pearson01_agg(f, t).alias("pearson01"))


def _pearson01_agg(f, t) -> Column:
    den = F.count(f) * F.sqrt(F.var_pop(f) * F.var_pop(t))
    r = F.count(f) * F.covar_pop(f, t) / F.nullif(den, F.lit(0.0))
    return F.when(den < 1e-15, 0.5).otherwise(score01(r))


def average_rank(value: str, key) -> Column:
    w = W.partitionBy(*names(key))
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*names(key), value)) - 1) / 2.0


def spearman01(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pearson of average ranks.  A pair is one field, so its group is bounded by the shape check."""
    r = pairs.withColumns({"rf": average_rank("f", key), "rt": average_rank("t", key)})
    return r.groupBy(key).agg(_pearson01_agg("rf", "rt").alias("spearman01"))


def mae01(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    return pairs.groupBy(key).agg(_mae01_agg().alias("mae01"))


def _mae01_agg() -> Column:
    return clamp(1.0 - F.avg(F.abs(F.col("f") - F.col("t"))), 0.0, 1.0)


CROSS = {"l": (0, -1), "r": (0, 1), "u": (-1, 0), "d": (1, 0)}


def _gradient01_agg() -> Column:
    def g(a, lo, hi):
        # central difference inside, one-sided at the edges
        return F.coalesce(F.col(f"{a}_{hi}"), F.col(a)) - F.coalesce(F.col(f"{a}_{lo}"), F.col(a))
    fx, fy, tx, ty = g("f", "l", "r"), g("f", "u", "d"), g("t", "l", "r"), g("t", "u", "d")
    return _cosine01(F.sum(fx * tx + fy * ty), F.sum(fx * fx + fy * fy), F.sum(tx * tx + ty * ty))


def gradient01(pair_grids: DataFrame, w: int, h: int, key: str = "pair_id") -> DataFrame:
    n = neighbours(pair_grids, key, w, h, CROSS, arrays=("f", "t"))
    return n.groupBy(key).agg(_gradient01_agg().alias("gradient01"))


def autocorr01(pair_grids: DataFrame, w: int, h: int, key: str = "pair_id", reach: int = 4) -> DataFrame:
    """Cosine of the two fields' autocorrelations over all offsets within +-reach.

    The autocorrelation is even, so half the offsets suffice; scaling by the variance cancels in
    the cosine and is only used for the degenerate guard.
    """
    half = [(dy, dx) for dy in range(0, reach + 1) for dx in range(-reach, reach + 1) if (dy, dx) > (0, 0)]
    half = [(dy, dx) for dy, dx in half if dy < h and abs(dx) < w]
    g = pair_grids.withColumns({"mf": array_mean("f"), "mt": array_mean("t")})
    g = g.withColumns({"vf": array_var("f", "mf"), "vt": array_var("t", "mt")})
    offs = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in half])
    d = g.select(key, "f", "t", "mf", "mt", "vf", "vt", F.explode(offs).alias("o"),
                 ).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))))
    y, x = F.floor(F.col("idx") / w) + F.col("o.dy"), F.col("idx") % w + F.col("o.dx")
    d = d.filter(y.between(0, h - 1) & x.between(0, w - 1))
    j = (y * w + x).cast("int")
    prod = lambda a, m: (F.get(F.col(a), F.col("idx")) - F.col(m)) * (F.get(F.col(a), j) - F.col(m))
    c = d.groupBy(key, "o").agg(F.avg(prod("f", "mf")).alias("af"), F.avg(prod("t", "mt")).alias("at"),
                                F.max("vf").alias("vf"), F.max("vt").alias("vt"))
    af = F.col("af") / F.nullif(F.col("vf"), F.lit(0.0))
    at = F.col("at") / F.nullif(F.col("vt"), F.lit(0.0))
    a = c.groupBy(key).agg(F.max("vf").alias("vf"), F.max("vt").alias("vt"),
                           _cosine01(F.sum(af * at), F.sum(af * af), F.sum(at * at)).alias("s"))
    flat = (F.sqrt("vf") < 1e-15) | (F.sqrt("vt") < 1e-15)
    return a.select(key, F.when(flat, 0.5).otherwise(F.col("s")).alias("autocorr01"))


def spectral01(pair_grids: DataFrame, w: int, h: int, key: str = "pair_id", modes: int = 8) -> DataFrame:
    """Cosine of the lowest unnormalised DCT modes without the constant one."""
    from .spectral import cosine_matrix, transform_rows, transform_columns
    mu, mv = min(modes, w), min(modes, h)

    def coeffs(a):
        flat = F.flatten(transform_columns(transform_rows(F.col(a), cosine_matrix(w)[:mu], w, h),
                                           cosine_matrix(h)[:mv], mu))
        return F.slice(flat, 2, mu * mv - 1)
    d = pair_grids.select(key, coeffs("f").alias("cf"), coeffs("t").alias("ct"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return d.select(key, _cosine01(dot("cf", "ct"), dot("cf", "cf"), dot("ct", "ct")).alias("spectral01"))


WEIGHTS = {"pearson01": 0.25, "spearman01": 0.15, "mae01": 0.15, "gradient01": 0.15,
           "spectral01": 0.15, "autocorr01": 0.15}


def weighted_score() -> Column:
    total = None
    for n, k in WEIGHTS.items():
        term = k * F.col(n)
        total = term if total is None else total + term
    return total


def score_fields(pair_grids: DataFrame, w: int, h: int, key: str = "pair_id") -> DataFrame:
    """All six scores and their weighted composite.  Three of them share one pass over the cells."""
    n = neighbours(pair_grids, key, w, h, CROSS, arrays=("f", "t"))
    one = n.groupBy(key).agg(_pearson01_agg("f", "t").alias("pearson01"), _mae01_agg().alias("mae01"),
                             _gradient01_agg().alias("gradient01"))
    out = (one.join(spearman01(explode_pairs(pair_grids.select(key, "f", "t"), w, h, key), key), key)
           .join(spectral01(pair_grids, w, h, key), key).join(autocorr01(pair_grids, w, h, key), key))
    return out.withColumn("score", weighted_score())


def delta_grids(pair_grids: DataFrame) -> DataFrame:
    """Cell-wise field minus target, keeping the target for the residual correlation."""
    return pair_grids.withColumn("vals", F.zip_with("f", "t", lambda a, b: a - b))


# -- reference geometries -------------------------------------------------------------------------

def geometry_columns(w: int, h: int) -> dict:
    """name -> expression of (x, y): smooth fields any real structure has to beat."""
    u = F.col("x") / (w - 1) if w > 1 else F.lit(0.5)
    v = F.col("y") / (h - 1) if h > 1 else F.lit(0.5)
    pi = math.pi
    return {
        "constant": F.lit(0.5), "x_ramp": u, "y_ramp": v, "bilinear": u * v,
        "radial": F.sqrt((u - 0.5) * (u - 0.5) + (v - 0.5) * (v - 0.5)),
        "abs_sin_u": F.abs(F.sin(pi * u)), "abs_cos_v": F.abs(F.cos(pi * v)),
        "sin_sin": F.sin(pi * u) * F.sin(pi * v),
    }


def geometry_arrays(w: int, h: int) -> Column:
    """array<struct<name, vals>> of all geometries as one row-local expression."""
    pi = math.pi
    seq = F.sequence(F.lit(0), F.lit(w * h - 1))
    u = lambda i: (i % w) / float(w - 1) if w > 1 else F.lit(0.5)
    v = lambda i: F.floor(i / w) / float(h - 1) if h > 1 else F.lit(0.5)
    shapes = {
        "constant": lambda i: F.lit(0.5), "x_ramp": u, "y_ramp": v, "bilinear": lambda i: u(i) * v(i),
        "radial": lambda i: F.sqrt((u(i) - 0.5) * (u(i) - 0.5) + (v(i) - 0.5) * (v(i) - 0.5)),
        "abs_sin_u": lambda i: F.abs(F.sin(pi * u(i))), "abs_cos_v": lambda i: F.abs(F.cos(pi * v(i))),
        "sin_sin": lambda i: F.sin(pi * u(i)) * F.sin(pi * v(i)),
    }
    def over_cells(e):
        return F.transform(seq, lambda i: e(i).cast("double"))
    return F.array(*[F.struct(F.lit(n).alias("name"), over_cells(e).alias("vals")) for n, e in shapes.items()])


def geometry_controls(grids: DataFrame, w: int, h: int, key: str = "sample_id") -> DataFrame:
    """Scores of every geometry against every sample, keyed (key, name)."""
    p = grids.select(key, F.col("vals").alias("t"), F.explode(geometry_arrays(w, h)).alias("g"))
    p = p.select(F.struct(key, F.col("g.name").alias("name")).alias("pair_id"), F.col("g.vals").alias("f"), "t")
    s = score_fields(p, w, h)
    return s.select(F.col(f"pair_id.{key}").alias(key), F.col("pair_id.name").alias("name"),
                    *WEIGHTS, "score")
