"""All features of a field in one pass over its array.

A feature is a Column over named parts of the array (mean, deviations, gradients, spectra, sorted
levels ...).  `fingerprint` works out which parts the chosen features need, adds each of them once, in
the order of their dependencies, and emits the features as rows: one scan, no shuffle, no join.

Values that a definition leaves open: a constant field has variance, skewness, kurtosis, correlations and
spectral shares 0 (`horizontal` is 0.5).  A field that isn't w*h finite values is an error.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import bin_index, clamp, let, ratio, trunc
from . import fields, spectral
from .degrade import run_summary, to_float16, to_float32
from .scale import names

PARTS: dict[str, Callable] = {}
FEATURES: dict[str, tuple[str, Callable]] = {}


class Parts:
    """Gives the column of a part and notes that it was asked for."""

    def __init__(self, w: int, h: int):
        self.w, self.h, self.n = w, h, w * h
        self._asked: list[str] = []

    def __getattr__(self, name: str) -> Column:
        if name not in PARTS:
            raise AttributeError(f"unknown part {name}")
        self._asked.append(name)
        return F.col(f"_part_{name}")

    def collect(self, build: Callable):
        """The expression that `build` makes, and the parts that it reads."""
        self._asked = []
        out = build(self)
        return out, list(dict.fromkeys(self._asked))


def part(name: str, build: Callable) -> None:
    """Name an intermediate value; build(parts) -> Column may read other parts."""
    if name in PARTS or name in ("w", "h", "n", "collect"):
        raise ValueError(f"part {name} exists")
    PARTS[name] = build


def register(name: str, family: str, build: Callable) -> None:
    """Name a feature; build(parts) -> numeric Column."""
    if name in FEATURES:
        raise ValueError(f"feature {name} exists")
    FEATURES[name] = (family, build)


def chosen(which: list[str] | None = None, families: list[str] | None = None) -> list[str]:
    """Names of the wanted features; an unknown name or family is an error."""
    unknown = set(which or ()) - set(FEATURES) | set(families or ()) - {f for f, _ in FEATURES.values()}
    if unknown:
        raise ValueError(f"unknown features or families: {sorted(unknown)}")
    return [n for n, (f, _) in FEATURES.items() if (which is None or n in which) and (families is None or f in families)]


def fingerprint_wide(grids: DataFrame, keys, w: int, h: int, which: list[str] | None = None, families: list[str] | None = None,
                     vals: str = "vals") -> DataFrame:
    """(keys, one column per feature)."""
    p = Parts(w, h)
    wanted = chosen(which, families)
    built = {n: p.collect(FEATURES[n][1]) for n in wanted}
    depth: dict[str, int] = {}
    exprs: dict[str, Column] = {}

    def place(name: str) -> int:
        if name not in depth:
            exprs[name], need = p.collect(PARTS[name])
            depth[name] = 1 + max([place(q) for q in need], default=0)
        return depth[name]
    for _, need in built.values():
        for q in need:
            place(q)
    d = grids.select(*names(keys), fields.checked(vals, w, h).alias("_part_vals"))
    for level in range(1, max(depth.values(), default=0) + 1):
        new = {f"_part_{q}": exprs[q] for q in exprs if depth[q] == level and q != "vals"}
        d = d.withColumns(new) if new else d
    return d.select(*names(keys), *[e.cast("double").alias(n) for n, (e, _) in built.items()])


def fingerprint(grids: DataFrame, keys, w: int, h: int, which: list[str] | None = None, families: list[str] | None = None,
                vals: str = "vals") -> DataFrame:
    """(keys, name, family, value): all chosen features, long."""
    wide = fingerprint_wide(grids, keys, w, h, which, families, vals)
    arms = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(FEATURES[n][0]).alias("family"), F.col(f"`{n}`").alias("value"))
                     for n in chosen(which, families)])
    return wide.select(*names(keys), F.explode(arms).alias("_f")).select(*names(keys), "_f.*")


# -- array helpers -------------------------------------------------------------------------------------

def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def average(a: Column) -> Column:
    return let(a, lambda x: ratio(total(x), F.size(x), 0.0))


def spread(a: Column) -> Column:
    """Population variance."""
    return let(a, lambda x: let(average(x), lambda m: average(F.transform(x, lambda v: (v - m) * (v - m)))))


def block(v: Column, w: int, y: int, x: int, height: int, width: int) -> Column:
    """Rows y.. and columns x.. of a row-major array, row-major."""
    if height <= 0 or width <= 0:
        return F.array().cast("array<double>")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: F.slice(v, (i + y) * w + x + 1, width)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squares(a: Column) -> Column:
    return F.transform(a, lambda x: x * x)


def runs(a: Column, in_order: bool = False) -> Column:
    a = F.transform(a, lambda x: x.cast("double"))
    return run_summary(a if in_order else F.array_sort(a))


def entropy(r: Column, n: int) -> Column:
    """Nats of the shares of runs."""
    return F.greatest(F.lit(math.log(n)) - r["s"] / float(n), F.lit(0.0))


# -- parts ---------------------------------------------------------------------------------------------

part("vals", lambda p: F.lit(None))
part("mean", lambda p: total(p.vals) / float(p.n))
part("lo", lambda p: F.array_min(p.vals))
part("hi", lambda p: F.array_max(p.vals))
part("dev", lambda p: let(p.mean, lambda m: F.transform(p.vals, lambda x: x - m)))
part("var", lambda p: total(squares(p.dev)) / float(p.n))
part("levels", lambda p: runs(p.vals))
part("bins32", lambda p: runs(_bins(p, 32)))
part("bins16", lambda p: runs(_bins(p, 16)))
part("unit16", lambda p: runs(F.transform(p.vals, lambda x: clamp(trunc(x * 16.0), 0, 15))))
part("unit16_q8", lambda p: runs(F.transform(p.vals, lambda x: clamp(trunc(F.floor(x * 256.0) / 255.0 * 16.0), 0, 15))))
part("quanta", lambda p: F.transform(p.vals, lambda x: trunc(x * 256.0)))
part("quanta_runs", lambda p: runs(p.quanta))
part("fine", lambda p: runs(F.transform(p.vals, lambda x: trunc(x * 100000.0 + 0.5))))
part("coarse", lambda p: runs(F.transform(p.vals, lambda x: trunc(x * 100.0))))
part("bytes", lambda p: runs(F.transform(p.vals, lambda x: trunc(x * 0.05 * 256.0).bitwiseAND(255)), in_order=True))
part("last_seen", lambda p: _last_seen(p.quanta))
part("gx", lambda p: let(p.vals, lambda v: minus(block(v, p.w, 0, 1, p.h - 1, p.w - 1), block(v, p.w, 0, 0, p.h - 1, p.w - 1))))
part("gy", lambda p: let(p.vals, lambda v: minus(block(v, p.w, 1, 0, p.h - 1, p.w - 1), block(v, p.w, 0, 0, p.h - 1, p.w - 1))))
part("across", lambda p: let(p.vals, lambda v: minus(block(v, p.w, 0, 1, p.h, p.w - 1), block(v, p.w, 0, 0, p.h, p.w - 1))))
part("down", lambda p: let(p.vals, lambda v: minus(block(v, p.w, 1, 0, p.h - 1, p.w), block(v, p.w, 0, 0, p.h - 1, p.w))))
part("steps", lambda p: F.transform(F.concat(p.gx, p.gy), lambda g: F.abs(g)))
part("curvature", lambda p: let(p.vals, lambda v: minus(
    plus(plus(block(v, p.w, 1, 0, p.h - 2, p.w - 2), block(v, p.w, 1, 2, p.h - 2, p.w - 2)),
         plus(block(v, p.w, 0, 1, p.h - 2, p.w - 2), block(v, p.w, 2, 1, p.h - 2, p.w - 2))),
    F.transform(block(v, p.w, 1, 1, p.h - 2, p.w - 2), lambda x: 4 * x))))
part("gx2", lambda p: total(squares(p.gx)))
part("gy2", lambda p: total(squares(p.gy)))
part("across2", lambda p: total(squares(p.across)))
part("down2", lambda p: total(squares(p.down)))
part("directions", lambda p: _directions(p))
part("regions", lambda p: fields.region_sizes(p.w, p.h, 0.5)(p.vals))
part("row_dct", lambda p: spectral.transform_rows(p.vals, spectral.cosine_matrix(p.w), p.w, p.h))
part("row_energy", lambda p: _over_rows(p.row_dct, p.w, lambda c: c * c))
part("row_amplitude", lambda p: _over_rows(p.row_dct, p.w, lambda c: F.abs(c)))
part("row_total", lambda p: total(p.row_energy))
part("first_row", lambda p: F.transform(F.get(p.row_dct, 0), lambda c: F.abs(c)))
part("slope", lambda p: _slope(p.first_row))
part("modes", lambda p: F.flatten(spectral.dct2_rows(p.vals, p.w, p.h)))
part("mode_energy", lambda p: squares(p.modes))
part("mode_total", lambda p: total(p.mode_energy))
part("mode_block", lambda p: let(p.mode_energy, lambda e: total(block(e, p.w, 0, 0, 3, 3))))
part("mode_rank", lambda p: F.reverse(F.array_sort(F.slice(p.mode_energy, 2, p.n - 1))))
part("low_modes", lambda p: _low_modes(p))


def _bins(p: Parts, bins: int) -> Column:
    return let(F.struct(p.lo.alias("lo"), p.hi.alias("hi")), lambda s: F.transform(p.vals, lambda x: bin_index(x, s["lo"], s["hi"], bins)))


def _last_seen(quanta: Column) -> Column:
    """Levels in ascending order with the last position of each."""
    pos = F.array_sort(F.transform(quanta, lambda q, i: F.struct(q.alias("q"), i.alias("i"))))
    return let(pos, lambda a: F.filter(a, lambda e, i: F.coalesce(F.get(a, i + 1)["q"] != e["q"], F.lit(True))))


def _near(last: Column) -> Column:
    """How many levels have no later value within one level."""
    def alone(a, e, j):
        o = F.get(a, j)
        return F.coalesce((F.abs(o["q"] - e["q"]) > 1) | (o["i"] < e["i"]), F.lit(True))
    # F.get is NULL outside the array, below as well as above
    return let(last, lambda a: F.size(F.filter(a, lambda e, i: alone(a, e, i - 1) & alone(a, e, i + 1))))


def _directions(p: Parts) -> Column:
    """|correlation| along rows, along columns and along both diagonals, NULL for a constant field."""
    w, h = p.w, p.h
    var = F.nullif(p.var, F.lit(0.0))

    def shifts(d, pairs):
        n = sum(hh * ww for *_, hh, ww in pairs)
        parts = [dot(block(d, w, y0, x0, hh, ww), block(d, w, y1, x1, hh, ww)) for y0, x0, y1, x1, hh, ww in pairs]
        return (sum(parts[1:], parts[0]) / float(n)) if n else F.lit(None).cast("double")
    return let(p.dev, lambda d: F.transform(F.array(
        shifts(d, [(0, 0, 0, 1, h, w - 1)]), shifts(d, [(0, 0, 1, 0, h - 1, w)]),
        shifts(d, [(0, 0, 1, 1, h - 1, w - 1), (0, 1, 1, 0, h - 1, w - 1)])), lambda c: F.abs(c / var)))


def _over_rows(rows: Column, w: int, f) -> Column:
    return F.aggregate(rows, F.array_repeat(F.lit(0.0), w), lambda s, r: F.zip_with(s, r, lambda a, c: a + f(c)))


def _slope(first: Column) -> Column:
    """Regression of ln c^2 on ln k over the coefficients that aren't 0, constant mode left out."""
    pts = F.filter(F.transform(first, lambda c, k: F.struct(k.alias("k"), c.alias("c"))), lambda s: (s["k"] > 0) & (s["c"] > 1e-10))
    xy = F.transform(pts, lambda s: F.struct(F.ln(s["k"].cast("double")).alias("x"), F.ln(s["c"] * s["c"]).alias("y")))

    def fit(a):
        mx, my = average(F.transform(a, lambda s: s["x"])), average(F.transform(a, lambda s: s["y"]))
        return let(F.struct(mx.alias("x"), my.alias("y")), lambda m: ratio(
            total(F.transform(a, lambda s: (s["x"] - m["x"]) * (s["y"] - m["y"]))), total(F.transform(a, lambda s: (s["x"] - m["x"]) * (s["x"] - m["x"]))), 0.0))
    return let(xy, fit)


def _low_modes(p: Parts) -> Column:
    """|unnormalised coefficient| of the 15 lowest non-constant modes, taken from the orthonormal ones."""
    norm = lambda k, n: math.sqrt((1.0 if k == 0 else 2.0) / n)
    size = [norm(v, p.h) * norm(u, p.w) for v in range(4) for u in range(4)]
    low = let(p.modes, lambda m: block(m, p.w, 0, 0, 4, 4))
    return F.slice(F.zip_with(low, F.array(*[F.lit(s) for s in size]), lambda c, s: F.abs(c / s)), 2, 15)


def _above(a: Column, share: float, relative: bool) -> Column:
    return let(a, lambda x: let(F.array_max(x), lambda m: F.when(m == 0, 0.0).otherwise(F.size(F.filter(
        x, lambda c: (c / F.nullif(m, F.lit(0.0)) > share) if relative else (c > m * share))) / F.size(x))))


def _peaks(p: Parts) -> Column:
    def count(s):
        at = lambda k: F.get(s, k)
        return let(F.array_max(F.slice(s, 2, p.w - 1)), lambda m: F.size(F.filter(F.sequence(F.lit(1), F.lit(p.w - 2)), lambda k: (
            at(k) > at(k - 1)) & (at(k) > at(k + 1)) & (at(k) > m * 0.1))) / float(p.w))
    return let(p.row_amplitude, count)


def _local_variance(p: Parts, size: int = 3) -> Column:
    hh, ww = p.h - size + 1, p.w - size + 1

    def go(v):
        wins = [block(v, p.w, y, x, hh, ww) for y in range(size) for x in range(size)]
        s = wins[0]
        for b in wins[1:]:
            s = plus(s, b)

        def around(m):
            q = None
            for b in wins:
                e = F.zip_with(b, m, lambda x, c: (x - c) * (x - c))
                q = e if q is None else plus(q, e)
            return average(F.transform(q, lambda x: x / float(size * size)))
        return let(F.transform(s, lambda x: x / float(size * size)), around)
    return let(p.vals, go)


def _row_acf(p: Parts, k: int) -> Column:
    return let(p.dev, lambda d: ratio(dot(block(d, p.w, 0, 0, p.h, p.w - k), block(d, p.w, 0, k, p.h, p.w - k)) / float(p.h * (p.w - k)), p.var, 0.0))


def _flat_lag1(p: Parts) -> Column:
    def corr(a, b):
        return let(F.struct(average(a).alias("a"), average(b).alias("b")), lambda m: let(F.struct(
            total(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"]))).alias("c"),
            total(F.transform(a, lambda x: (x - m["a"]) * (x - m["a"]))).alias("p"),
            total(F.transform(b, lambda y: (y - m["b"]) * (y - m["b"]))).alias("q")), lambda s: ratio(s["c"], F.sqrt(s["p"] * s["q"]), 0.0)))
    return let(p.vals, lambda v: corr(F.slice(v, 1, p.n - 1), F.slice(v, 2, p.n - 1)))


def _similarity(p: Parts) -> Column:
    return average(F.transform(F.concat(p.across, p.down), lambda g: F.when(F.abs(g) < 0.1, 1.0).otherwise(0.0)))


def _moment(p: Parts, k: int) -> Column:
    return let(p.dev, lambda d: total(F.transform(d, lambda x: F.pow(x, F.lit(float(k))))) / float(p.n))


# -- features ------------------------------------------------------------------------------------------

LN2 = math.log(2.0)
for _name, _build in {
        "mean": lambda p: p.mean, "var": lambda p: p.var, "min": lambda p: p.lo, "max": lambda p: p.hi, "range": lambda p: p.hi - p.lo,
        "skew": lambda p: F.when(p.var > 0, ratio(_moment(p, 3), p.var * F.sqrt(p.var))).otherwise(0.0),
        "kurt": lambda p: F.when(p.var > 0, ratio(_moment(p, 4), p.var * p.var) - 3.0).otherwise(0.0),
        "bits32": lambda p: entropy(p.bins32, p.n) / LN2, "norm16": lambda p: entropy(p.bins16, p.n) / math.log(16.0),
        "unit16": lambda p: entropy(p.unit16, p.n) / math.log(16.0),
        "entropy_sensitivity": lambda p: F.when(entropy(p.unit16, p.n) > 0, F.abs(
            entropy(p.unit16, p.n) - entropy(p.unit16_q8, p.n)) / math.log(16.0)).otherwise(0.0),
        "distinct_values": lambda p: p.levels["k"], "repeated": lambda p: 1.0 - p.levels["k"] / float(p.n),
        "dominant": lambda p: p.levels["top"] / float(p.n), "value_entropy": lambda p: entropy(p.levels, p.n),
        "recurrence": lambda p: 1.0 - p.quanta_runs["k"] / float(p.n), "recurrence_entropy": lambda p: entropy(p.quanta_runs, p.n) / LN2,
        "near_recurrence": lambda p: 1.0 - _near(p.last_seen) / float(p.n),
        "levels_1e5": lambda p: p.fine["k"], "dominant_1e5": lambda p: p.fine["top"] / float(p.n),
        "level_ratio": lambda p: p.coarse["k"] / float(min(p.n, 100)),
        "float32_diff": lambda p: average(F.transform(p.vals, lambda x: F.abs(x - to_float32(x)))),
        "float16_diff": lambda p: average(F.transform(p.vals, lambda x: F.abs(x - to_float16(x)))),
        "run_mean": lambda p: float(p.n) / p.bytes["k"], "runs": lambda p: p.bytes["k"], "runs_per_element": lambda p: p.bytes["k"] / float(p.n),
        "run_std": lambda p: F.sqrt(F.greatest(p.bytes["sq"] / p.bytes["k"] - F.pow(float(p.n) / p.bytes["k"], F.lit(2.0)), F.lit(0.0))),
}.items():
    register(_name, "marginal", _build)
for _name, _build in {
        "grad_mean": lambda p: average(p.steps), "grad_std": lambda p: F.sqrt(spread(p.steps)),
        "lap_mean": lambda p: average(p.curvature), "lap_std": lambda p: F.sqrt(spread(p.curvature)),
        "contrast": lambda p: ratio(F.abs(p.gx2 - p.gy2), p.gx2 + p.gy2, 0.0), "horizontal": lambda p: ratio(p.across2, p.across2 + p.down2, 0.5),
        "directional": lambda p: F.when(p.var < 1e-15, 0.0).otherwise(clamp(F.array_max(p.directions) - total(p.directions) / 3.0, 0.0, 1.0)),
        "edge_density": lambda p: average(F.zip_with(p.gx, p.gy, lambda a, b: F.when(F.abs(a) + F.abs(b) > 0.1, 1.0).otherwise(0.0))),
        "local_variance": _local_variance, "lag1": _flat_lag1, "gradient_energy": lambda p: p.across2 + p.down2, "similarity": _similarity,
        "n_components": lambda p: p.regions["n_components"], "mean_size": lambda p: p.regions["mean_size"], "max_size": lambda p: p.regions["max_size"],
        **{f"row_acf_{k}": (lambda p, k=k: _row_acf(p, k)) for k in range(1, 6)},
}.items():
    register(_name, "field", _build)
for _name, _build in {
        "dct_low": lambda p: ratio(total(F.slice(p.row_energy, 1, p.w // 4)), p.row_total, 0.0),
        "dct_mid": lambda p: ratio(total(F.slice(p.row_energy, p.w // 4 + 1, p.w // 2 - p.w // 4)), p.row_total, 0.0),
        "dct_high": lambda p: ratio(total(F.slice(p.row_energy, p.w // 2 + 1, p.w - p.w // 2)), p.row_total, 0.0),
        "high_low_ratio": lambda p: ratio(total(F.slice(p.row_energy, p.w // 2 + 1, p.w - p.w // 2)), total(F.slice(p.row_energy, 1, p.w // 4)), 0.0),
        "mode_low": lambda p: p.mode_block, "mode_high": lambda p: p.mode_total - p.mode_block,
        "low_share_ac": lambda p: ratio(p.mode_block - F.get(p.mode_energy, 0), p.mode_total - F.get(p.mode_energy, 0), 0.0),
        "row0": lambda p: _above(p.first_row, 0.01, True), "low_modes": lambda p: _above(p.low_modes, 0.1, False),
        "slope": lambda p: p.slope, "peaks": _peaks,
        **{f"concentration_{k}": (lambda p, k=k: ratio(total(F.slice(p.mode_rank, 1, k)), total(p.mode_rank), 0.0)) for k in (1, 3, 10)},
}.items():
    register(_name, "spectral", _build)
