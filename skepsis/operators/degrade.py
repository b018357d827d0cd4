"""Observation degradations: what coarse recording does to values.

Each degradation is a Column function of one cell, `f(c)` with c.v the value, c.idx its index,
c.lo / c.hi the sample's range and c.key the sample id.  The same function runs inside an array
(`degrade_arrays`, no shuffle) or on long cells joined with their range (`degrade_cells`).
User code adds its own with `register_degradation`.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash32, hash_normal, hash_uniform
from ..functions.numeric import clamp, col, half_even, let, trunc
from .scale import names


@dataclass
class Cell:
    v: Column
    idx: Column
    lo: Column
    hi: Column
    key: Column

    @property
    def span(self) -> Column:
        # a flat sample divides by 1
        return F.when(self.hi > self.lo, self.hi - self.lo).otherwise(1.0)


# -- value maps -----------------------------------------------------------------------------------

def to_float32(v) -> Column:
    return col(v).cast("float").cast("double")


def to_decimals(v, places: int = 3) -> Column:
    k = float(10 ** places)
    return half_even(col(v) * k) / k


def exponent2(a) -> Column:
    """floor(log2 a) for a > 0, corrected where log2 rounds across a power of two."""
    e = F.floor(F.log2(a)).cast("double")
    return F.when(F.pow(F.lit(2.0), e + 1.0) <= a, e + 1.0).when(F.pow(F.lit(2.0), e) > a, e - 1.0).otherwise(e)


def to_float16(v) -> Column:
    """IEEE half precision: 11 significant bits, subnormals below 2^-14, clamp at +-65504."""
    x = clamp(v, -65504.0, 65504.0)
    a = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(exponent2(F.greatest(a, F.lit(2.0 ** -24))), F.lit(-14.0)) - 10.0)
    return F.when(a == 0, x).otherwise(clamp(half_even(x / step) * step, -65504.0, 65504.0))


def quantize_minmax(v, lo, span, levels: int) -> Column:
    return trunc((col(v) - lo) / span * float(levels)) / float(levels)


def quantize_fixed(v, lo: float = -1.0, hi: float = 1.0, levels: int = 255) -> Column:
    q = half_even((clamp(v, lo, hi) - lo) / (hi - lo) * float(levels))
    return lo + q / float(levels) * (hi - lo)


def snap_step(v, step: float) -> Column:
    return half_even(col(v) / step) * step


def fixed_point_q15(v) -> Column:
    return clamp(half_even(col(v) * 32768.0), -32768.0, 32767.0) / 32768.0


def nearest_state(v, n: int, half_even_ties: bool = False) -> Column:
    """Nearest of n equally spaced states on [-1, 1]; exact ties go down, or to even."""
    pos = (col(v) + 1.0) * ((n - 1) / 2.0)
    k = half_even(pos) if half_even_ties else F.ceil(pos - 0.5).cast("double")
    return -1.0 + clamp(k, 0.0, float(n - 1)) * (2.0 / (n - 1))


# Ring size and scale of the residue encoding.
RESIDUE_MODULUS, RESIDUE_SCALE = 100003, 50000.0


def residue_fold(v, modulus: int = RESIDUE_MODULUS, scale: float = RESIDUE_SCALE) -> Column:
    q = F.pmod(half_even(col(v) * scale), F.lit(float(modulus)))
    return F.when(q >= float(modulus // 2), q - float(modulus)).otherwise(q) / scale


def periodic_fold(v, step: float = 0.05, bound: float = 0.6) -> Column:
    r = snap_step(v, step)
    inner = F.pmod(r + bound, F.lit(2 * bound)) - bound
    return F.when(F.abs(r) > bound, snap_step(inner, step)).otherwise(r)


def truncate_mantissa(v, bits: int, toward_zero: bool = False) -> Column:
    """Keep `bits` mantissa bits (mantissa in [1/2, 1)), flooring or truncating the rest."""
    x = col(v)
    a = F.abs(x)
    e = exponent2(F.when(a > 0, a).otherwise(1.0)) + 1.0
    unit = F.pow(F.lit(2.0), e - float(bits))
    q = trunc(x / unit) if toward_zero else F.floor(x / unit)
    return F.when(a == 0, 0.0).otherwise(q * unit)


def lut_snap(v, lo, span, n: int = 16) -> Column:
    return lo + clamp(half_even((col(v) - lo) / span * float(n - 1)), 0.0, float(n - 1)) * span / float(n - 1)


def level_quantize(v, lo, span, n: int = 12) -> Column:
    """n levels, each value moved to the lower edge of its level."""
    return lo + clamp(trunc((col(v) - lo) / span * float(n)), 0, n - 1) * span / float(n)


def hash_blend(v, idx, seed, share: float = 0.05) -> Column:
    """(1 - share) of the value plus share of a hash of (seed, index, value at 1e-10)."""
    return col(v) * (1.0 - share) + hash32(seed, idx, F.floor(col(v) * 1e10)) / 4294967295.0 * share


def xor_position(v, idx) -> Column:
    q = trunc(col(v) * 1023.0).bitwiseAND(1023)
    return q.bitwiseXOR((col(idx).cast("bigint") * 7).bitwiseAND(1023)) / 1023.0


def smooth_tanh(v) -> Column:
    return F.tanh(col(v) * 1.001) / 1.001


def smooth_rational(v) -> Column:
    return col(v) / (1.0 + F.abs(col(v)))


def add_noise(v, kind: str, sigma: float, *key) -> Column:
    """Zero-mean noise keyed by `key`: uniform +-sigma or normal with deviation sigma."""
    if kind == "uniform":
        return col(v) + (hash_uniform(*key) - 0.5) * (2.0 * sigma)
    return col(v) + hash_normal(*key) * sigma


# -- registry -------------------------------------------------------------------------------------

DEGRADATIONS: dict[str, Callable[[Cell], Column]] = {
    "none": lambda c: c.v,
    "float32": lambda c: to_float32(c.v),
    "float16": lambda c: to_float16(c.v),
    "decimal3": lambda c: to_decimals(c.v),
    "q255": lambda c: quantize_minmax(c.v, c.lo, c.span, 255),
    "q15": lambda c: quantize_minmax(c.v, c.lo, c.span, 15),
    "uint8": lambda c: quantize_fixed(c.v),
    "step": lambda c: snap_step(c.v, 0.008),
    "q15_fixed": lambda c: fixed_point_q15(c.v),
    "states13": lambda c: nearest_state(c.v, 13),
    "states21": lambda c: nearest_state(c.v, 21, half_even_ties=True),
    "residue": lambda c: residue_fold(c.v),
    "fold": lambda c: periodic_fold(c.v),
    "mantissa5": lambda c: truncate_mantissa(c.v, 5),
    "mantissa3": lambda c: truncate_mantissa(c.v, 3, toward_zero=True),
    "lut16": lambda c: lut_snap(c.v, c.lo, c.span),
    "levels12": lambda c: level_quantize(c.v, c.lo, c.span),
    "noise": lambda c: add_noise(c.v, "uniform", 0.05, 11, c.key, c.idx),
    "gauss": lambda c: add_noise(c.v, "normal", 0.02, 13, c.key, c.idx),
    "hash": lambda c: hash_blend(c.v, c.idx, c.key),
    "xor": lambda c: xor_position(c.v, c.idx),
    "tanh": lambda c: smooth_tanh(c.v),
    "rational": lambda c: smooth_rational(c.v),
}


def register_degradation(name: str, fn: Callable[[Cell], Column]) -> None:
    if name in DEGRADATIONS:
        raise ValueError(f"degradation {name} exists")
    DEGRADATIONS[name] = fn


def array_unit(name: str, vals: Column, key: Column, w: int, h: int) -> Column:
    """The degraded array, row-locally."""
    if name == "none":
        return vals
    if name.startswith("block"):
        return block_sample_array(vals, w, h, int(name[5:]))
    fn = DEGRADATIONS[name]
    span = F.struct(F.array_min(vals).alias("lo"), F.array_max(vals).alias("hi"))
    return let(span, lambda s: F.transform(
        vals, lambda v, i: fn(Cell(v, i, s["lo"], s["hi"], key)).cast("double")))


def degrade_arrays(grids: DataFrame, name: str, w: int, h: int, key: str = "sample_id") -> DataFrame:
    return grids.withColumn("vals", array_unit(name, F.col("vals"), F.col(key), w, h))


def degrade_cells(cells: DataFrame, name: str, key: str = "sample_id") -> DataFrame:
    """Long form for tables that never were arrays: range per sample, joined back."""
    span = cells.groupBy(key).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    c = Cell(F.col("v"), F.col("idx"), F.col("_lo"), F.col("_hi"), F.col(key))
    return cells.join(span, key).withColumn("v", DEGRADATIONS[name](c).cast("double")).drop("_lo", "_hi")


def block_sample_array(vals, w: int, h: int, block: int = 4) -> Column:
    """Every cell takes the value at its block's centre (clipped to the field)."""
    def pick(v, i):
        y, x = F.floor(i / w), i % w
        cy = F.least(F.floor(y / block) * block + block // 2, F.lit(h - 1))
        cx = F.least(F.floor(x / block) * block + block // 2, F.lit(w - 1))
        return F.get(vals, (cy * w + cx).cast("int"))
    return F.transform(vals, pick)


def avg_pool(cells: DataFrame, keys, k: int = 2) -> DataFrame:
    """Mean of k x k blocks; the coarse cell keeps (y, x) in block units."""
    return cells.groupBy(*names(keys), F.floor(F.col("y") / k).alias("y"), F.floor(F.col("x") / k).alias("x")).agg(
        F.avg("v").alias("v"))


def subsample_time(frames: DataFrame, key: str, k: int, t: str = "t") -> DataFrame:
    """Every k-th frame (counting from the first, t = 1) plus the last one."""
    last = frames.groupBy(key).agg(F.max(t).alias("_last"))
    return frames.join(last, key).filter(((F.col(t) - 1) % k == 0) | (F.col(t) == F.col("_last"))).drop("_last")


# -- discreteness features of arrays ----------------------------------------------------------------

def run_summary(vals: Column) -> Column:
    """Runs of equal neighbours of an array of doubles: k runs, the longest one, sums of n ln n and of n^2 over run lengths n."""
    def closed(a):
        run = a["run"].cast("double")
        return a["s"] + F.when(a["run"] > 0, run * F.ln(run)).otherwise(0.0)

    def step(a, x):
        same = (a["run"] > 0) & (a["prev"] == x)
        run = F.when(same, a["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(x.alias("prev"), run.alias("run"), (a["k"] + F.when(same, 0).otherwise(1)).cast("bigint").alias("k"),
                        F.greatest(a["top"], run).alias("top"), F.when(same, a["s"]).otherwise(closed(a)).alias("s"),
                        (a["sq"] + 2 * run - 1).cast("bigint").alias("sq"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(0.0).alias("prev"), zero.alias("run"), zero.alias("k"), zero.alias("top"), F.lit(0.0).alias("s"), zero.alias("sq"))
    return F.aggregate(vals, start, step, lambda a: F.struct(
        a["k"].cast("double").alias("k"), a["top"].cast("double").alias("top"), closed(a).alias("s"), a["sq"].cast("double").alias("sq")))


def discreteness_features(grids: DataFrame, keys) -> DataFrame:
    """distinct values, repeated share, largest share and value entropy per sample, long.

    One sorted pass over the array counts its runs of equal values, so nothing is shuffled.
    """
    keys = names(keys)
    n = F.size("vals").cast("double")
    d = grids.select(*keys, n.alias("_n"), run_summary(F.array_sort("vals")).alias("_a"))
    arms = F.array(*[F.struct(F.lit(m).alias("name"), e.alias("value")) for m, e in (
        ("distinct_values", F.col("_a.k")), ("repeated", 1.0 - F.col("_a.k") / F.col("_n")), ("dominant", F.col("_a.top") / F.col("_n")),
        ("value_entropy", F.ln("_n") - F.col("_a.s") / F.col("_n")))])
    return d.select(*keys, F.explode(arms).alias("_f")).select(*keys, "_f.name", "_f.value")
