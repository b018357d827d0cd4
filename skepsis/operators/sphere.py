"""Directional clustering against isotropy, with the search over orientations inside the null.

A rotation pool is rows of a 3x3 matrix; its size is a plan parameter.  Tasks hold the pool and weigh runs of
events against it.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.hashing import hash_normal, hash_uniform
from ..functions.numeric import clamp, col
from .resample import empirical_p
from .scale import grouper, names, replicate, spread

# Fixed values of the published protocol.
KERNEL_DELTA_DEG, MIN_EVENTS, ALPHA = 8.0, 30, 0.05
RUN = 4096
MATRIX = [f"m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


def radec_to_unit(ra, dec) -> list[Column]:
    r, d = F.radians(col(ra)), F.radians(col(dec))
    return [F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)]


def unit_to_radec(x, y, z) -> list[Column]:
    return [F.pmod(F.degrees(F.atan2(col(y), col(x))), F.lit(360.0)), F.degrees(F.asin(clamp(z, -1.0, 1.0)))]


def normalize(x, y, z) -> list[Column]:
    """Unit vector; the zero vector stays as it is."""
    n = F.sqrt(col(x) * col(x) + col(y) * col(y) + col(z) * col(z))
    n = F.coalesce(F.nullif(n, F.lit(0.0)), F.lit(1.0))
    return [col(x) / n, col(y) / n, col(z) / n]


def energy_cut(df: DataFrame, cut: float, energy: str = "energy") -> DataFrame:
    """Only a known energy below the cut removes a row."""
    return df.filter(F.col(energy).isNull() | (F.col(energy) >= cut))


def angle_acos(a: list, b: list) -> Column:
    return F.acos(clamp(sum(col(x) * col(y) for x, y in zip(a, b)), -1.0, 1.0))


def angle_chord(a: list, b: list) -> Column:
    """Well conditioned near zero: 2 asin(chord / 2)."""
    sq = None
    for x, y in zip(a, b):
        t = (col(x) - col(y)) * (col(x) - col(y))
        sq = t if sq is None else sq + t
    return 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(sq) / 2.0))


def direction(*key) -> list[Column]:
    """Uniform unit vector keyed by `key`."""
    z = 2.0 * hash_uniform(*key, "z") - 1.0
    phi = 2.0 * math.pi * hash_uniform(*key, "p")
    r = F.sqrt(F.greatest(1.0 - z * z, F.lit(0.0)))
    return [r * F.cos(phi), r * F.sin(phi), z]


def euler_matrix(a, b, c) -> dict:
    """Rz(c) Ry(b) Rx(a)."""
    ca, sa, cb, sb, cc, sc = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    return {"m11": cb * cc, "m12": sa * sb * cc - ca * sc, "m13": ca * sb * cc + sa * sc,
            "m21": cb * sc, "m22": sa * sb * sc + ca * cc, "m23": ca * sb * sc - sa * cc,
            "m31": -sb, "m32": cb * sa, "m33": cb * ca}


def with_rotation(df: DataFrame, *key) -> DataFrame:
    """Add matrix columns drawn from `key` (angles first, so that each is hashed once per row)."""
    pi = math.pi
    d = df.withColumns({"_ea": 2 * pi * hash_uniform(*key, "a"), "_eb": pi * hash_uniform(*key, "b"), "_ec": 2 * pi * hash_uniform(*key, "c")})
    return d.withColumns(euler_matrix(F.col("_ea"), F.col("_eb"), F.col("_ec"))).drop("_ea", "_eb", "_ec")


def rotation_pool(spark, n: int, seed) -> DataFrame:
    ids = spark.range(n).withColumnRenamed("id", "rot_id")
    return with_rotation(ids, seed, F.col("rot_id"))


def frame_axes(rotations: DataFrame) -> DataFrame:
    """The six signed columns of every matrix."""
    arms = F.array(*[F.struct(F.lit(j).alias("axis"), F.lit(s).alias("sign"), *[(s * F.col(f"m{i}{j}")).alias(n) for i, n in ((1, "ax"), (2, "ay"), (3, "az"))])
                     for j in (1, 2, 3) for s in (1, -1)])
    return rotations.select("rot_id", F.explode(arms).alias("a")).select("rot_id", "a.*")


#: kernel values that a task holds at once
BLOCK = 1 << 15


def axis_score(events: DataFrame, rotations: DataFrame, n_rot: int, keys=("sky_id",), delta_deg: float = KERNEL_DELTA_DEG) -> DataFrame:
    """(keys, rot_id, score, n): mean kernel weight of the nearest of six axes.

    The nearest of +-axis is the larger |dot|, so three dot products replace six.  The pool (`n_rot` rows, a plan parameter) rides
    along with the tasks, which weigh short runs of events against all of it and add up each sky's weights: the shuffle carries skies x
    rotations, not events.  A missing direction weighs 1, like one on an axis.
    """
    keys = names(keys)
    e = events.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("ux", "uy", "uz")])
    pool = rotations.filter(F.col("rot_id").between(0, n_rot - 1)).select("rot_id", *[F.col(m).cast("double") for m in MATRIX]).orderBy("rot_id").collect()
    ids, m = np.array([r[0] for r in pool], np.int64), np.array([r[1:] for r in pool], float).reshape(len(pool), 3, 3)

    grouped, rows = grouper(), max(1, BLOCK // max(1, len(ids)))

    def weights(u):
        dots = [np.abs(u[0] * m[:, 0, k] + u[1] * m[:, 1, k] + u[2] * m[:, 2, k]) for k in range(3)]
        c = np.fmin(1.0, np.maximum(np.maximum(dots[0], dots[1]), dots[2]))
        return np.exp(-0.5 * np.square(np.arccos(c) / math.radians(delta_deg)))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows if len(ids) else 0, rows):
                b = whole.slice(at, rows)
                order, starts = grouped(b, len(keys))
                w = weights([c.to_numpy(zero_copy_only=False)[order, None] for c in b.columns[len(keys):]])
                key = b.take(pa.array(np.repeat(order[starts], len(ids)))).columns[:len(keys)]
                yield pa.RecordBatch.from_arrays([*key, pa.array(np.tile(ids, len(starts))), pa.array(np.add.reduceat(w, starts, axis=0).ravel()),
                                                  pa.array(np.repeat(np.diff(starts, append=len(order)), len(ids)))], names=[*keys, "rot_id", "_w", "_n"])

    made = StructType([*e.schema.fields[:len(keys)], StructField("rot_id", LongType()), StructField("_w", DoubleType()), StructField("_n", LongType())])
    n = F.sum("_n")
    return e.mapInArrow(run, made).groupBy(*keys, "rot_id").agg((F.sum("_w") / n).alias("score"), n.alias("n"))


def alignment_statistic(scores: DataFrame, keys=("sky_id",)) -> DataFrame:
    """Best orientation per sky, ties to the smaller id."""
    k = names(keys)
    return scores.groupBy(*k).agg(F.max(F.struct("score", (-F.col("rot_id")).alias("_r"))).alias("_b"), F.max("n").alias("n")).select(
        *k, F.col("_b.score").alias("stat"), (-F.col("_b._r")).alias("rot_id"), "n")


def numbered_events(skies: DataFrame, n: Column, keys) -> DataFrame:
    """A row for each event 0 .. n - 1 of every row of `skies`; runs of `RUN` events are dealt over all tasks, so that neither few nor large skies make a task long."""
    last = n.cast("bigint") - 1
    d = skies.filter(n > 0).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / RUN))))
    d = spread(d, *names(keys), "_run")
    return d.withColumn("event_id", F.explode(F.sequence(F.col("_run") * RUN, F.least(last, F.col("_run") * RUN + (RUN - 1))))).drop("_run")


def isotropic_events(skies: DataFrame, n_events, keys, seed) -> DataFrame:
    """`n_events` uniform directions for every row of `skies` (a number or a column)."""
    keys = names(keys)
    d = numbered_events(skies, n_events if isinstance(n_events, Column) else F.lit(n_events), keys)
    key = [seed] + [F.col(k) for k in keys] + [F.col("event_id")]
    d = d.withColumns({"_z": 2.0 * hash_uniform(*key, "z") - 1.0, "_p": 2.0 * math.pi * hash_uniform(*key, "p")})
    r = F.sqrt(F.greatest(1.0 - F.col("_z") * F.col("_z"), F.lit(0.0)))
    return d.withColumns({"ux": r * F.cos("_p"), "uy": r * F.sin("_p"), "uz": F.col("_z")}).drop("_z", "_p")


def isotropic_null(skies: DataFrame, n_events, rotations: DataFrame, n_rot: int, n_null: int, seed, keys=("sky_id",)) -> DataFrame:
    """(keys, null_id, stat): fresh uniform skies scored over the same pool, so the look-elsewhere
    effect is in the null."""
    keys = names(keys)
    d = replicate(skies.select(*keys, *(["n_events"] if "n_events" in skies.columns else [])), n_null, "null_id")
    ev = isotropic_events(d, n_events, keys + ["null_id"], seed)
    return alignment_statistic(axis_score(ev, rotations, n_rot, keys + ["null_id"]), keys + ["null_id"])


def score_catalogue(events: DataFrame, n_rot: int, n_null: int, seed, null_keys=("n_events",)) -> DataFrame:
    """Statistic, p-value, z and verdict per sky.  A sky of fewer than `MIN_EVENTS` events has the verdict
    TOO_FEW_EVENTS and no statistic.

    Skies of equal size share one null, keyed by the number of events.
    """
    spark = events.sparkSession
    every = events.groupBy("sky_id").agg(F.count(F.lit(1)).alias("n_events"))
    size = every.filter(F.col("n_events") >= MIN_EVENTS)
    pool = rotation_pool(spark, n_rot, seed)
    obs = alignment_statistic(axis_score(events.join(size, "sky_id", "left_semi"), pool, n_rot)).join(size, "sky_id")
    sizes = size.select("n_events").distinct()
    null = isotropic_null(sizes, F.col("n_events"), pool, n_rot, n_null, f"{seed}n", ["n_events"])
    p = empirical_p(null.join(size, "n_events").select("sky_id", "stat"), obs.withColumnRenamed("stat", "observed"), "sky_id")
    return every.join(p, "sky_id", "left").withColumn("verdict", F.when(F.col("n_events") < MIN_EVENTS, "TOO_FEW_EVENTS").when(
        F.col("p_value") < ALPHA, "SIGNATURE_DETECTED").otherwise("NO_SIGNATURE"))


def type1_calibration(null: DataFrame, fresh: DataFrame) -> DataFrame:
    """False-positive rates of fresh isotropic skies against a shared null, and their median p.

    p needs only the number of null values at or above a statistic: both tables are ranked together.
    """
    from .scale import value_ranks
    both = null.select(F.lit(0).alias("g"), F.col("stat")).unionByName(fresh.select(F.lit(0).alias("g"), "stat"))
    r = value_ranks(both, "g", "stat").select("stat", "below", "total")
    rn = value_ranks(fresh.select(F.lit(0).alias("g"), "stat"), "g", "stat").select("stat", F.col("below").alias("fresh_below"), F.col("n_at"), F.col("total").alias("n_fresh"))
    j = rn.join(r, "stat")
    n_null = F.col("total") - F.col("n_fresh")
    ge = n_null - (F.col("below") - F.col("fresh_below"))
    j = j.withColumn("p", (ge + 1) / (n_null + 1))
    n = F.sum("n_at")
    rate = lambda a: F.sum(F.when(F.col("p") < a, F.col("n_at")).otherwise(0)) / n
    # the upper-middle p in ascending order is the statistic at descending rank n // 2
    above = F.col("n_fresh") - F.col("fresh_below") - F.col("n_at")
    mid = F.max(F.when((above <= F.floor(F.col("n_fresh") / 2)) & (F.floor(F.col("n_fresh") / 2) < above + F.col("n_at")), F.col("p")))
    return j.agg(n.alias("n_tries"), rate(0.01).alias("fpr_01"), rate(0.05).alias("fpr_05"), rate(0.10).alias("fpr_10"), mid.alias("median_p"))


def clustered_events(skies: DataFrame, n_events, keys, seed, width_deg: Column, share: Column) -> DataFrame:
    """Control skies: a `share` of events scatters by `width_deg` around the axes of a hidden rotation."""
    keys = names(keys)
    sky = [seed] + [F.col(k) for k in keys]
    d = numbered_events(with_rotation(skies, *sky, "rot"), n_events if isinstance(n_events, Column) else F.lit(n_events), keys)
    key = sky + [F.col("event_id")]
    tx, ty, tz = direction(*key, "t")
    d = d.withColumns({"_on": hash_uniform(*key, "on") < share, "_ax": F.floor(6.0 * hash_uniform(*key, "ax")), "_tx": tx, "_ty": ty, "_tz": tz,
                       "_ang": hash_normal(*key, "g") * F.radians(width_deg)})
    j = F.floor(F.col("_ax") / 2)
    sg = F.when(F.col("_ax") % 2 == 0, 1.0).otherwise(-1.0)
    axis = lambda i: sg * F.when(j == 0, F.col(f"m{i}1")).when(j == 1, F.col(f"m{i}2")).otherwise(F.col(f"m{i}3"))
    d = d.withColumns({"_a1": axis(1), "_a2": axis(2), "_a3": axis(3)})
    d = d.withColumn("_dot", F.col("_a1") * F.col("_tx") + F.col("_a2") * F.col("_ty") + F.col("_a3") * F.col("_tz"))
    px, py, pz = normalize(*[F.col(f"_t{c}") - F.col("_dot") * F.col(f"_a{i}") for i, c in ((1, "x"), (2, "y"), (3, "z"))])
    d = d.withColumns({"_px": px, "_py": py, "_pz": pz})
    vx, vy, vz = normalize(*[F.col(f"_a{i}") + F.col("_ang") * F.col(f"_p{c}") for i, c in ((1, "x"), (2, "y"), (3, "z"))])
    pick = lambda v, t: F.when(F.col("_on"), v).otherwise(F.col(t))
    return d.select(*skies.columns, "event_id", pick(vx, "_tx").alias("ux"), pick(vy, "_ty").alias("uy"), pick(vz, "_tz").alias("uz"))


def power_scan(grid: DataFrame, reps: int, n_events: Column, null: DataFrame, rotations: DataFrame, n_rot: int, seed) -> DataFrame:
    """Detection rate per parameter row (width_deg, share).  All rows and replicates are one job."""
    ks = [c for c in grid.columns]
    s = replicate(grid, reps)
    ev = clustered_events(s, n_events, ks + ["rep"], seed, F.col("width_deg"), F.col("share"))
    stat = alignment_statistic(axis_score(ev, rotations, n_rot, ks + ["rep"]), ks + ["rep"])
    # p < alpha holds exactly when fewer than alpha*(n+1) - 1 null values reach the statistic, so the
    # decision is a comparison with one order statistic of the null
    from .scale import value_ranks
    r = value_ranks(null.select(F.lit(0).alias("g"), "stat"), "g", "stat")
    cut = r.filter((F.col("total") - F.col("below") + 1) / (F.col("total") + 1) >= ALPHA).agg(F.max("stat").alias("c")).scalar()
    return stat.groupBy(*ks).agg(F.count(F.lit(1)).alias("reps"), F.avg(F.when(F.col("stat") > cut, 1.0).otherwise(0.0)).alias("power"))


def sphere_uniformity(events: DataFrame, keys=("sky_id",)) -> DataFrame:
    x, y, z = F.col("ux"), F.col("uy"), F.col("uz")
    return events.groupBy(*names(keys)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.avg(x * x).alias("xx"),
        F.avg(y * y).alias("yy"), F.avg(z * z).alias("zz"), F.avg(x * y).alias("xy"), F.avg(x * z).alias("xz"), F.avg(y * z).alias("yz"))


def rotation_check(rotations: DataFrame) -> DataFrame:
    """Worst |M M^T - I|, determinant range and worst deviation of the axes from a right angle."""
    m = {(i, j): F.col(f"m{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)}
    res = [F.abs(m[i, 1] * m[j, 1] + m[i, 2] * m[j, 2] + m[i, 3] * m[j, 3] - (1.0 if i == j else 0.0)) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    det = (m[1, 1] * (m[2, 2] * m[3, 3] - m[2, 3] * m[3, 2]) - m[1, 2] * (m[2, 1] * m[3, 3] - m[2, 3] * m[3, 1])
           + m[1, 3] * (m[2, 1] * m[3, 2] - m[2, 2] * m[3, 1]))
    ang = [F.abs(F.degrees(F.acos(clamp(m[1, a] * m[1, b] + m[2, a] * m[2, b] + m[3, a] * m[3, b], -1.0, 1.0))) - 90.0) for a, b in ((1, 2), (1, 3), (2, 3))]
    return rotations.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(*res)).alias("max_residual"), F.min(det).alias("det_min"),
                         F.max(det).alias("det_max"), F.max(F.greatest(*ang)).alias("max_angle_error"))
