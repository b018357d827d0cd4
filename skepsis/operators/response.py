"""Algebra of responses(world, role, t, idx, v): is R(A+B) the sum of R(A) and R(B)?"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import ratio
from .scale import names

EPS = 1e-12


def response_norms(r: DataFrame, world="world_id") -> DataFrame:
    return r.groupBy(*names(world), "role", "t").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def norm_features(r: DataFrame, world="world_id") -> DataFrame:
    """Final norm, energy (sum of norms) and decay (final over second frame)."""
    n = response_norms(r, world)
    k = names(world) + ["role"]
    # the second smallest t is the minimum of those above the first
    first = n.groupBy(*k).agg(F.min("t").alias("_t0"))
    a = n.join(first, k).groupBy(*k).agg(
        F.max_by("norm", "t").alias("mag_final"), F.sum("norm").alias("energy"),
        F.min(F.when(F.col("t") > F.col("_t0"), F.struct("t", "norm"))).alias("_s"))
    n0 = F.coalesce(F.col("_s.norm"), F.col("mag_final"))
    return a.select(*k, "mag_final", "energy", (F.col("mag_final") / F.when(n0 > EPS, n0).otherwise(EPS)).alias("decay"))


def wide(r: DataFrame, roles: list[str], world="world_id") -> DataFrame:
    """One row per cell with a column per role; an absent role is 0.  One aggregation, roles given."""
    return r.filter(F.col("role").isin(roles)).groupBy(*names(world), "t", "idx").agg(
        *[F.sum(F.when(F.col("role") == x, F.col("v")).otherwise(0.0)).alias(x) for x in roles])


def final(df: DataFrame, world="world_id") -> DataFrame:
    last = df.groupBy(*names(world)).agg(F.max("t").alias("t"))
    return df.join(last, names(world) + ["t"], "left_semi")


def _norm(e: Column) -> Column:
    return F.sqrt(F.sum(e * e))


def superposition_err(r: DataFrame, a: str = "A", b: str = "B", ab: str = "AB", world="world_id") -> DataFrame:
    """Final and pathwise norm(AB - A - B) / norm(AB)."""
    k = names(world)
    gap = F.col(ab) - F.col(a) - F.col(b)
    t = wide(r, [a, b, ab], world).groupBy(*k, "t").agg(_norm(gap).alias("_g"), _norm(F.col(ab)).alias("_n"))
    g = t.groupBy(*k).agg(F.max_by("_g", "t").alias("_gf"), F.max_by("_n", "t").alias("_nf"), F.sum("_g").alias("_gs"), F.sum("_n").alias("_ns"))
    return g.select(*k, (F.col("_gf") / (F.col("_nf") + EPS)).alias("superposition_err"), (F.col("_gs") / (F.col("_ns") + EPS)).alias("superposition_path"))


def relative_err(r: DataFrame, numerator: dict, reference: str, out: str, world="world_id") -> DataFrame:
    """norm(sum of coefficient * role) / norm(reference) at the last frame.

    Symmetry is {single: 1, opposite: 1}, path dependence {ABC: 1, ABthenC: -1}, composition
    {ABC: 1, AB: -1, C: -1}.
    """
    k = names(world)
    roles = list(dict.fromkeys([*numerator, reference]))
    f = final(wide(r, roles, world), world)
    e = None
    for x, c in numerator.items():
        t = c * F.col(x)
        e = t if e is None else e + t
    return f.groupBy(*k).agg((_norm(e) / (_norm(F.col(reference)) + EPS)).alias(out))


def repeatability_err(r: DataFrame, a: str, b: str, world="world_id") -> DataFrame:
    f = final(wide(r, list(dict.fromkeys([a, b])), world), world)
    return f.groupBy(*names(world)).agg(_norm(F.col(a) - F.col(b)).alias("repeatability_err"))


def locality(r: DataFrame, y: Column, x: Column, centre: tuple, radius: int = 3, floor: float = 1e-4, world="world_id") -> DataFrame:
    """Share of the final |response| within a Chebyshev radius, and the farthest responding radius."""
    f = final(r, world)
    d = F.greatest(F.abs(x - centre[1]), F.abs(y - centre[0]))
    a = F.abs(F.col("v"))
    return f.groupBy(*names(world)).agg(
        (F.sum(F.when(d <= radius, a).otherwise(0.0)) / (F.sum(a) + EPS)).alias("locality"),
        F.coalesce(F.max(F.when(a > floor, d)), F.lit(0)).alias("speed"))


ROLES = ["A", "B", "AB", "opposite", "AB_copy"]


def collisions(finals: DataFrame, world="world_id", tol: float = 1e-9, roles: list[str] = ROLES) -> DataFrame:
    """Interventions whose final responses coincide, as a share of all interventions of a world.

    A role is merged if its response lies within tol (Euclidean norm of the difference) of an earlier role's.  The roles are a
    plan parameter: their responses stand side by side per cell, and one aggregation per world adds up the squared differences.
    """
    k = names(world)
    w = finals.filter(F.col("role").isin(roles)).groupBy(*k, "idx").agg(
        *[F.sum(F.when(F.col("role") == x, F.col("v"))).alias(f"r{i}") for i, x in enumerate(roles)])
    value = lambda i: F.coalesce(F.col(f"r{i}"), F.lit(0.0))
    n = len(roles)
    g = w.groupBy(*k).agg(*[F.count(f"r{i}").alias(f"n{i}") for i in range(n)],
                          *[F.sqrt(F.sum((value(i) - value(j)) * (value(i) - value(j)))).alias(f"d{i}_{j}") for j in range(n) for i in range(j)])
    here = [F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in range(n)]
    merged = F.lit(0)
    for j in range(1, n):
        near = F.lit(False)
        for i in range(j):
            near = near | ((F.col(f"n{i}") > 0) & (F.col(f"d{i}_{j}") <= tol))
        merged = merged + F.when((F.col(f"n{j}") > 0) & near, 1).otherwise(0)
    total = here[0]
    for h in here[1:]:
        total = total + h
    return g.select(*k, total.cast("bigint").alias("interventions"), merged.cast("bigint").alias("merged")).withColumn("collision", F.col("merged") / F.col("interventions"))


def effective_rank(finals: DataFrame, roles: list[str], world="world_id", eps: float = 1e-9) -> DataFrame:
    """Rank of the roles x cells matrix over the number of roles.

    A world's matrix is one row (its cells are those of one field, its roles a plan parameter).  Roles are scaled to norm 1
    and eliminated with the largest remaining one as pivot; pivots above `eps` count.  The matrix itself is
    eliminated, not its Gram matrix, which would lose half the digits.
    """
    k = names(world)
    w = finals.filter(F.col("role").isin(roles)).groupBy(*k, "idx").agg(
        *[F.sum(F.when(F.col("role") == x, F.col("v")).otherwise(0.0)).alias(f"r{i}") for i, x in enumerate(roles)])
    n = len(roles)
    g = w.groupBy(*k).agg(F.flatten(F.array_sort(F.collect_list(F.array(*[F.col(f"r{i}") for i in range(n)])))).alias("m"))

    @F.pandas_udf("int")
    def rank(m: pd.Series) -> pd.Series:
        import numpy as np

        def one(flat):
            a = np.asarray(flat, float).reshape(-1, n).T.copy()
            norm = np.sqrt((a * a).sum(1))
            a /= np.where(norm < eps, 1.0, norm)[:, None]
            found = 0
            for _ in range(n):
                norm = np.sqrt((a * a).sum(1))
                p = int(norm.argmax())
                if norm[p] <= eps:
                    break
                found += 1
                q = a[p] / norm[p]
                for _ in range(2):                      # twice is enough against rounding
                    a -= np.outer(a @ q, q)
                a[p] = 0.0
            return found
        return pd.Series([one(x) for x in m], dtype="int32")
    return g.select(*k, rank("m").cast("bigint").alias("rank")).withColumn("eff_rank", F.col("rank") / float(n))


RANK_ROLES = ["A", "B", "C", "AB", "opposite", "ABC", "ABthenC"]
FEATURES = ["mag_final", "energy", "decay", "locality", "speed", "superposition_err", "superposition_path", "symmetry_err", "path_dependence",
            "composition_err", "repeatability_err", "recurrence", "collision", "eff_rank"]


def operator_features(r: DataFrame, y: Column, x: Column, centre: tuple, radius: int = 3, world="world_id", floor: float = 1e-4,
                      decimals: int = 9, floor_norm: float = 1e-6) -> DataFrame:
    """The fourteen response features, long (name, value), NULL values left out.

    Roles: single interventions A, B, C, their joint ones AB and ABC, `opposite` of A, ABthenC (C applied to the
    response of AB) and AB_again (AB measured once more).  A role that a cell lacks is 0 there.  Twelve features come from one chain of
    aggregations (cell, frame, world); `recurrence` is the share of the frames of A above floor_norm whose rounded state
    occurred before.  A frame's state is as long as a field.
    """
    k = names(world)
    roles = [*RANK_ROLES, "AB_again"]
    c = {role: F.col(role) for role in roles}
    sums = [F.sum(F.when(F.col("role") == role, F.col("v")).otherwise(0.0)).alias(role) for role in roles]
    w = r.filter(F.col("role").isin(roles)).groupBy(*k, "t", "idx").agg(*sums, F.max(y).alias("_y"), F.max(x).alias("_x"))
    d = F.greatest(F.abs(F.col("_x") - centre[1]), F.abs(F.col("_y") - centre[0]))
    size = F.abs(c["A"])
    scale_ = float(10 ** decimals)
    p = w.groupBy(*k, "t").agg(
        _norm(c["A"]).alias("a"), _norm(c["AB"]).alias("ab"), _norm(c["ABC"]).alias("abc"), _norm(c["AB"] - c["A"] - c["B"]).alias("sup"),
        _norm(c["A"] + c["opposite"]).alias("sym"), _norm(c["ABC"] - c["ABthenC"]).alias("path"), _norm(c["ABC"] - c["AB"] - c["C"]).alias("comp"),
        _norm(c["AB"] - c["AB_again"]).alias("rep"), F.sum(F.when(d <= radius, size).otherwise(0.0)).alias("near"), F.sum(size).alias("tot"),
        F.coalesce(F.max(F.when(size > floor, d)), F.lit(0)).alias("far"),
        F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("idx", F.floor(c["A"] * scale_ + 0.5).alias("s"))))), 256).alias("state"))
    p = p.withColumn("_t0", F.min("t").over(W.partitionBy(*k)))
    at_end = lambda name: F.max_by(name, "t")
    live = F.when(F.col("a") > floor_norm, F.col("state"))
    g = p.groupBy(*k).agg(
        *[at_end(n).alias(n) for n in ("a", "ab", "abc", "sup", "sym", "path", "comp", "rep", "near", "tot", "far")], F.sum("a").alias("energy"), F.sum("sup").alias("sup_all"),
        F.sum("ab").alias("ab_all"), F.min(F.when(F.col("t") > F.col("_t0"), F.struct("t", "a")))["a"].alias("second"),
        F.count(live).alias("live"), F.count_distinct(live).alias("states"))
    over = lambda num, den: F.col(num) / (F.col(den) + EPS)
    out = {"mag_final": F.col("a"), "energy": F.col("energy"), "decay": F.col("a") / F.greatest(F.coalesce("second", "a"), F.lit(EPS)),
           "locality": over("near", "tot"), "speed": F.col("far").cast("double"), "superposition_err": over("sup", "ab"), "superposition_path": over("sup_all", "ab_all"),
           "symmetry_err": over("sym", "a"), "path_dependence": over("path", "abc"), "composition_err": over("comp", "abc"), "repeatability_err": F.col("rep"),
           "recurrence": ratio(F.col("live") - F.col("states"), "live", 0.0)}
    f = final(r, world)
    pieces = [g.select(*k, *[e.alias(n) for n, e in out.items()]).unpivot(k, list(out), "name", "value"),
              collisions(f, world).select(*k, F.lit("collision").alias("name"), F.col("collision").alias("value")),
              effective_rank(f, RANK_ROLES, world).select(*k, F.lit("eff_rank").alias("name"), F.col("eff_rank").alias("value"))]
    return pieces[0].unionByName(pieces[1]).unionByName(pieces[2]).filter("value is not null")


def equivalence_check(a: DataFrame, b: DataFrame, keys, eps: float = 1e-9) -> DataFrame:
    """Does an independent computation of the same features tie everywhere (hit 1/2)?"""
    k = names(keys)
    d = a.select(*k, "name", F.col("value").alias("d")).unionByName(b.select(*k, "name", (-F.col("value")).alias("d")))
    d = d.groupBy(*k, "name").agg(F.sum("d").alias("d")).groupBy(*k).agg(F.max(F.abs(F.col("d"))).alias("max_abs"))
    return d.withColumn("hit", F.when(F.col("max_abs") < eps, 0.5))
