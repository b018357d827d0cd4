"""Parameter sweeps, controls and selection."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scale import dense_position, names


def grid_points(df: DataFrame, domain: tuple, g: int) -> DataFrame:
    """Attach every grid point to every row, row-locally."""
    x0, x1, y0, y1 = domain
    at = lambda lo, hi, n: float(lo) + (float(hi) - float(lo)) * n / float(max(g - 1, 1))
    pts = F.array(*[F.struct(F.lit(at(x0, x1, i)).alias("gx"), F.lit(at(y0, y1, j)).alias("gy")) for j in range(g) for i in range(g)])
    return df.withColumn("_p", F.explode(pts)).withColumns({"gx": F.col("_p.gx"), "gy": F.col("_p.gy")}).drop("_p")


def topk_distinct(log: DataFrame, k: int, point=("cr", "ci"), decimals: int = 6, score: str = "score", tie: str = "candidate_id") -> DataFrame:
    """Best k rows after points equal at `decimals` collapse to their best row."""
    f = float(10 ** decimals)
    key = [F.floor(F.col(p) * f + 0.5).alias(f"_{p}") for p in point]
    b = F.max(F.struct(F.col(score), (-F.col(tie)).alias("_t"), *[F.col(p) for p in point]))
    g = log.filter(F.col(score).isNotNull()).groupBy(*key).agg(b.alias("_b"))
    return g.select((-F.col("_b._t")).alias(tie), F.col(f"_b.{score}").alias(score), *[F.col(f"_b.{p}").alias(p) for p in point]).orderBy(
        F.desc(score), tie).limit(k)


def stratified_starts(points: DataFrame, domain: tuple, x: str = "cr", y: str = "ci", id: str = "candidate_id", per_quadrant: int = 2) -> DataFrame:
    """Starting points spread over the four quadrants: in each, `per_quadrant` (or all, if fewer) evenly spaced in (x, y) order."""
    x0, x1, y0, y1 = domain
    q = F.when(F.col(x) > (x0 + x1) / 2, 1).otherwise(0) + F.when(F.col(y) > (y0 + y1) / 2, 2).otherwise(0)
    width = (x1 - x0) / 1024.0
    d = dense_position(points.select(id, x, y, q.alias("quadrant")), "quadrant", [x, y, id], F.floor((F.col(x) - x0) / width), out="_r")
    n = d.groupBy("quadrant").agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / per_quadrant))
    at = F.col("_r") - 1
    d = d.join(n, "quadrant").filter((at % step == 0) & (F.floor(at / step) < per_quadrant))
    return d.select("quadrant", id, x, y)


def contrast_table(scores: DataFrame, keys, rules: dict, name: str = "name", score: str = "score") -> DataFrame:
    """rules: contrast -> (name, 'max' | 'mean', [reference names]); value = score - max / mean."""
    ns = sorted({n for a, _, bs in rules.values() for n in [a, *bs]})
    p = scores.filter(F.col(name).isin(ns)).groupBy(*names(keys)).agg(
        *[F.max(F.when(F.col(name) == n, F.col(score))).alias(f"_{n}") for n in ns])
    out = []
    for c, (a, how, bs) in rules.items():
        refs = [F.col(f"_{b}") for b in bs]
        mean = None
        for r in refs:
            mean = r if mean is None else mean + r
        ref = (F.greatest(*refs) if len(refs) > 1 else refs[0]) if how == "max" else mean / float(len(refs))
        out.append((F.col(f"_{a}") - ref).alias(c))
    return p.select(*names(keys), *out)


def uplifts(scores: DataFrame, keys, base: str, controls: list[str], name: str = "name", score: str = "score") -> DataFrame:
    """Difference of the base score to every named control, as rows."""
    b = scores.filter(F.col(name) == base).select(*names(keys), F.col(score).alias("_b"))
    c = scores.filter(F.col(name).isin(controls))
    return c.join(b, names(keys)).select(*names(keys), F.col(name).alias("control"), (F.col("_b") - F.col(score)).alias("uplift"))


def controls_at_best(log: DataFrame, run: str = "run_id", model: str = "model", x: str = "cr", y: str = "ci", tol: float = 1e-6, order: str = "candidate_id") -> DataFrame:
    """Rows at the best point of each run within tol, the last one per model."""
    best = log.filter((F.col("status") == "OK") & F.col("score").isNotNull()).groupBy(run).agg(
        F.max(F.struct(F.col("score"), (-F.col(order)).alias("_t"), F.col(x), F.col(y))).alias("_b"))
    j = log.join(best, run).filter((F.abs(F.col(x) - F.col(f"_b.{x}")) < tol) & (F.abs(F.col(y) - F.col(f"_b.{y}")) < tol))
    return j.groupBy(run, model).agg(F.max(F.struct(F.col(order), F.col("score"))).alias("_r")).select(
        run, model, F.col(f"_r.{order}").alias(order), F.col("_r.score").alias("score"))


def sensitivity_ranges(validations: DataFrame, keys, kind: str = "kind", score: str = "score") -> DataFrame:
    return validations.groupBy(*names(keys), kind).agg(F.count(score).alias("n"), (F.max(score) - F.min(score)).alias("range"),
                                                      (F.max(score) == F.min(score)).alias("identical"))


def run_summary(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Best row, totals and failure count per run in one pass."""
    ok = (F.col("status") == "OK") & F.col("score").isNotNull()
    b = F.max(F.when(ok, F.struct(F.col("score"), (-F.col("candidate_id")).alias("_t"))))
    return log.groupBy(run).agg(F.count(F.lit(1)).alias("evaluations"), F.count(F.when(~ok, 1)).alias("failed"), F.count_distinct("model").alias("models"),
                                F.max("step").alias("last_step"), b.alias("_b")).select(
        run, "evaluations", "failed", "models", "last_step", F.col("_b.score").alias("best_score"), (-F.col("_b._t")).alias("best_id"))


def split_counts(samples: DataFrame, row: str, split: str = "split", splits=("train", "validation", "holdout")) -> DataFrame:
    return samples.groupBy(row).pivot(split, list(splits)).count().fillna(0)
