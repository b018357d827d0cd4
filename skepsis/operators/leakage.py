"""Does a feature identify the group instead of the label?"""
from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import entropy_bits
from .scale import value_ranks


def binned_mi(features: DataFrame, targets: dict, bins: int = 8, name: str = "name", value: str = "value") -> DataFrame:
    """Mutual information of equal-frequency bins of each feature with each target.

    targets: target name -> group column.  A bin is floor(below * bins / n): equal values share
    a bin whatever the row order, so a constant feature carries no information.  Rows are counted by
    (feature, value, group) before anything is joined.
    """
    t = F.array(*[F.struct(F.lit(k).alias("target"), F.col(c).cast("string").alias("g")) for k, c in targets.items()])
    rows = features.select(name, value, F.explode(t).alias("_t")).select(name, value, "_t.target", "_t.g")
    counts = rows.groupBy(name, value, "target", "g").agg(F.count(F.lit(1)).alias("_n"))
    r = value_ranks(features.select(name, value), name, value).select(
        name, value, F.least(F.floor(F.col("below") * bins / F.col("total")), F.lit(bins - 1)).alias("bin"))
    j = counts.join(r, [name, value]).groupBy(name, "target", "bin", "g").agg(F.sum("_n").alias("n"))
    # the three entropies from one pass: every (bin, group) count also feeds both margins
    joint = j.groupBy(name, "target").agg(entropy_bits(F.col("n")).alias("h_bg"), F.sum("n").alias("n"))
    hb = j.groupBy(name, "target", "bin").agg(F.sum("n").alias("n")).groupBy(name, "target").agg(entropy_bits(F.col("n")).alias("h_b"))
    hg = j.groupBy(name, "target", "g").agg(F.sum("n").alias("n")).groupBy(name, "target").agg(
        entropy_bits(F.col("n")).alias("h_g"), F.count(F.lit(1)).alias("groups"))
    a = joint.join(hb, [name, "target"]).join(hg, [name, "target"])
    mi = F.greatest(F.col("h_b") + F.col("h_g") - F.col("h_bg"), F.lit(0.0))
    low = F.least("h_b", "h_g")
    return a.select(name, "target", "n", mi.alias("mi"),
                    F.when(low > 1e-12, mi / F.nullif(low, F.lit(0.0))).otherwise(0.0).alias("mi_min"),
                    F.when(F.col("groups") > 1, mi / F.nullif(F.log2(F.col("groups").cast("double")), F.lit(0.0))).otherwise(0.0).alias("mi_groups"))


def leakage_report(mi: DataFrame, measure: str = "mi_min", name: str = "name") -> DataFrame:
    """Per feature: information on group and unit, blacklist flag (group >= 0.8 and unit < 0.2)."""
    pick = lambda t: F.max(F.when(F.col("target") == t, F.col(measure)))
    a = mi.groupBy(name).agg(pick("grp").alias("mi_grp"), pick("unit").alias("mi_unit"), pick("seed").alias("mi_seed"))
    return a.withColumn("blacklisted", (F.col("mi_grp") >= 0.8) & (F.col("mi_unit") < 0.2))


def leakage_verdict(report: DataFrame, factor: float = 1.5) -> DataFrame:
    a = report.agg(F.avg("mi_grp").alias("mean_grp"), F.avg("mi_unit").alias("mean_unit"), F.count(F.when(F.col("blacklisted"), 1)).alias("blacklisted"))
    v = (F.when(F.col("mean_grp") > factor * F.col("mean_unit"), "GROUP_DOMINANT")
         .when(F.col("mean_unit") > factor * F.col("mean_grp"), "UNIT_DOMINANT").otherwise("BALANCED"))
    return a.withColumn("verdict", v)


def top_features(report: DataFrame, k: int, measure: str = "mi_grp", name: str = "name") -> DataFrame:
    """The k most informative features, ties by name (a top-k report, planned without a full sort)."""
    return report.orderBy(F.desc(measure), name).limit(k)


def without_blacklisted(features: DataFrame, report: DataFrame, name: str = "name") -> DataFrame:
    return features.join(report.filter("blacklisted").select(name), name, "left_anti")
