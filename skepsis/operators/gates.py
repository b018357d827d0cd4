"""Decision gates: ordered rules over a table of metrics.

A rule set is data: named checks (SQL conditions on metric columns) and an ordered cascade of
statuses (conditions on checks); the first that holds decides.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .scale import names


@dataclass(frozen=True)
class Rules:
    checks: dict          # check -> condition over metrics
    cascade: tuple        # (status, condition over checks) in order
    default: str
    metrics: dict         # metric -> default when it was not measured


def pivot_metrics(metrics: DataFrame, keys, rules: Rules, metric: str = "metric", value: str = "value") -> DataFrame:
    """One row per key with a column per metric of the rule set."""
    g = metrics.filter(F.col(metric).isin(list(rules.metrics))).groupBy(*names(keys)).agg(
        *[F.max(F.when(F.col(metric) == m, F.col(value))).alias(f"_{m}") for m in rules.metrics])
    return g.select(*names(keys), *[F.coalesce(F.col(f"_{m}"), F.lit(float(d))).alias(m) for m, d in rules.metrics.items()])


def rule_cascade(metrics: DataFrame, keys, rules: Rules) -> DataFrame:
    """Checks as boolean columns plus the first matching status."""
    p = pivot_metrics(metrics, keys, rules).withColumns({c: F.expr(e) for c, e in rules.checks.items()})
    status = None
    for s, e in rules.cascade:
        status = F.when(F.expr(e), s) if status is None else status.when(F.expr(e), s)
    return p.withColumn("status", status.otherwise(rules.default))


# Thresholds and statuses of the published decision rules.

PASSIVE = Rules(
    metrics={"generator_holdout": 0, "substrate_holdout": 0, "permutation": 0.5, "identical": 0.5, "matched": 0, "matched_hash": 0},
    checks={"generator_holdout_survives": "generator_holdout > 0.6", "substrate_holdout_survives": "substrate_holdout > 0.6",
            "label_permutation_collapses": "abs(permutation - 0.5) <= 0.1", "identical_obs_collapses": "abs(identical - 0.5) <= 0.02",
            "matched_stats_survives": "matched > 0.6", "matched_hash_survives": "matched_hash > 0.6"},
    cascade=(("VALID_COMPUTATIONAL_SIGNATURE", "generator_holdout_survives and substrate_holdout_survives and label_permutation_collapses "
              "and identical_obs_collapses and matched_stats_survives and matched_hash_survives"),
             ("GENERATOR_CONFOUNDED", "not generator_holdout_survives"), ("NO_GENERALIZATION", "not substrate_holdout_survives"),
             ("BENCHMARK_INVALID", "not label_permutation_collapses or not identical_obs_collapses"),
             ("QUANTIZATION_DETECTOR", "not matched_stats_survives or not matched_hash_survives")),
    default="UNRESOLVED")

MATCHED = Rules(
    metrics={"primary_a": 0.5, "primary_b": 0.5, "hist": 0.5, "spectrum": 0.5, "temporal": 0.5, "unknown_min": 0.5, "equal_output": 0.5,
             "identical": 0.0, "permutation": 1.0, "group_dominant": 0, "degraded_min": 1.0},
    checks={"pairwise_above_chance": "primary_a > 0.55 or primary_b > 0.55", "hist_matched_survives": "hist > 0.55",
            "spectrum_matched_survives": "spectrum > 0.55", "temporal_matched_survives": "temporal > 0.55",
            "unknown_substrate_survives": "unknown_min > 0.55", "equal_output_survives": "equal_output > 0.55",
            "leakage_controlled": "group_dominant = 0", "permutation_collapses": "abs(permutation - 0.5) <= 0.1",
            "identical_at_chance": "abs(identical - 0.5) <= 0.02", "observation_robust": "degraded_min > 0.55"},
    cascade=(("NO_GENERALIZATION", "abs(primary_b - 0.5) <= 0.05 and abs((hist + spectrum + temporal) / 3 - 0.5) <= 0.05 "
              "and abs(unknown_min - 0.5) <= 0.05 and abs(primary_a - 0.5) <= 0.05"),
             ("NATIVE_SUBSTRATE_SIGNAL", "pairwise_above_chance and hist_matched_survives and spectrum_matched_survives and temporal_matched_survives "
              "and unknown_substrate_survives and equal_output_survives and leakage_controlled and permutation_collapses "
              "and identical_at_chance and observation_robust"),
             ("BENCHMARK_INVALID", "not identical_at_chance or not permutation_collapses"),
             ("STATISTICAL_ARTIFACT", "pairwise_above_chance and not (hist_matched_survives and spectrum_matched_survives)"),
             ("GENERATOR_CONFOUNDED", "not leakage_controlled"), ("OBSERVATION_CONFOUNDED", "not observation_robust"),
             ("NO_GENERALIZATION", "pairwise_above_chance and not unknown_substrate_survives")),
    default="STATISTICAL_ARTIFACT")

ARTIFACT = Rules(
    metrics={"positive": 0.5, "artifact_low": 0.0, "artifact": 0.5, "identical_low": 0.0, "identical_high": 1.0, "permutation": 0.5, "deterministic": 1},
    checks={"signal_present_on_real_pairs": "positive > 0.55", "signal_present_without_substrate": "artifact > 0.55 and artifact_low > 0.5",
            "classfree_null_at_chance": "identical_low <= 0.5 and identical_high >= 0.5", "permutation_collapses": "abs(permutation - 0.5) <= 0.1",
            "deterministic_rerun": "deterministic = 1"},
    cascade=(("BENCHMARK_INVALID", "not (classfree_null_at_chance and permutation_collapses and deterministic_rerun)"),
             ("BRANCH_CLOSED", "signal_present_without_substrate"), ("NO_GENERALIZATION", "signal_present_on_real_pairs")),
    default="STATISTICAL_ARTIFACT")

ACTIVE = Rules(
    metrics={"baseline": 0.5, "primary_acc": 0.5, "primary_low": 0.0, "generator": 0.5, "mechanism": 0.5, "equivalent": 0.5, "permutation": 0.5,
             "surrogate": 0.5, "deterministic": 1, "amplitude": 0.5, "operator": 0.5, "baseline_only": 0.5},
    checks={"baseline_indistinguishable": "baseline between 0.45 and 0.55", "primary_above_chance": "primary_acc > 0.55 and primary_low > 0.5",
            "generator_holdout_survives": "generator > 0.55", "unseen_mechanism_survives": "mechanism > 0.55",
            "equiv_impl_at_chance": "equivalent between 0.45 and 0.55", "equiv_impl_above_chance": "equivalent > 0.55",
            "permutation_at_chance": "abs(permutation - 0.5) <= 0.1", "surrogate_at_chance": "abs(surrogate - 0.5) <= 0.1",
            "deterministic_rerun": "deterministic = 1", "amplitude_drives_signal": "amplitude > 0.55",
            "operator_carries": "operator > 0.55 and baseline_only <= 0.55"},
    cascade=(("BENCHMARK_INVALID", "not baseline_indistinguishable or not deterministic_rerun"), ("IMPLEMENTATION_ARTIFACT", "equiv_impl_above_chance"),
             ("STATISTICAL_ARTIFACT", "not permutation_at_chance or not surrogate_at_chance"), ("BRANCH_CLOSED", "not primary_above_chance"),
             ("GENERATOR_CONFOUNDED", "not generator_holdout_survives"), ("NO_GENERALIZATION", "not unseen_mechanism_survives"),
             ("STATISTICAL_ARTIFACT", "amplitude_drives_signal and not operator_carries"),
             ("ACTIVE_COMPUTATIONAL_SIGNATURE", "equiv_impl_at_chance and operator_carries")),
    default="STATISTICAL_ARTIFACT")

SWEEP = Rules(
    metrics={"kernel_ok": 0, "boundary_suspect": 0, "c_full": 0, "c_event": 0, "c_residual": 0, "search_null": 1, "temporal_effect": 0, "full_score": 0, "smooth_ok": 1},
    checks={"contrasts": "abs(c_full) > 0.01 and abs(c_event) > 0.005 and abs(c_residual) > 0.005", "null_beaten": "search_null < 0.1",
            "temporal": "temporal_effect > 0.1", "inside": "boundary_suspect = 0"},
    cascade=(("IMPLEMENTATION_ERROR", "kernel_ok = 0"), ("BOUNDARY_ARTIFACT", "not inside"), ("ROBUST_PRIME_SPECIFIC_SIGNAL", "contrasts and null_beaten and temporal"),
             ("PRIME_CANDIDATE_SIGNAL", "contrasts and null_beaten"), ("DYNAMICAL_REGIME_ARTIFACT", "full_score > 0.5 and abs(c_full) < 0.001"),
             ("GENERIC_RESONANCE", "full_score > 0.5 and abs(c_full) < 0.01"), ("METHODOLOGICAL_ARTIFACT", "smooth_ok = 0")),
    default="NO_PRIME_SPECIFIC_SIGNAL")

ENGINE = Rules(
    metrics={"positive_p": 1, "isotropic_p": 0, "fpr_05": 1, "fpr_10": 1, "median_p": 0, "power": 0, "ingest_ok": 0},
    checks={"positive_fires": "positive_p < 0.05", "null_silent": "isotropic_p > 0.05", "ingest": "ingest_ok = 1",
            "calibrated": "fpr_05 <= 0.12 and fpr_10 <= 0.22 and median_p >= 0.2", "powered": "power >= 0.8"},
    cascade=(("ENGINE_VALID", "positive_fires and null_silent and ingest and calibrated and powered"),),
    default="ENGINE_INVALID")
