"""Queries over the one-pass fingerprint: all features of a field, and what they feed."""
from pyspark.sql import functions as F

from ..operators import fingerprint
from . import grids, series  # noqa: F401  (their SQL is reused)
from .fixtures import H, W
from .spec import REGISTRY, query

K = "sample_id"

#: Features of the fingerprint and where the SQL of single queries has them: (query, {feature: expression}).
TWINS = {
    "a1_moments": {"skew": "skew", "kurt": "kurt"},
    "a18_baseline_stats": {c: f'"{c}"' for c in ("mean", "var", "min", "max", "range")},
    "a2_hist_entropy": {c: c for c in ("bits32", "norm16", "unit16")},
    "a5_recurrence": {"recurrence": "exact", "recurrence_entropy": "entropy"},
    "a6_near_recurrence": {"near_recurrence": "near"},
    "a7_dominant_level": {"levels_1e5": "levels", "dominant_1e5": "dominant", "level_ratio": "level_ratio"},
    "a8_precision_diff": {c: c for c in ("float32_diff", "float16_diff")},
    "a9_entropy_sensitivity": {"entropy_sensitivity": "sensitivity"},
    "w14_run_length_stats": {c: c for c in ("run_mean", "run_std", "runs", "runs_per_element")},
    "f1_gradient_stats": {c: c for c in ("grad_mean", "grad_std")},
    "f2_laplacian_stats": {c: c for c in ("lap_mean", "lap_std")},
    "f3_anisotropy": {c: c for c in ("contrast", "horizontal", "directional")},
    "f4_edge_density": {"edge_density": "edge_density"},
    "f5_local_variance": {"local_variance": "local_variance"},
    "f6_components": {c: c for c in ("n_components", "mean_size", "max_size")},
    "f8_flat_lag1_pearson": {"lag1": "lag1"},
    "f9_gradient_energy": {"gradient_energy": "gradient_energy"},
    "f10_neighbour_similarity": {"similarity": "similarity"},
    "r2_dct_bands": {c: c for c in ("dct_low", "dct_mid", "dct_high", "high_low_ratio")},
    "r4_dct_low_energy": {"mode_low": "low", "mode_high": "high", "low_share_ac": "low_share_ac"},
    "r6_spectral_sparsity": {c: c for c in ("row0", "low_modes")},
    "r7_spectral_slope": {"slope": "slope"},
    "r8_spectral_peaks": {"peaks": "peaks"},
}


def _twin(name: str) -> str:
    sql = REGISTRY[name].sql.strip()
    return sql.replace("0.05::DOUBLE", "0.5::DOUBLE") if name == "f6_components" else sql     # threshold of the fingerprint


def _family(name: str) -> str:
    return fingerprint.FEATURES[name][0]


_ROWS = " UNION ALL ".join(
    f"SELECT sample_id, '{n}' AS name, '{_family(n)}' AS family, CAST({e} AS DOUBLE) AS value FROM ({_twin(q)}) t_{q}"
    for q, fs in TWINS.items() for n, e in fs.items())
_LEVELS = " UNION ALL ".join(
    f"SELECT sample_id, name, 'marginal', value FROM v_unit_features WHERE unit = 'none' AND name = '{n}'"
    for n in ("distinct_values", "repeated", "dominant", "value_entropy"))
_LAGS = f"SELECT sample_id, 'row_acf_' || lag, 'field', acf FROM ({_twin('f7_row_acf')}) t_f7"
_MODES = f"SELECT sample_id, 'concentration_' || rank, 'spectral', concentration FROM ({_twin('r9_dominant_modes')}) t_r9 WHERE rank IN (1, 3, 10)"
FINGERPRINT = f"{_ROWS} UNION ALL {_LEVELS} UNION ALL {_LAGS} UNION ALL {_MODES}"

query("s14_fingerprint", "sample_id:l name:s family:s value:d", lambda V: fingerprint.fingerprint(V.sample_grids, K, W, H), FINGERPRINT)
