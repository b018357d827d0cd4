"""Queries over fields: marginal features, two-dimensional features, spectra, degradations."""
from pyspark.sql import functions as F

from ..operators import degrade, fields, marginal, spectral, surrogates
from .fixtures import H, W
from .spec import query

K = "sample_id"

# -- sources of cells -----------------------------------------------------------------------------

query("s6_explode_arrays", "sample_id:l y:l x:l idx:l v:d", lambda V: V.cells, "SELECT * FROM v_cells")

# -- marginal features ----------------------------------------------------------------------------

query("a1_moments", "sample_id:l mean:d var:d skew:d kurt:d", lambda V: marginal.moments(V.cells, K), """
SELECT sample_id, avg(v) AS mean, var_pop(v) AS var,
  CASE WHEN var_pop(v) > 0 THEN avg((v - m) * (v - m) * (v - m)) / (var_pop(v) * sqrt(var_pop(v))) ELSE 0 END AS skew,
  CASE WHEN var_pop(v) > 0 THEN avg((v - m) * (v - m) * (v - m) * (v - m)) / (var_pop(v) * var_pop(v)) - 3 ELSE 0 END AS kurt
FROM (SELECT *, avg(v) OVER (PARTITION BY sample_id) AS m FROM v_cells) GROUP BY sample_id""")


def _entropies(V):
    c = V.cells
    e = marginal.hist_entropy(c, K, bins=32, out="bits32")
    e = e.join(marginal.hist_entropy(c, K, bins=16, base="nats", normalise=True, out="norm16"), K)
    return e.join(marginal.hist_entropy(c, K, bins=16, span="unit", base="nats", normalise=True, out="unit16"), K)


ENT = "greatest(ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n), 0)"
query("a2_hist_entropy", "sample_id:l bits32:d norm16:d unit16:d", _entropies, f"""
WITH s AS (SELECT *, min(v) OVER (PARTITION BY sample_id) AS lo, max(v) OVER (PARTITION BY sample_id) AS hi FROM v_cells),
b AS (SELECT sample_id,
  CASE WHEN hi > lo THEN least(trunc((v - lo) / (hi - lo) * 32.0::DOUBLE), 31) ELSE 0 END AS b32,
  CASE WHEN hi > lo THEN least(trunc((v - lo) / (hi - lo) * 16.0::DOUBLE), 15) ELSE 0 END AS b16,
  least(greatest(trunc(v * 16.0::DOUBLE), 0), 15) AS u16 FROM s),
e32 AS (SELECT sample_id, {ENT} / ln(2) AS e FROM (SELECT sample_id, b32, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1),
e16 AS (SELECT sample_id, {ENT} / ln(16) AS e FROM (SELECT sample_id, b16, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1),
u AS (SELECT sample_id, {ENT} / ln(16) AS e FROM (SELECT sample_id, u16, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1)
SELECT sample_id, e32.e AS bits32, e16.e AS norm16, u.e AS unit16
FROM e32 JOIN e16 USING (sample_id) JOIN u USING (sample_id)""")

query("a3_quantization_level", "sample_id:l unit:s distinct_values:l level:l",
      lambda V: marginal.quantization_level(
          V.unit_grids.select(K, "unit", F.explode("vals").alias("v")), [K, "unit"]), """
SELECT sample_id, unit, count(DISTINCT v) AS distinct_values,
  CASE WHEN count(DISTINCT v) <= 16 THEN 4 WHEN count(DISTINCT v) <= 256 THEN 8
       WHEN count(DISTINCT v) <= 65536 THEN 16 ELSE 32 END AS level
FROM v_unit_cells GROUP BY ALL""")

query("a4_repeated_fraction", "sample_id:l unit:s repeated:d",
      lambda V: marginal.repeated_fraction(
          V.unit_grids.select(K, "unit", F.explode("vals").alias("v")), [K, "unit"]), """
SELECT sample_id, unit, 1.0::DOUBLE - count(DISTINCT v) / count(*)::DOUBLE AS repeated
FROM v_unit_cells GROUP BY ALL""")

query("a5_recurrence", "sample_id:l exact:d entropy:d", lambda V: marginal.recurrence(V.cells, K), f"""
SELECT sample_id, 1.0::DOUBLE - count(*) / sum(n)::DOUBLE AS exact, {ENT} / ln(2) AS entropy
FROM (SELECT sample_id, trunc(v * 256.0::DOUBLE) AS q, count(*) AS n FROM v_cells GROUP BY ALL) GROUP BY 1""")

query("a6_near_recurrence", "sample_id:l near:d", lambda V: marginal.near_recurrence(V.cells, K), """
WITH q AS (SELECT sample_id, idx, trunc(v * 256.0::DOUBLE) AS q FROM v_cells)
SELECT sample_id, avg(CASE WHEN EXISTS (SELECT 1 FROM q b WHERE b.sample_id = a.sample_id AND b.idx > a.idx
  AND abs(b.q - a.q) <= 1) THEN 1.0::DOUBLE ELSE 0 END) AS near FROM q a GROUP BY sample_id""")

query("a7_dominant_level", "sample_id:l levels:l dominant:d level_ratio:d",
      lambda V: marginal.dominant_level(V.cells, K), """
WITH f AS (SELECT sample_id, trunc(v * 100000.0::DOUBLE + 0.5::DOUBLE) AS q, count(*) AS n FROM v_cells GROUP BY ALL),
c AS (SELECT sample_id, count(DISTINCT trunc(v * 100.0::DOUBLE)) / least(count(*), 100)::DOUBLE AS r FROM v_cells GROUP BY 1)
SELECT f.sample_id, count(*) AS levels, max(n) / sum(n)::DOUBLE AS dominant, any_value(c.r) AS level_ratio
FROM f JOIN c USING (sample_id) GROUP BY f.sample_id""")

# exponent of the enclosing power of two, corrected where log2 rounds across it
EXP2 = ("(CASE WHEN pow(2.0::DOUBLE, floor(log2({a})) + 1) <= {a} THEN floor(log2({a})) + 1 "
        "WHEN pow(2.0::DOUBLE, floor(log2({a}))) > {a} THEN floor(log2({a})) - 1 ELSE floor(log2({a})) END)")


def half_sql(v):
    a = f"greatest(abs({v}), {2.0 ** -24!r}::DOUBLE)"
    step = f"pow(2.0::DOUBLE, greatest({EXP2.format(a=a)}, -14) - 10)"
    return f"round_even({v} / {step}, 0) * {step}"


query("a8_precision_diff", "sample_id:l float32_diff:d float16_diff:d9",
      lambda V: marginal.precision_diff(V.cells, K), f"""
SELECT sample_id, avg(abs(v - v::FLOAT::DOUBLE)) AS float32_diff, avg(abs(v - {half_sql('v')})) AS float16_diff
FROM v_cells GROUP BY 1""")

query("a9_entropy_sensitivity", "sample_id:l sensitivity:d",
      lambda V: marginal.entropy_sensitivity(V.cells, K), f"""
WITH b AS (
  SELECT sample_id, 'raw' AS arm, least(greatest(trunc(v * 16.0::DOUBLE), 0), 15) AS b FROM v_cells
  UNION ALL SELECT sample_id, 'q8', least(greatest(trunc(floor(v * 256.0::DOUBLE) / 255.0::DOUBLE * 16.0::DOUBLE), 0), 15) FROM v_cells),
e AS (SELECT sample_id, arm, {ENT} AS h FROM (SELECT sample_id, arm, b, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL)
SELECT r.sample_id, CASE WHEN r.h > 0 THEN abs(r.h - q.h) / ln(16) ELSE 0 END AS sensitivity
FROM e r JOIN e q ON q.sample_id = r.sample_id AND r.arm = 'raw' AND q.arm = 'q8'""")

query("a18_baseline_stats", "sample_id:l mean:d var:d min:d max:d range:d",
      lambda V: marginal.baseline_stats(V.cells, K), """
SELECT sample_id, avg(v) AS mean, var_pop(v) AS var, min(v) AS min, max(v) AS max, max(v) - min(v) AS range
FROM v_cells GROUP BY 1""")

# -- two-dimensional features -----------------------------------------------------------------------

# neighbours of every cell, NULL outside the field
NB = """
nb AS (SELECT *, lead(v) OVER rw AS r, lag(v) OVER rw AS l, lead(v) OVER cw AS d, lag(v) OVER cw AS u
  FROM v_cells WINDOW rw AS (PARTITION BY sample_id, y ORDER BY x), cw AS (PARTITION BY sample_id, x ORDER BY y))"""

query("f1_gradient_stats", "sample_id:l grad_mean:d grad_std:d",
      lambda V: fields.gradient_stats(V.grids, K, W, H), f"""
WITH {NB}, g AS (SELECT sample_id, abs(r - v) AS g FROM nb WHERE x < 7 AND y < 7
  UNION ALL SELECT sample_id, abs(d - v) FROM nb WHERE x < 7 AND y < 7)
SELECT sample_id, avg(g) AS grad_mean, stddev_pop(g) AS grad_std FROM g GROUP BY 1""")

query("f2_laplacian_stats", "sample_id:l lap_mean:d lap_std:d",
      lambda V: fields.laplacian_stats(V.grids, K, W, H), f"""
WITH {NB} SELECT sample_id, avg(l + r + u + d - 4 * v) AS lap_mean, stddev_pop(l + r + u + d - 4 * v) AS lap_std
FROM nb WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY 1""")

query("f3_anisotropy", "sample_id:l contrast:d horizontal:d directional:d",
      lambda V: fields.anisotropy(V.grids, K, W, H), f"""
WITH {NB}, m AS (SELECT sample_id, avg(v) AS mu, var_pop(v) AS var FROM v_cells GROUP BY 1),
dg AS (
  SELECT a.sample_id, sum((a.v - mu) * (b.v - mu)) AS s, count(*) AS n
  FROM v_cells a JOIN m USING (sample_id) JOIN v_cells b ON b.sample_id = a.sample_id AND b.y = a.y + 1 AND abs(b.x - a.x) = 1
  GROUP BY 1),
g AS (
  SELECT sample_id, avg(CASE WHEN x < 7 AND y < 7 THEN (r - v) * (r - v) END) AS vx,
    avg(CASE WHEN x < 7 AND y < 7 THEN (d - v) * (d - v) END) AS vy,
    sum((r - v) * (r - v)) AS gh, sum((d - v) * (d - v)) AS gv,
    avg((v - mu) * (r - mu)) AS ch, avg((v - mu) * (d - mu)) AS cv, any_value(var) AS var
  FROM nb JOIN m USING (sample_id) GROUP BY 1),
c AS (SELECT g.*, abs(ch / var) AS ah, abs(cv / var) AS av, abs(s / n / var) AS ad FROM g JOIN dg USING (sample_id))
SELECT sample_id, abs(vx - vy) / (vx + vy) AS contrast, gh / (gh + gv) AS horizontal,
  least(greatest(greatest(ah, av, ad) - (ah + av + ad) / 3, 0), 1) AS directional FROM c""")

query("f4_edge_density", "sample_id:l edge_density:d",
      lambda V: fields.edge_density(V.grids, K, W, H), f"""
WITH {NB} SELECT sample_id, avg(CASE WHEN abs(r - v) + abs(d - v) > 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS edge_density
FROM nb WHERE x < 7 AND y < 7 GROUP BY 1""")

query("f5_local_variance", "sample_id:l local_variance:d",
      lambda V: fields.local_variance(V.grids, K, W, H), """
WITH b AS (SELECT a.sample_id, a.idx, var_pop(b.v) AS var FROM v_cells a JOIN v_cells b
  ON b.sample_id = a.sample_id AND b.y BETWEEN a.y AND a.y + 2 AND b.x BETWEEN a.x AND a.x + 2
  WHERE a.y <= 5 AND a.x <= 5 GROUP BY ALL)
SELECT sample_id, avg(var) AS local_variance FROM b GROUP BY 1""")

query("f6_components", "sample_id:l n_components:l mean_size:d max_size:l",
      lambda V: fields.components(V.grids, K, W, H, threshold=0.05), """
WITH RECURSIVE n AS (SELECT sample_id, idx, y, x FROM v_cells WHERE v >= 0.05::DOUBLE),
walk AS (SELECT sample_id, idx AS start, idx, y, x FROM n
  UNION SELECT w.sample_id, w.start, n.idx, n.y, n.x FROM walk w JOIN n
    ON n.sample_id = w.sample_id AND abs(n.y - w.y) + abs(n.x - w.x) = 1),
lab AS (SELECT sample_id, idx, min(start) AS lab FROM walk GROUP BY ALL),
s AS (SELECT sample_id, lab, count(*) AS size FROM lab GROUP BY ALL)
SELECT e.vec_id AS sample_id, count(size) AS n_components, coalesce(avg(size), 0) AS mean_size,
  coalesce(max(size), 0) AS max_size FROM embeddings e LEFT JOIN s ON s.sample_id = e.vec_id GROUP BY 1""")

query("f7_row_acf", "sample_id:l lag:l acf:d", lambda V: fields.row_acf(V.grids, K, W, H), """
WITH m AS (SELECT sample_id, avg(v) AS mu, var_pop(v) AS var FROM v_cells GROUP BY 1)
SELECT a.sample_id, b.x - a.x AS lag, avg((a.v - mu) * (b.v - mu)) / any_value(var) AS acf
FROM v_cells a JOIN m USING (sample_id) JOIN v_cells b
  ON b.sample_id = a.sample_id AND b.y = a.y AND b.x - a.x BETWEEN 1 AND 5 GROUP BY ALL""")

query("f8_flat_lag1_pearson", "sample_id:l lag1:d", lambda V: fields.flat_lag1_pearson(V.grids, K, W, H), """
SELECT sample_id, corr(v, n) AS lag1 FROM (
  SELECT sample_id, v, lead(v) OVER (PARTITION BY sample_id ORDER BY idx) AS n FROM v_cells)
WHERE n IS NOT NULL GROUP BY 1""")

query("f9_gradient_energy", "sample_id:l gradient_energy:d",
      lambda V: fields.gradient_energy(V.grids, K, W, H), f"""
WITH {NB} SELECT sample_id, coalesce(sum((r - v) * (r - v)), 0) + coalesce(sum((d - v) * (d - v)), 0) AS gradient_energy
FROM nb GROUP BY 1""")

query("f10_neighbour_similarity", "sample_id:l similarity:d",
      lambda V: fields.neighbour_similarity(V.grids, K, W, H), f"""
WITH {NB}, p AS (SELECT sample_id, v, unnest([l, r, u, d]) AS o FROM nb)
SELECT sample_id, avg(CASE WHEN abs(v - o) < 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS similarity
FROM p WHERE o IS NOT NULL GROUP BY 1""")

S01 = "least(greatest(({r} + 1) / 2, 0), 1)"
P01 = S01.format(r="corr(f, t)")
RANKS = """
rk AS (SELECT pair_id, rank() OVER (PARTITION BY pair_id ORDER BY f) + (count(*) OVER (PARTITION BY pair_id, f) - 1) / 2.0::DOUBLE AS f,
  rank() OVER (PARTITION BY pair_id ORDER BY t) + (count(*) OVER (PARTITION BY pair_id, t) - 1) / 2.0::DOUBLE AS t FROM v_pairs_cells)"""
GRAD = """
pn AS (SELECT *, lead(f) OVER rw AS fr, lag(f) OVER rw AS fl, lead(f) OVER cw AS fd, lag(f) OVER cw AS fu,
    lead(t) OVER rw AS tr, lag(t) OVER rw AS tl, lead(t) OVER cw AS td, lag(t) OVER cw AS tu FROM v_pairs_cells
  WINDOW rw AS (PARTITION BY pair_id, y ORDER BY x), cw AS (PARTITION BY pair_id, x ORDER BY y)),
pg AS (SELECT pair_id, coalesce(fr, f) - coalesce(fl, f) AS fx, coalesce(fd, f) - coalesce(fu, f) AS fy,
    coalesce(tr, t) - coalesce(tl, t) AS tx, coalesce(td, t) - coalesce(tu, t) AS ty FROM pn),
gr AS (SELECT pair_id, """ + S01.format(
    r="sum(fx * tx + fy * ty) / sqrt(sum(fx * fx + fy * fy) * sum(tx * tx + ty * ty))") + """ AS gradient01 FROM pg GROUP BY 1)"""
SPEC = """
sx AS (SELECT pair_id, y, u, sum(f * cos(pi() * u * (2 * x + 1) / 16)) AS f, sum(t * cos(pi() * u * (2 * x + 1) / 16)) AS t
  FROM v_pairs_cells, range(8) q(u) GROUP BY ALL),
sy AS (SELECT pair_id, u, v, sum(f * cos(pi() * v * (2 * y + 1) / 16)) AS f, sum(t * cos(pi() * v * (2 * y + 1) / 16)) AS t
  FROM sx, range(8) q(v) GROUP BY ALL),
sp AS (SELECT pair_id, """ + S01.format(r="sum(f * t) / sqrt(sum(f * f) * sum(t * t))") + """ AS spectral01
  FROM sy WHERE u + v > 0 GROUP BY 1)"""
ACOR = """
pm AS (SELECT pair_id, avg(f) AS mf, avg(t) AS mt FROM v_pairs_cells GROUP BY 1),
ao AS (SELECT a.pair_id, b.y - a.y AS dy, b.x - a.x AS dx, avg((a.f - mf) * (b.f - mf)) AS af, avg((a.t - mt) * (b.t - mt)) AS ta
  FROM v_pairs_cells a JOIN pm USING (pair_id) JOIN v_pairs_cells b ON b.pair_id = a.pair_id
   AND b.y - a.y BETWEEN -4 AND 4 AND b.x - a.x BETWEEN -4 AND 4 AND b.idx <> a.idx GROUP BY ALL),
ac AS (SELECT pair_id, """ + S01.format(r="sum(af * ta) / sqrt(sum(af * af) * sum(ta * ta))") + """ AS autocorr01 FROM ao GROUP BY 1)"""

query("f11_pearson01", "pair_id:l pearson01:d", lambda V: fields.pearson01(V.pairs_cells),
      f"SELECT pair_id, {P01} AS pearson01 FROM v_pairs_cells GROUP BY 1")
query("f12_spearman01", "pair_id:l spearman01:d", lambda V: fields.spearman01(V.pairs_cells),
      f"WITH {RANKS} SELECT pair_id, {P01} AS spearman01 FROM rk GROUP BY 1")
query("f13_mae01", "pair_id:l mae01:d", lambda V: fields.mae01(V.pairs_cells), """
SELECT pair_id, least(greatest(1 - avg(abs(f - t)), 0), 1) AS mae01 FROM v_pairs_cells GROUP BY 1""")
query("f14_gradient01", "pair_id:l gradient01:d", lambda V: fields.gradient01(V.pair_grids, W, H),
      f"WITH {GRAD} SELECT * FROM gr")
query("f15_spectral01", "pair_id:l spectral01:d", lambda V: fields.spectral01(V.pair_grids, W, H),
      f"WITH {SPEC} SELECT * FROM sp")
query("f16_autocorr01", "pair_id:l autocorr01:d", lambda V: fields.autocorr01(V.pair_grids, W, H),
      f"WITH {ACOR} SELECT * FROM ac")

SCORES = f"""
{RANKS}, {GRAD}, {SPEC}, {ACOR},
p AS (SELECT pair_id, {P01} AS pearson01, least(greatest(1 - avg(abs(f - t)), 0), 1) AS mae01 FROM v_pairs_cells GROUP BY 1),
r AS (SELECT pair_id, {P01} AS spearman01 FROM rk GROUP BY 1),
scored AS (SELECT *, 0.25::DOUBLE * pearson01 + 0.15::DOUBLE * spearman01 + 0.15::DOUBLE * mae01 + 0.15::DOUBLE * gradient01
   + 0.15::DOUBLE * spectral01 + 0.15::DOUBLE * autocorr01 AS score
  FROM p JOIN r USING (pair_id) JOIN gr USING (pair_id) JOIN sp USING (pair_id) JOIN ac USING (pair_id))"""
SCORE_COLS = "pearson01:d spearman01:d mae01:d gradient01:d spectral01:d autocorr01:d score:d"
query("f17_score_fields", f"pair_id:l {SCORE_COLS}", lambda V: fields.score_fields(V.pair_grids, W, H),
      f"WITH {SCORES} SELECT * FROM scored")
query("a11_weighted_score", "pair_id:l score:d",
      lambda V: fields.score_fields(V.pair_grids, W, H).select("pair_id", fields.weighted_score().alias("score")),
      f"WITH {SCORES} SELECT pair_id, score FROM scored")

# orthonormal 2-D DCT of a cell relation with columns (id, y, x, v)


def dct2_sql(src, name="dc", key="sample_id", v="v"):
    return f"""
{name}_x AS (SELECT {key}, y, u, sum({v} * CASE WHEN u = 0 THEN sqrt(1.0::DOUBLE / 8) ELSE sqrt(2.0::DOUBLE / 8) END
   * cos(pi() * u * (2 * x + 1) / 16)) AS c FROM {src}, range(8) q(u) GROUP BY ALL),
{name} AS (SELECT {key}, w AS vv, u AS uu, sum(c * CASE WHEN w = 0 THEN sqrt(1.0::DOUBLE / 8) ELSE sqrt(2.0::DOUBLE / 8) END
   * cos(pi() * w * (2 * y + 1) / 16)) AS c FROM {name}_x, range(8) q(w) GROUP BY ALL)"""


def idct2_sql(src, name="inv", key="sample_id"):
    return f"""
{name}_x AS (SELECT {key}, vv, x, sum(c * CASE WHEN uu = 0 THEN sqrt(1.0::DOUBLE / 8) ELSE sqrt(2.0::DOUBLE / 8) END
   * cos(pi() * uu * (2 * x + 1) / 16)) AS c FROM {src}, range(8) q(x) GROUP BY ALL),
{name} AS (SELECT {key}, y, x, y * 8 + x AS idx, sum(c * CASE WHEN vv = 0 THEN sqrt(1.0::DOUBLE / 8) ELSE sqrt(2.0::DOUBLE / 8) END
   * cos(pi() * vv * (2 * y + 1) / 16)) AS v FROM {name}_x, range(8) q(y) GROUP BY ALL)"""


def _delta(V):
    d = fields.delta_grids(V.pair_grids)
    c = fields.explode_arrays(d.select("pair_id", "vals"), W, H)
    base = c.groupBy("pair_id").agg(F.stddev_pop("v").alias("sd"), F.max(F.abs("v")).alias("max_abs"))
    ent = marginal.hist_entropy(c, "pair_id", bins=16, base="nats", normalise=True)
    low = spectral.dct_low_energy(d, "pair_id", W, H).select("pair_id", "low", "high")
    lag = fields.flat_lag1_pearson(d, "pair_id", W, H)
    z = d.select("pair_id", F.explode(F.arrays_zip("vals", "t")).alias("z")).select("pair_id", "z.vals", "z.t")
    cor = z.groupBy("pair_id").agg(fields.guarded_corr("vals", "t").alias("corr_target"))
    return base.join(ent, "pair_id").join(low, "pair_id").join(lag, "pair_id").join(cor, "pair_id")


query("f18_delta_field", "pair_id:l sd:d max_abs:d entropy:d low:d high:d lag1:d corr_target:d", _delta, f"""
WITH dl AS (SELECT pair_id, y, x, idx, f - t AS v, t FROM v_pairs_cells), {dct2_sql('dl', key='pair_id')},
en AS (SELECT pair_id, {ENT} / ln(16) AS entropy FROM (
  SELECT pair_id, least(trunc((v - lo) / (hi - lo) * 16.0::DOUBLE), 15) AS b, count(*) AS n FROM (
    SELECT pair_id, v, min(v) OVER (PARTITION BY pair_id) AS lo, max(v) OVER (PARTITION BY pair_id) AS hi FROM dl) GROUP BY ALL) GROUP BY 1),
lg AS (SELECT pair_id, corr(v, n) AS lag1 FROM (SELECT pair_id, v, lead(v) OVER (PARTITION BY pair_id ORDER BY idx) AS n FROM dl)
  WHERE n IS NOT NULL GROUP BY 1),
lo AS (SELECT pair_id, sum(CASE WHEN vv < 3 AND uu < 3 THEN c * c ELSE 0 END) AS low,
  sum(CASE WHEN vv < 3 AND uu < 3 THEN 0 ELSE c * c END) AS high FROM dc GROUP BY 1),
b AS (SELECT pair_id, stddev_pop(v) AS sd, max(abs(v)) AS max_abs, corr(v, t) AS corr_target FROM dl GROUP BY 1)
SELECT * FROM b JOIN en USING (pair_id) JOIN lg USING (pair_id) JOIN lo USING (pair_id)""")


def _profile(V):
    g = V.grids
    one = marginal.baseline_stats(V.cells, K).select(K, "mean", F.sqrt("var").alias("std"))
    out = one.join(marginal.hist_entropy(V.cells, K, bins=16, base="nats", normalise=True), K)
    out = out.join(spectral.dct_low_energy(g, K, W, H).select(K, "low", "high"), K)
    out = out.join(fields.anisotropy(g, K, W, H).select(K, "horizontal"), K)
    return out.join(fields.flat_lag1_pearson(g, K, W, H), K).join(fields.gradient_energy(g, K, W, H), K)


query("f19_target_profile",
      "sample_id:l mean:d std:d entropy:d low:d high:d horizontal:d lag1:d gradient_energy:d", _profile, f"""
WITH {NB}, {dct2_sql('v_cells')},
en AS (SELECT sample_id, {ENT} / ln(16) AS entropy FROM (
  SELECT sample_id, least(trunc((v - lo) / (hi - lo) * 16.0::DOUBLE), 15) AS b, count(*) AS n FROM (
    SELECT sample_id, v, min(v) OVER (PARTITION BY sample_id) AS lo, max(v) OVER (PARTITION BY sample_id) AS hi FROM v_cells) GROUP BY ALL) GROUP BY 1),
lo AS (SELECT sample_id, sum(CASE WHEN vv < 3 AND uu < 3 THEN c * c ELSE 0 END) AS low,
  sum(CASE WHEN vv < 3 AND uu < 3 THEN 0 ELSE c * c END) AS high FROM dc GROUP BY 1),
gr AS (SELECT sample_id, sum((r - v) * (r - v)) AS gh, sum((d - v) * (d - v)) AS gv FROM nb GROUP BY 1),
lg AS (SELECT sample_id, corr(v, n) AS lag1 FROM (
  SELECT sample_id, v, lead(v) OVER (PARTITION BY sample_id ORDER BY idx) AS n FROM v_cells) WHERE n IS NOT NULL GROUP BY 1),
b AS (SELECT sample_id, avg(v) AS mean, stddev_pop(v) AS std FROM v_cells GROUP BY 1)
SELECT *, gh / (gh + gv) AS horizontal, gh + gv AS gradient_energy
FROM b JOIN en USING (sample_id) JOIN lo USING (sample_id) JOIN gr USING (sample_id) JOIN lg USING (sample_id)""")

GEO = """
geo AS (SELECT name, y * 8 + x AS idx, y, x, CASE name WHEN 'constant' THEN 0.5::DOUBLE WHEN 'x_ramp' THEN u WHEN 'y_ramp' THEN w
    WHEN 'bilinear' THEN u * w WHEN 'radial' THEN sqrt((u - 0.5::DOUBLE) * (u - 0.5::DOUBLE) + (w - 0.5::DOUBLE) * (w - 0.5::DOUBLE))
    WHEN 'abs_sin_u' THEN abs(sin(pi() * u)) WHEN 'abs_cos_v' THEN abs(cos(pi() * w)) ELSE sin(pi() * u) * sin(pi() * w) END AS f
  FROM (SELECT y, x, x / 7.0::DOUBLE AS u, y / 7.0::DOUBLE AS w FROM range(8) a(y), range(8) b(x)),
  (SELECT unnest(['constant', 'x_ramp', 'y_ramp', 'bilinear', 'radial', 'abs_sin_u', 'abs_cos_v', 'sin_sin']) AS name))"""
query("f20_geometry_controls", "sample_id:l name:s pearson01:d mae01:d gradient01:d",
      lambda V: fields.geometry_controls(V.grids, W, H), f"""
WITH {GEO},
pc AS (SELECT sample_id, name, geo.y, geo.x, geo.f, c.v AS t FROM geo JOIN v_cells c USING (idx)),
pn AS (SELECT *, lead(f) OVER rw AS fr, lag(f) OVER rw AS fl, lead(f) OVER cw AS fd, lag(f) OVER cw AS fu,
    lead(t) OVER rw AS tr, lag(t) OVER rw AS tl, lead(t) OVER cw AS td, lag(t) OVER cw AS tu FROM pc
  WINDOW rw AS (PARTITION BY sample_id, name, y ORDER BY x), cw AS (PARTITION BY sample_id, name, x ORDER BY y)),
pg AS (SELECT sample_id, name, coalesce(fr, f) - coalesce(fl, f) AS fx, coalesce(fd, f) - coalesce(fu, f) AS fy,
    coalesce(tr, t) - coalesce(tl, t) AS tx, coalesce(td, t) - coalesce(tu, t) AS ty FROM pn),
gr AS (SELECT sample_id, name, CASE WHEN name = 'constant' THEN 0.5 ELSE {S01.format(
    r="sum(fx * tx + fy * ty) / nullif(sqrt(sum(fx * fx + fy * fy) * sum(tx * tx + ty * ty)), 0)")} END AS gradient01 FROM pg GROUP BY sample_id, name)
SELECT sample_id, name, CASE WHEN name = 'constant' THEN 0.5 ELSE {P01} END AS pearson01,
  least(greatest(1 - avg(abs(f - t)), 0), 1) AS mae01, any_value(gradient01) AS gradient01
FROM pc JOIN gr USING (sample_id, name) GROUP BY sample_id, name""")

# -- spectra ------------------------------------------------------------------------------------------

RD = """
rd AS (SELECT sample_id, y, k, sum(v * cos(pi() * k * (2 * x + 1) / 16)) AS c FROM v_cells, range(8) q(k) GROUP BY ALL)"""
query("r1_row_dct", "sample_id:l y:l k:l c:d", lambda V: spectral.row_dct(V.grids, K, W, H), f"WITH {RD} SELECT * FROM rd")
query("r2_dct_bands", "sample_id:l dct_low:d dct_mid:d dct_high:d high_low_ratio:d",
      lambda V: spectral.dct_bands(V.grids, K, W, H), f"""
WITH {RD} SELECT sample_id, sum(CASE WHEN k < 2 THEN c * c ELSE 0 END) / sum(c * c) AS dct_low,
  sum(CASE WHEN k >= 2 AND k < 4 THEN c * c ELSE 0 END) / sum(c * c) AS dct_mid,
  sum(CASE WHEN k >= 4 THEN c * c ELSE 0 END) / sum(c * c) AS dct_high,
  sum(CASE WHEN k >= 4 THEN c * c ELSE 0 END) / sum(CASE WHEN k < 2 THEN c * c ELSE 0 END) AS high_low_ratio
FROM rd GROUP BY 1""")
query("r3_dct2", "sample_id:l vv:l uu:l c:d", lambda V: spectral.dct2(V.grids, K, W, H),
      f"WITH {dct2_sql('v_cells')} SELECT * FROM dc")
query("r3_idct2_round_trip", "sample_id:l idx:l v:d",
      lambda V: spectral.idct2(spectral.dct2(V.grids, K, W, H), K, W, H).select(K, F.posexplode("vals").alias("idx", "v")),
      "SELECT sample_id, idx, v FROM v_cells")
query("r4_dct_low_energy", "sample_id:l low:d high:d low_share_ac:d",
      lambda V: spectral.dct_low_energy(V.grids, K, W, H), f"""
WITH {dct2_sql('v_cells')} SELECT sample_id, sum(CASE WHEN vv < 3 AND uu < 3 THEN c * c ELSE 0 END) AS low,
  sum(CASE WHEN vv < 3 AND uu < 3 THEN 0 ELSE c * c END) AS high,
  sum(CASE WHEN vv < 3 AND uu < 3 AND vv + uu > 0 THEN c * c ELSE 0 END) / sum(CASE WHEN vv + uu > 0 THEN c * c ELSE 0 END) AS low_share_ac
FROM dc GROUP BY 1""")


def _bands(V):
    lo = spectral.band_filter(V.grids, W, H, 3).withColumn("band", F.lit("low"))
    hi = spectral.band_filter(V.grids, W, H, 3, highpass=True).withColumn("band", F.lit("high"))
    return lo.unionByName(hi).select(K, "band", F.posexplode("vals").alias("idx", "v"))


query("r5_band_filter", "sample_id:l band:s idx:l v:d", _bands, f"""
WITH {dct2_sql('v_cells')}, lowc AS (SELECT * FROM dc WHERE vv < 3 AND uu < 3),
{idct2_sql('lowc')}
SELECT sample_id, 'low' AS band, idx, v FROM inv
UNION ALL SELECT sample_id, 'high', inv.idx, c.v - inv.v FROM inv JOIN v_cells c USING (sample_id, idx)""")
query("r6_spectral_sparsity", "sample_id:l row0:d low_modes:d",
      lambda V: spectral.spectral_sparsity(V.grids, K, W, H), f"""
WITH {RD}, a AS (SELECT sample_id, abs(c) AS c, max(abs(c)) OVER (PARTITION BY sample_id) AS m FROM rd WHERE y = 0),
mx AS (SELECT sample_id, u, w, abs(sum(v * cos(pi() * u * (2 * x + 1) / 16) * cos(pi() * w * (2 * y + 1) / 16))) AS c
  FROM v_cells, range(4) q(u), range(4) p(w) WHERE u + w > 0 GROUP BY ALL),
b AS (SELECT sample_id, c, max(c) OVER (PARTITION BY sample_id) AS m FROM mx)
SELECT sample_id, avg(CASE WHEN a.c / a.m > 0.01::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS row0, any_value(s) AS low_modes
FROM a JOIN (SELECT sample_id, avg(CASE WHEN c > m * 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS s FROM b GROUP BY 1) USING (sample_id)
GROUP BY 1""")
query("r7_spectral_slope", "sample_id:l slope:d", lambda V: spectral.spectral_slope(V.grids, K, W, H), f"""
WITH {RD} SELECT sample_id, regr_slope(ln(c * c), ln(k)) AS slope FROM rd
WHERE y = 0 AND k > 0 AND abs(c) > 1e-10 GROUP BY 1""")
query("r8_spectral_peaks", "sample_id:l peaks:d", lambda V: spectral.spectral_peaks(V.grids, K, W, H), f"""
WITH {RD}, s AS (SELECT sample_id, k, sum(abs(c)) AS a FROM rd GROUP BY ALL),
n AS (SELECT *, lag(a) OVER w AS p, lead(a) OVER w AS q, max(CASE WHEN k > 0 THEN a END) OVER (PARTITION BY sample_id) AS m
  FROM s WINDOW w AS (PARTITION BY sample_id ORDER BY k))
SELECT sample_id, sum(CASE WHEN k BETWEEN 1 AND 6 AND a > p AND a > q AND a > m * 0.1::DOUBLE THEN 1 ELSE 0 END) / 8.0::DOUBLE AS peaks
FROM n GROUP BY 1""")
query("r9_dominant_modes", "sample_id:l rank:l uu:l vv:l energy:d concentration:d",
      lambda V: spectral.dominant_modes(V.grids, K, W, H), f"""
WITH {dct2_sql('v_cells')}, e AS (SELECT sample_id, uu, vv, c * c AS energy, vv * 8 + uu AS idx FROM dc WHERE vv + uu > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY energy DESC, idx) AS rank,
  sum(energy) OVER (PARTITION BY sample_id ORDER BY energy DESC, idx ROWS UNBOUNDED PRECEDING)
   / sum(energy) OVER (PARTITION BY sample_id) AS concentration FROM e)
SELECT * FROM r WHERE rank <= 10""")
query("r10_sign_surrogate", "sample_id:l idx:l v:d",
      lambda V: spectral.sign_surrogate(V.grids, K, W, H, 5).select(K, F.posexplode("vals").alias("idx", "v")), f"""
WITH {dct2_sql('v_cells')}, fl AS (SELECT sample_id, vv, uu, CASE WHEN vv + uu = 0
    OR ('0x' || substr(md5('5:' || sample_id || ':' || vv || ':' || uu), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.5::DOUBLE
   THEN c ELSE -c END AS c FROM dc), {idct2_sql('fl')} SELECT sample_id, idx, v FROM inv""")
query("r14_highpass_corr", "pair_id:l corr:d", lambda V: spectral.highpass_corr(V.pair_grids, W, H), f"""
WITH {dct2_sql('v_pairs_cells', 'df', 'pair_id', 'f')}, {dct2_sql('v_pairs_cells', 'dt', 'pair_id', 't')}
SELECT pair_id, sum(df.c * dt.c) / sqrt(sum(df.c * df.c) * sum(dt.c * dt.c)) AS corr
FROM df JOIN dt USING (pair_id, vv, uu) WHERE NOT (vv < 3 AND uu < 3) GROUP BY 1""")

# -- degradations --------------------------------------------------------------------------------------


def _degraded(*units):
    def plan(V):
        arms = [degrade.degrade_arrays(V.grids, u, W, H).withColumn("unit", F.lit(u)) for u in units]
        out = arms[0]
        for a in arms[1:]:
            out = out.unionByName(a)
        return out.select(K, "unit", F.posexplode("vals").alias("idx", "v"))
    return plan


RANGED = "(SELECT *, min(v) OVER (PARTITION BY sample_id) AS lo, max(v) OVER (PARTITION BY sample_id) AS hi FROM v_cells)"


def degradation(name, units: dict, src="v_cells"):
    sql = " UNION ALL ".join(f"SELECT sample_id, '{u}' AS unit, idx, {e} AS v FROM {src}" for u, e in units.items())
    query(name, "sample_id:l unit:s idx:l v:d", _degraded(*units), sql)


D = "::DOUBLE"
degradation("o1_to_float32", {"float32": "v::FLOAT::DOUBLE"})
degradation("o2_to_float16", {"float16": half_sql("v"), "decimal3": f"round_even(v * 1000.0{D}, 0) / 1000.0{D}"})
degradation("o3_quantize_minmax", {"q255": f"trunc((v - lo) / (hi - lo) * 255.0{D}) / 255.0{D}",
                                   "q15": f"trunc((v - lo) / (hi - lo) * 15.0{D}) / 15.0{D}"}, RANGED)
degradation("o4_quantize_fixed", {"uint8": f"-1.0{D} + round_even((least(greatest(v, -1), 1) + 1.0{D}) / 2.0{D} * 255.0{D}, 0) / 255.0{D} * 2.0{D}"})
degradation("o5_snap_step", {"step": f"round_even(v / 0.008{D}, 0) * 0.008{D}"})
degradation("o6_fixed_point_q15", {"q15_fixed": f"least(greatest(round_even(v * 32768.0{D}, 0), -32768), 32767) / 32768.0{D}"})
degradation("o7_nearest_state", {
    "states13": f"-1.0{D} + least(greatest(ceil((v + 1.0{D}) * 6.0{D} - 0.5{D}), 0), 12) * (2.0{D} / 12)",
    "states21": f"-1.0{D} + least(greatest(round_even((v + 1.0{D}) * 10.0{D}, 0), 0), 20) * (2.0{D} / 20)"})
FOLD = f"(round_even(v / 0.05{D}, 0) * 0.05{D})"
degradation("o8_residue_fold", {
    "residue": f"""CASE WHEN (round_even(v * 50000.0{D}, 0) - floor(round_even(v * 50000.0{D}, 0) / 100003.0{D}) * 100003.0{D}) >= 50001
       THEN (round_even(v * 50000.0{D}, 0) - floor(round_even(v * 50000.0{D}, 0) / 100003.0{D}) * 100003.0{D}) - 100003.0{D}
       ELSE (round_even(v * 50000.0{D}, 0) - floor(round_even(v * 50000.0{D}, 0) / 100003.0{D}) * 100003.0{D}) END / 50000.0{D}""",
    "fold": f"""CASE WHEN abs({FOLD}) > 0.6{D} THEN round_even((({FOLD} + 0.6{D}) - floor(({FOLD} + 0.6{D}) / 1.2{D}) * 1.2{D} - 0.6{D}) / 0.05{D}, 0) * 0.05{D}
       ELSE {FOLD} END"""})
_A = "CASE WHEN v <> 0 THEN abs(v) ELSE 1.0::DOUBLE END"


def _mant(bits, fn):
    u = f"pow(2.0{D}, {EXP2.format(a='(' + _A + ')')} + 1 - {bits})"
    return f"CASE WHEN v = 0 THEN 0 ELSE {fn}(v / {u}) * {u} END"


degradation("o9_truncate_mantissa", {"mantissa5": _mant(5, "floor"), "mantissa3": _mant(3, "trunc")})
degradation("o10_lut_snap", {"lut16": f"lo + round_even((v - lo) / (hi - lo) * 15.0{D}, 0) * (hi - lo) / 15.0{D}"}, RANGED)
degradation("o11_level_quantize", {"levels12": f"lo + least(trunc((v - lo) / (hi - lo) * 12.0{D}), 11) * (hi - lo) / 12.0{D}"}, RANGED)
query("o12_block_sample", "sample_id:l unit:s idx:l v:d", _degraded("block4"), """
SELECT a.sample_id, 'block4' AS unit, a.idx, b.v FROM v_cells a JOIN v_cells b ON b.sample_id = a.sample_id
 AND b.y = least((a.y // 4) * 4 + 2, 7) AND b.x = least((a.x // 4) * 4 + 2, 7)""")
query("o13_avg_pool", "sample_id:l y:l x:l v:d", lambda V: degrade.avg_pool(V.cells, K), """
SELECT sample_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM v_cells GROUP BY ALL""")


def u_sql(*parts):
    key = " || ':' || ".join(parts)
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


degradation("o14_add_noise", {
    "noise": f"v + ({u_sql(chr(39) + '11' + chr(39), 'sample_id', 'idx')} - 0.5{D}) * 0.1{D}",
    "gauss": f"v + sqrt(-2.0{D} * ln(greatest({u_sql(chr(39) + '13' + chr(39), 'sample_id', 'idx', chr(39) + 'a' + chr(39))}, 1.0{D} / 4294967296.0{D})))"
             f" * cos(2.0{D} * pi() * {u_sql(chr(39) + '13' + chr(39), 'sample_id', 'idx', chr(39) + 'b' + chr(39))}) * 0.02{D}"})
degradation("o15_hash_blend", {"hash": f"v * 0.95{D} + ('0x' || substr(md5(sample_id || ':' || idx || ':' || floor(v * 10000000000.0{D})::BIGINT), 1, 8))::BIGINT / 4294967295.0{D} * 0.05{D}"})
degradation("o16_xor_position", {"xor": f"xor(trunc(v * 1023.0{D})::BIGINT & 1023, (idx * 7) & 1023) / 1023.0{D}"})
degradation("o17_smooth_squash", {"tanh": f"tanh(v * 1.001{D}) / 1.001{D}", "rational": f"v / (1.0{D} + abs(v))"})
query("o18_subsample_time", "series_id:l t:l idx:l v:d", lambda V: degrade.subsample_time(V.frames, "series_id", 4), """
SELECT series_id, t, idx, v FROM (SELECT *, max(t) OVER (PARTITION BY series_id) AS last FROM v_frames)
WHERE (t - 1) % 4 = 0 OR t = last""")

# -- Fourier surrogates ----------------------------------------------------------------------------------


def dft_sql(src, keys, name, v="v"):
    """Padded spectrum of (keys, t, v) by direct summation."""
    k = [c.strip() for c in keys.split(",")]
    on = " AND ".join(f"s.{c} = n.{c}" for c in k)
    nk = ", ".join(f"n.{c}" for c in k)
    return f"""
{name}_n AS (SELECT {keys}, max(t) AS len, pow(2, ceil(log2(max(t))))::BIGINT AS n FROM {src} GROUP BY ALL),
{name}_k AS (SELECT *, unnest(range(n)) AS i FROM {name}_n),
{name} AS (SELECT {nk}, n.n, n.len, n.i, sum({v} * cos(2 * pi() * ((i * (t - 1)) % n) / n)) AS re, -sum({v} * sin(2 * pi() * ((i * (t - 1)) % n) / n)) AS im
  FROM {name}_k n JOIN {src} s ON {on} GROUP BY ALL)"""


def idft_sql(src, keys, name):
    return f"""
{name} AS (SELECT {keys}, t, sum(re * cos(2 * pi() * ((i * (t - 1)) % n) / n) - im * sin(2 * pi() * ((i * (t - 1)) % n) / n)) / any_value(n) AS v
  FROM (SELECT *, unnest(range(1, len + 1)) AS t FROM {src}) GROUP BY ALL)"""


def phase_sql(src, keys, name, seed):
    parts = [f"'{seed}'"] + [c.strip() for c in keys.split(",")] + ["least(i, n - i)"]
    ph = f"(2 * pi() * {u_sql(*parts)} - pi())"
    return f"""
{name} AS (SELECT {keys}, n, len, i, CASE WHEN i = 0 OR 2 * i = n THEN re ELSE sqrt(re * re + im * im) * cos({ph}) END AS re,
  CASE WHEN i = 0 OR 2 * i = n THEN 0 ELSE CASE WHEN 2 * i < n THEN 1 ELSE -1 END * sqrt(re * re + im * im) * sin({ph}) END AS im FROM {src})"""


query("r11_phase_surrogate", "series_id:l t:l v:d", lambda V: surrogates.phase_surrogate(V.series, "series_id", "ph"), f"""
WITH {dft_sql('v_series', 'series_id', 'sp')}, {phase_sql('sp', 'series_id', 'ps', 'ph')}, {idft_sql('ps', 'series_id', 'bk')} SELECT * FROM bk""")
query("r12_trajectory_surrogate", "series_id:l idx:l t:l v:d",
      lambda V: surrogates.trajectory_surrogate(V.frames, "tr"), f"""
WITH {dft_sql('v_frames', 'series_id, idx', 'sp')}, {phase_sql('sp', 'series_id, idx', 'ps', 'tr')}, {idft_sql('ps', 'series_id, idx', 'bk')} SELECT * FROM bk""")


def _spectrum_match(V):
    s = V.pairs_cells
    pos = (F.col("idx") + 1).alias("t")
    return surrogates.spectrum_match(s.select("pair_id", pos, F.col("f").alias("v")), s.select("pair_id", pos, F.col("t").alias("v")), "pair_id")


query("r13_spectrum_match", "pair_id:l t:l v:d", _spectrum_match, f"""
WITH a AS (SELECT pair_id, idx + 1 AS t, f AS v FROM v_pairs_cells), b AS (SELECT pair_id, idx + 1 AS t, v_pairs_cells.t AS v FROM v_pairs_cells),
{dft_sql('a', 'pair_id', 'sa')}, {dft_sql('b', 'pair_id', 'sb')},
ra AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY mag, i) AS r FROM (SELECT *, floor(sqrt(re * re + im * im) * 1000000000.0{D} + 0.5{D}) / 1000000000.0{D} AS mag FROM sa)),
rb AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY mag, i) AS r, mag AS new FROM (SELECT *, floor(sqrt(re * re + im * im) * 1000000000.0{D} + 0.5{D}) / 1000000000.0{D} AS mag FROM sb)),
mt AS (SELECT pair_id, n, len, i, re * new / mag AS re, im * new / mag AS im FROM ra JOIN rb USING (pair_id, r)), {idft_sql('mt', 'pair_id', 'bk')}
SELECT pair_id, t, least(greatest(v, -1.5), 1.5) AS v FROM bk""")
