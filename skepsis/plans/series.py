"""Queries over series, trajectories and logs."""
from pyspark.sql import functions as F

from ..operators import marginal, scale, sequence as seq
from .fixtures import H, W
from .spec import query

K = "series_id"
WS = "WINDOW w AS (PARTITION BY series_id ORDER BY t)"
ENT = "greatest(ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n), 0)"

query("w1_running_count", "series_id:l t:l count:l inverse:d", lambda V: seq.running_count(V.series), """
SELECT series_id, t, sum(flag) OVER w AS count, 1.0::DOUBLE / greatest(sum(flag) OVER w, 1) AS inverse
FROM v_series WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)""")
query("w2_increments", "series_id:s t:l inc:d", lambda V: seq.increments(V.type_series), f"""
SELECT series_id, t, inc FROM (SELECT series_id, t, v - lag(v) OVER w AS inc FROM v_type_series {WS}) WHERE inc IS NOT NULL""")
query("w3_residual", "series_id:s t:l residual:d",
      lambda V: seq.residual(V.type_series, seq.moving_average_clamped(V.type_series, 21).select(
          K, "t", F.col("ma").alias("v"))), """
SELECT series_id, t, v - (sum(v) OVER b + greatest(0, 11 - t) * first_value(v) OVER a + greatest(0, t + 10 - count(*) OVER p) * last_value(v) OVER a) / 21 AS residual
FROM v_type_series WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING),
 a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), p AS (PARTITION BY series_id)""")
query("w4_moving_average_clamped", "series_id:s t:l ma:d", lambda V: seq.moving_average_clamped(V.type_series, 21), """
SELECT series_id, t, (sum(v) OVER b + greatest(0, 11 - t) * first_value(v) OVER a + greatest(0, t + 10 - count(*) OVER p) * last_value(v) OVER a) / 21 AS ma
FROM v_type_series WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING),
 a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), p AS (PARTITION BY series_id)""")
query("w5_detrend_available", "series_id:s t:l detrended:d",
      lambda V: seq.detrend_available(V.type_series.filter("flag = 0")), """
SELECT series_id, t, v - avg(v) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS detrended
FROM v_type_series WHERE flag = 0""")
query("w6_standardize", "series_id:s t:l standard:d centred:d scaled:d", lambda V: seq.standardize(V.type_series), """
WITH r AS (SELECT series_id, avg(v) AS m, var_pop(v) AS var, avg(v * v) AS ms FROM v_type_series WHERE t <= 200 GROUP BY 1)
SELECT series_id, t, (v - m) / sqrt(var) AS standard, v - m AS centred, v / sqrt(ms) AS scaled FROM v_type_series JOIN r USING (series_id)""")
query("w7_zscore_full", "series_id:s t:l z:d rms_matched:d", lambda V: seq.zscore_full(V.type_series, target_rms=2.5), """
SELECT series_id, t, (v - avg(v) OVER p) / stddev_pop(v) OVER p AS z, (v - avg(v) OVER p) / stddev_pop(v) OVER p * 2.5::DOUBLE AS rms_matched
FROM v_type_series WINDOW p AS (PARTITION BY series_id)""")
query("w8_match_moments", "series_id:s t:l matched:d",
      lambda V: seq.match_moments(V.type_series, V.type_series.withColumn("v", F.ln(F.col("v") + 1.0))), """
WITH r AS (SELECT series_id, avg(v) AS m, stddev_pop(v) AS s, avg(ln(v + 1.0::DOUBLE)) AS tm, stddev_pop(ln(v + 1.0::DOUBLE)) AS tsd
  FROM v_type_series WHERE t <= 200 GROUP BY 1)
SELECT series_id, t, tm + tsd * ((v - m) / s) AS matched FROM v_type_series JOIN r USING (series_id)""")
query("w9_autocorr", "series_id:s lag:l acf:d", lambda V: seq.autocorr(V.type_series), """
WITH m AS (SELECT series_id, avg(v) AS m, var_pop(v) * count(*) AS ss FROM v_type_series GROUP BY 1),
l AS (SELECT unnest([1, 2, 3, 4, 8]) AS lag)
SELECT a.series_id, lag, sum((a.v - m) * (b.v - m)) / any_value(ss) AS acf FROM v_type_series a JOIN m USING (series_id), l,
 v_type_series b WHERE b.series_id = a.series_id AND b.t = a.t + lag GROUP BY ALL""")
query("w10_permutation_entropy", "series_id:l perm_entropy:d", lambda V: seq.permutation_entropy(V.series), f"""
WITH e AS (SELECT series_id, v AS a, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c, lead(v, 3) OVER w AS d FROM v_series {WS}),
p AS (SELECT series_id, (b < a)::INT || '' || (c < a)::INT || (d < a)::INT || (c < b)::INT || (d < b)::INT || (d < c)::INT AS p, count(*) AS n
  FROM e WHERE d IS NOT NULL GROUP BY ALL),
h AS (SELECT series_id, {ENT} / ln(24) AS h FROM p GROUP BY 1)
SELECT series_id, coalesce(any_value(h), 0) AS perm_entropy FROM v_series LEFT JOIN h USING (series_id) GROUP BY 1""")
BIN = """
bn AS (SELECT series_id, t, v, CASE WHEN hi > lo THEN least(trunc((v - lo) / (hi - lo) * {k}.0::DOUBLE), {k} - 1) ELSE 0 END AS b FROM (
  SELECT *, min(v) OVER (PARTITION BY series_id) AS lo, max(v) OVER (PARTITION BY series_id) AS hi FROM v_series))"""
query("w11_transition_entropy", "series_id:l transition_entropy:d", lambda V: seq.transition_entropy(V.series), f"""
WITH {BIN.format(k=8)}, tr AS (SELECT series_id, b, nb, count(*) AS n FROM (SELECT *, lead(b) OVER w AS nb FROM bn {WS}) WHERE nb IS NOT NULL GROUP BY ALL)
SELECT series_id, CASE WHEN sum(n) > 1 THEN {ENT} / ln(sum(n)::DOUBLE) ELSE 0 END AS transition_entropy FROM tr GROUP BY 1""")
query("w12_cycle_period", "series_id:l period:d", lambda V: seq.cycle_period(V.series), """
WITH p AS (SELECT series_id, t, v, lag(v) OVER w AS p, avg(v) OVER (PARTITION BY series_id) AS m FROM v_series WINDOW w AS (PARTITION BY series_id ORDER BY t)),
g AS (SELECT series_id, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS gap FROM p WHERE p < m AND m <= v),
a AS (SELECT series_id, avg(gap) AS g FROM g GROUP BY 1), n AS (SELECT series_id, count(*) AS n FROM v_series GROUP BY 1)
SELECT series_id, coalesce(g, n) AS period FROM n LEFT JOIN a USING (series_id)""")
query("w13_sign_run_entropy", "series_id:l sign_run_entropy:d", lambda V: seq.sign_run_entropy(V.series), f"""
WITH s AS (SELECT series_id, t, CASE WHEN v >= p THEN 1 ELSE 0 END AS s FROM (SELECT *, lag(v) OVER w AS p FROM v_series {WS}) WHERE p IS NOT NULL),
r AS (SELECT series_id, s, t - row_number() OVER (PARTITION BY series_id, s ORDER BY t) AS g FROM s),
l AS (SELECT series_id, s, g, count(*) AS len FROM r GROUP BY ALL),
c AS (SELECT series_id, len, count(*)::DOUBLE AS c FROM l GROUP BY ALL),
q AS (SELECT series_id, c, sum(c * len) OVER (PARTITION BY series_id) AS tot FROM c)
SELECT series_id, -sum(c / tot * ln(c / tot)) / ln(2) AS sign_run_entropy FROM q GROUP BY 1""")
query("w14_run_length_stats", "sample_id:l run_mean:d run_std:d runs:l runs_per_element:d rle_ratio:d",
      lambda V: seq.run_length_stats(V.cells.withColumn("q", seq.byte_level(F.col("v") * 0.05)), "sample_id", "idx", "q"), """
WITH q AS (SELECT sample_id, idx, trunc(v * 0.05::DOUBLE * 256.0::DOUBLE)::BIGINT & 255 AS q FROM v_cells),
g AS (SELECT sample_id, q, idx - row_number() OVER (PARTITION BY sample_id, q ORDER BY idx) AS g FROM q),
r AS (SELECT sample_id, q, g, count(*) AS n FROM g GROUP BY ALL)
SELECT sample_id, avg(n) AS run_mean, stddev_pop(n) AS run_std, count(*) AS runs, count(*) / sum(n)::DOUBLE AS runs_per_element,
 2.0::DOUBLE * count(*) / sum(n) AS rle_ratio FROM r GROUP BY 1""")
query("w15_step_stats", "series_id:l drift:d mean_abs_step:d frozen:d inc_skew:d inc_kurt:d", lambda V: seq.step_stats(V.series), f"""
WITH i AS (SELECT series_id, inc, avg(inc) OVER (PARTITION BY series_id) AS m FROM (SELECT series_id, v - lag(v) OVER w AS inc FROM v_series {WS}) WHERE inc IS NOT NULL),
s AS (SELECT series_id, avg(abs(inc)) AS mean_abs_step, avg(pow(inc - m, 3)) / pow(stddev_pop(inc), 3) AS inc_skew,
  avg(pow(inc - m, 4)) / pow(stddev_pop(inc), 4) - 3 AS inc_kurt FROM i GROUP BY 1)
SELECT series_id, abs(max_by(v, t) - min_by(v, t)) AS drift, any_value(mean_abs_step) AS mean_abs_step,
 CASE WHEN max(v) - min(v) < 1e-12 THEN 1.0 ELSE 0 END AS frozen, any_value(inc_skew) AS inc_skew, any_value(inc_kurt) AS inc_kurt
FROM v_series JOIN s USING (series_id) GROUP BY 1""")
query("w15_var_of_var", "series_id:l var_of_var:d12 frozen_fraction:d", lambda V: seq.var_of_var(V.frames), """
SELECT series_id, var_samp(cv) AS var_of_var, avg(fz) AS frozen_fraction FROM (
 SELECT series_id, idx, var_samp(v) AS cv, CASE WHEN max(v) - min(v) < 1e-12 THEN 1.0::DOUBLE ELSE 0 END AS fz FROM v_frames GROUP BY ALL) GROUP BY 1""")
query("w16_mean_series", "series_id:l t:l v:d", lambda V: seq.mean_series(V.frames), """
SELECT series_id, t, avg(v) AS v FROM v_frames GROUP BY ALL""")
query("w16_cell_series", "series_id:l t:l idx:l v:d", lambda V: seq.cell_series(V.frames, W * H, 6), """
SELECT * FROM v_frames WHERE idx IN (5, 16, 26, 37, 48, 58)""")
query("w17_recurrence_density", "series_id:l density:d", lambda V: seq.recurrence_density(V.series), """
WITH s AS (SELECT series_id, 0.1::DOUBLE * stddev_pop(v) AS tol FROM v_series GROUP BY 1)
SELECT a.series_id, avg(CASE WHEN abs(a.v - b.v) < tol THEN 1.0::DOUBLE ELSE 0 END) AS density
FROM v_series a JOIN s USING (series_id) JOIN v_series b ON b.series_id = a.series_id AND b.t >= a.t + 2 GROUP BY 1""")
query("j15_eps_pairs_1d", "series_id:l pairs:l",
      lambda V: seq.count_close_pairs(V.series.select(K, "t", "v").withColumn("tol", F.lit(1.505)), K, "v", "tol"), """
SELECT a.series_id, sum(CASE WHEN abs(a.v - b.v) < 1.505::DOUBLE THEN 1 ELSE 0 END) AS pairs
FROM v_series a JOIN v_series b ON b.series_id = a.series_id AND b.t >= a.t + 2 GROUP BY 1""")
EMB = f"""
em AS (SELECT series_id, t, v AS x0, lead(v, 2) OVER w AS x1, lead(v, 4) OVER w AS x2 FROM v_series {WS}),
sd AS (SELECT series_id, stddev_samp(v) AS s FROM v_series GROUP BY 1),
cs AS (SELECT a.series_id, sum(CASE WHEN d < 0.1::DOUBLE * s THEN 1 ELSE 0 END) AS c1, sum(CASE WHEN d < 0.4::DOUBLE * s THEN 1 ELSE 0 END) AS c2
  FROM (SELECT a.series_id, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) AS d
    FROM em a JOIN em b ON b.series_id = a.series_id AND b.t > a.t WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL) a JOIN sd USING (series_id) GROUP BY 1)"""


def _points(V):
    d = marginal.with_stats(V.series.select(K, "t", "v"), K, _sd=F.stddev_samp("v"))
    e = seq.embed(d, 3, 2, K).join(d.groupBy(K).agg(F.max("_sd").alias("_s")), K)
    return e.withColumns({"r1": 0.1 * F.col("_s"), "r2": 0.4 * F.col("_s")})


query("j16_eps_pairs_nd", "series_id:l c1:l c2:l",
      lambda V: V.series.select(K).distinct().join(
          seq.count_close_points(_points(V), K, {"c1": "r1", "c2": "r2"}), K, "left").fillna(0), f"WITH {EMB} SELECT * FROM cs")
query("w18_corr_dimension", "series_id:l corr_dim:d", lambda V: seq.corr_dimension(V.series), f"""
WITH {EMB} SELECT series_id, CASE WHEN c1 > 0 AND c1 < c2 THEN ln(c2 / c1::DOUBLE) / ln(4) ELSE 0 END AS corr_dim FROM cs""")
query("w19_log_growth", "series_id:l log_growth:d", lambda V: seq.log_growth(V.series), f"""
WITH i AS (SELECT series_id, t, abs(v - lag(v) OVER w) AS i FROM v_series {WS})
SELECT series_id, avg(ln((i + 1e-15) / (p + 1e-15))) AS log_growth FROM (
 SELECT series_id, i, lag(i) OVER w AS p FROM i {WS}) WHERE p IS NOT NULL GROUP BY 1""")
query("w20_occupancy_entropy", "series_id:l entropy:d", lambda V: marginal.hist_entropy(V.series, K, bins=10), f"""
WITH {BIN.format(k=10)} SELECT series_id, {ENT} / ln(2) AS entropy FROM (SELECT series_id, b, count(*) AS n FROM bn GROUP BY ALL) GROUP BY 1""")
query("w21_return_time_std", "series_id:l return_time_std:d", lambda V: seq.return_time_std(V.series), f"""
WITH {BIN.format(k=4)}, g AS (SELECT series_id, t - lag(t) OVER (PARTITION BY series_id, b ORDER BY t) AS g FROM bn)
SELECT series_id, CASE WHEN count(g) > 2 THEN stddev_samp(g) ELSE 0 END AS return_time_std FROM g GROUP BY 1""")
query("w22_frame_divergence", "series_id:l divergence:d divergence_var:d9 unchanged_fraction:d",
      lambda V: seq.frame_divergence(V.frame_grids, W * H), """
WITH d AS (SELECT series_id, t, avg(abs(v - p)) AS dv, avg(CASE WHEN v = p THEN 1.0::DOUBLE ELSE 0 END) AS same FROM (
  SELECT *, lag(v) OVER (PARTITION BY series_id, idx ORDER BY t) AS p FROM v_frames) WHERE p IS NOT NULL GROUP BY ALL)
SELECT series_id, avg(dv) AS divergence, var_samp(dv) AS divergence_var, max_by(same, t) AS unchanged_fraction FROM d GROUP BY 1""")


def _shifts(V):
    s = V.type_series.select(K, "t", "v")
    return seq.circular_shift(s, 37).withColumn("kind", F.lit("shift")).unionByName(
        seq.reverse(s).withColumn("kind", F.lit("reverse")))


query("w23_circular_shift", "series_id:s kind:s t:l v:d", _shifts, """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM v_type_series)
SELECT a.series_id, 'shift' AS kind, a.t, b.v FROM n a JOIN n b ON b.series_id = a.series_id AND b.t = (a.t - 1 - 37 + a.n) % a.n + 1
UNION ALL SELECT series_id, 'reverse', n + 1 - t, v FROM n""")
EV = """
ev AS (SELECT series_id, t AS pos, flag * v AS amp, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM v_type_series WHERE flag * v <> 0),
eg AS (SELECT e.*, coalesce(lead(pos) OVER (PARTITION BY series_id ORDER BY pos) - pos, n - pos + first_value(pos) OVER (PARTITION BY series_id ORDER BY pos)) AS gap
  FROM ev e JOIN (SELECT series_id, count(*) AS n FROM v_type_series GROUP BY 1) USING (series_id))"""
query("w24_event_positions_gaps", "series_id:s k:l pos:l amp:d gap:l",
      lambda V: seq.event_positions_gaps(V.type_series.withColumn("v", F.col("flag") * F.col("v"))), f"WITH {EV} SELECT * FROM eg")


def _profile(V):
    p = V.evals.groupBy("run_id", "step").agg(F.avg("score").alias("v"))
    return scale.dense_position(p, "run_id", "step", F.floor(F.col("step") / 12))


query("w25_monotone_profile", "run_id:s monotone:b gradient:d", lambda V: seq.monotone_profile(_profile(V), "run_id"), """
WITH p AS (SELECT run_id, step, avg(score) AS v FROM v_evals GROUP BY ALL)
SELECT run_id, bool_and(coalesce(v >= l - 1e-12, true)) AS monotone, max_by(v, step) - min_by(v, step) AS gradient FROM (
 SELECT *, lag(v) OVER (PARTITION BY run_id ORDER BY step) AS l FROM p) GROUP BY 1""")
query("w26_running_best", "run_id:s t:l candidate_id:l best:d improved:b since:l",
      lambda V: seq.running_best(scale.dense_position(
          V.evals, "run_id", ["step", "candidate_id"], F.col("step")), "run_id"), """
WITH p AS (SELECT run_id, candidate_id, score, row_number() OVER (PARTITION BY run_id ORDER BY step, candidate_id) AS t FROM v_evals),
b AS (SELECT *, max(score) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p),
i AS (SELECT *, prev IS NULL OR score > prev AS improved, greatest(score, coalesce(prev, score)) AS best FROM b)
SELECT *, t - max(CASE WHEN improved THEN t END) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS since FROM i""")
query("w27_state_revisit", "series_id:l revisit:d", lambda V: seq.state_revisit(V.frame_grids, decimals=0), """
WITH s AS (SELECT series_id, t, string_agg(floor(v + 0.5::DOUBLE)::BIGINT, ',' ORDER BY idx) AS s, sqrt(sum(v * v)) AS n FROM v_frames GROUP BY ALL)
SELECT series_id, 1.0::DOUBLE - count(DISTINCT s) / count(*)::DOUBLE AS revisit FROM s WHERE n > 1e-6 GROUP BY 1""")

# -- aggregations over series and logs ------------------------------------------------------------

query("a10_quantiles", "name:s q25:d q50:d q95:d i50:d i90:d",
      lambda V: marginal.quantile_interp(V.named_series, "name", "v", {"q25": 0.25, "q50": 0.5, "q95": 0.95}).join(
          marginal.quantile_index(V.named_series, "name", "v", {"i50": 0.5, "i90": 0.9}), "name"), """
WITH o AS (SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY v) AS r, count(*) OVER (PARTITION BY name) AS n FROM v_named_series)
SELECT name, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.95) AS q95,
 max(CASE WHEN r = floor(0.5::DOUBLE * n) + 1 THEN v END) AS i50, max(CASE WHEN r = floor(0.9::DOUBLE * n) + 1 THEN v END) AS i90 FROM o GROUP BY 1""")
query("a12_grouped_counts", "run_id:s model:s role:s n:l set_id:l",
      lambda V: marginal.grouped_counts(V.evals, [["run_id"], ["model"], ["role"], ["run_id", "model", "role"]]), """
SELECT run_id, model, role, count(*) AS n, grouping_id(run_id, model, role) AS set_id FROM v_evals
GROUP BY GROUPING SETS ((run_id), (model), (role), (run_id, model, role))""")
query("a13_best_of", "run_id:s role:s candidate_id:l score:d cr:d",
      lambda V: marginal.best_of(V.evals, ["run_id", "role"], keep=("cr",)), """
SELECT run_id, role, candidate_id, score, cr FROM (SELECT *, row_number() OVER (PARTITION BY run_id, role ORDER BY score DESC, candidate_id) AS r
 FROM v_evals WHERE status = 'OK' AND score IS NOT NULL) WHERE r = 1""")
query("a14_count_by_role", "run_id:s role:s n:l n_ok:l", lambda V: marginal.count_by_role(V.evals, ["run_id", "role"]), """
SELECT run_id, role, count(*) AS n, count(CASE WHEN status = 'OK' THEN 1 END) AS n_ok FROM v_evals GROUP BY ALL""")
query("a15_reference_stats", "series_id:s mean:d rms:d min:d max:d nonzero:l", lambda V: marginal.reference_stats(V.type_series, K), """
SELECT series_id, avg(v) AS mean, sqrt(avg(v * v)) AS rms, min(v) AS min, max(v) AS max, count(CASE WHEN abs(v) > 1e-18 THEN 1 END) AS nonzero
FROM v_type_series WHERE t <= 200 GROUP BY 1""")
query("a16_compare_series", "series_id:s max_abs:d mean_abs:d rmse:d corr:d n:l",
      lambda V: marginal.compare_series(V.type_series, seq.circular_shift(V.type_series, 1), [K]), """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM v_type_series),
j AS (SELECT a.series_id, a.v AS a, b.v AS b FROM n a JOIN n b ON b.series_id = a.series_id AND b.t = (a.t - 2 + a.n) % a.n + 1)
SELECT series_id, max(abs(a - b)) AS max_abs, avg(abs(a - b)) AS mean_abs, sqrt(avg((a - b) * (a - b))) AS rmse, corr(a, b) AS corr, count(*) AS n FROM j GROUP BY 1""")
query("a17_event_magnitude", "series_id:s horizon:l events:l rms:d max_abs:d min_abs:d",
      lambda V: marginal.event_magnitude(V.type_series.withColumn("v", F.col("flag") * F.col("v")), K, [100, 500, 1000, 5000]), """
SELECT series_id, h AS horizon, count(CASE WHEN abs(flag * v) > 1e-18 THEN 1 END) AS events, sqrt(avg(flag * v * flag * v)) AS rms,
 coalesce(max(CASE WHEN flag * v <> 0 THEN v END), 0) AS max_abs, coalesce(min(CASE WHEN flag * v <> 0 THEN v END), 0) AS min_abs
FROM v_type_series, (SELECT unnest([100, 500, 1000, 5000]) AS h) WHERE t <= h GROUP BY ALL""")
