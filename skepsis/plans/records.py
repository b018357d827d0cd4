"""Queries over logs and feature tables: leakage, audits, evidence, sweeps, gates, sets, checks."""
from pyspark.sql import functions as F

from ..functions.hashing import stable_seed
from ..functions.numeric import clamp
from ..operators import audit, degrade, evidence, fields, gates, leakage, marginal, models, sphere, sweep
from .experiments import SQL_TRAIN, TEST, is_train, lst, pair_sql
from .fixtures import H, W
from .spec import query

D = "::DOUBLE"
ENT = "greatest(ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n), 0) / ln(2)"

# -- L: leakage -----------------------------------------------------------------------------------------


def mi_sql(src, targets, bins=8):
    arms = " UNION ALL ".join(f"SELECT name, value, '{t}' AS target, CAST({c} AS VARCHAR) AS g FROM {src}" for t, c in targets.items())
    return f"""
rk AS (SELECT DISTINCT name, value, least(floor((rank() OVER (PARTITION BY name ORDER BY value) - 1) * {bins} / count(*) OVER (PARTITION BY name)), {bins - 1}) AS bin FROM {src}),
lr AS ({arms}),
jn AS (SELECT name, target, bin, g, count(*) AS n FROM lr JOIN rk USING (name, value) GROUP BY ALL),
hj AS (SELECT name, target, {ENT} AS h, sum(n) AS n FROM jn GROUP BY ALL),
hb AS (SELECT name, target, {ENT} AS h FROM (SELECT name, target, bin, sum(n) AS n FROM jn GROUP BY ALL) GROUP BY ALL),
hg AS (SELECT name, target, {ENT} AS h, count(*) AS k FROM (SELECT name, target, g, sum(n) AS n FROM jn GROUP BY ALL) GROUP BY ALL),
mi AS (SELECT hj.name, hj.target, hj.n, greatest(hb.h + hg.h - hj.h, 0) AS mi,
   CASE WHEN least(hb.h, hg.h) > 1e-12 THEN greatest(hb.h + hg.h - hj.h, 0) / least(hb.h, hg.h) ELSE 0 END AS mi_min,
   CASE WHEN k > 1 THEN greatest(hb.h + hg.h - hj.h, 0) / log2(k) ELSE 0 END AS mi_groups
  FROM hj JOIN hb USING (name, target) JOIN hg USING (name, target)),
rp AS (SELECT name, max(CASE WHEN target = 'grp' THEN mi_min END) AS mi_grp, max(CASE WHEN target = 'unit' THEN mi_min END) AS mi_unit,
   max(CASE WHEN target = 'seed' THEN mi_min END) AS mi_seed FROM mi GROUP BY 1)"""


TARGETS = {"grp": "grp", "unit": "unit", "seed": "seed_block"}


def _leak(V):
    return leakage.binned_mi(V.unit_features.withColumn("seed_block", F.floor(F.col("seed") / 13)), TARGETS)


LEAK = "sb AS (SELECT *, seed // 13 AS seed_block FROM v_unit_features), " + mi_sql("sb", TARGETS)
query("l1_binned_mi", "name:s target:s n:l mi:d mi_min:d mi_groups:d", _leak, f"WITH {LEAK} SELECT * FROM mi")
query("l1_binned_mi_documents", "name:s target:s n:l mi:d mi_min:d mi_groups:d",
      lambda V: leakage.binned_mi(V.doc_features, {"grp": "grp", "unit": "unit", "seed": "label"}, bins=10),
      f"WITH {mi_sql('v_doc_features', {'grp': 'grp', 'unit': 'unit', 'seed': 'label'}, 10)} SELECT * FROM mi")
query("l2_leakage_report", "name:s mi_grp:d mi_unit:d mi_seed:d blacklisted:b", lambda V: leakage.leakage_report(_leak(V)),
      f"WITH {LEAK} SELECT *, mi_grp >= 0.8 AND mi_unit < 0.2 AS blacklisted FROM rp")
query("l2_leakage_verdict", "mean_grp:d mean_unit:d blacklisted:l verdict:s",
      lambda V: leakage.leakage_verdict(leakage.leakage_report(_leak(V))), f"""
WITH {LEAK}, a AS (SELECT avg(mi_grp) AS mean_grp, avg(mi_unit) AS mean_unit, count(CASE WHEN mi_grp >= 0.8 AND mi_unit < 0.2 THEN 1 END) AS blacklisted FROM rp)
SELECT *, CASE WHEN mean_grp > 1.5 * mean_unit THEN 'GROUP_DOMINANT' WHEN mean_unit > 1.5 * mean_grp THEN 'UNIT_DOMINANT' ELSE 'BALANCED' END AS verdict FROM a""")
query("x3_top_features", "name:s mi_unit:d", lambda V: leakage.top_features(leakage.leakage_report(_leak(V)), 2, "mi_unit"),
      f"WITH {LEAK} SELECT name, mi_unit FROM rp ORDER BY mi_unit DESC, name LIMIT 2")


def _clean(V):
    rep = leakage.leakage_report(_leak(V)).withColumn("blacklisted", F.col("mi_unit") < 0.5)
    d = leakage.without_blacklisted(V.unit_diffs, rep)
    return models.accuracy(models.pairwise_discriminate(d, is_train(), F.col("grp").isin(TEST)), "unit")


query("l3_clean_rerun", "unit:s n:l accuracy:d tie_rate:d", _clean, f"""
WITH {LEAK}, cd AS (SELECT * FROM v_unit_diffs WHERE name NOT IN (SELECT name FROM rp WHERE mi_unit < 0.5)),
{pair_sql('cd', SQL_TRAIN, f"grp IN {lst(TEST)}")}
SELECT unit, count(*) AS n, avg(hit) AS accuracy, avg(CASE WHEN hit = 0.5 THEN 1.0{D} ELSE 0 END) AS tie_rate FROM hits GROUP BY 1""")

# -- L: audits --------------------------------------------------------------------------------------------

DUP = ["run_id", "step", "model", "role", "ci"]
query("l4_duplicate_groups", "run_id:s step:l model:s role:s ci:d n:l first_id:l last_id:l",
      lambda V: audit.duplicate_groups(V.evals, DUP, "candidate_id", {"ci": 1}), """
SELECT run_id, step, model, role, floor(ci * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS ci, count(*) AS n, min(candidate_id) AS first_id, max(candidate_id) AS last_id
FROM v_evals GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1""")
query("l4_duplicate_summary", "unique_keys:l duplicate_groups:l excess_rows:l", lambda V: audit.duplicate_summary(V.evals, DUP), """
SELECT count(*) AS unique_keys, count(CASE WHEN n > 1 THEN 1 END) AS duplicate_groups, sum(n - 1) AS excess_rows
FROM (SELECT count(*) AS n FROM v_evals GROUP BY run_id, step, model, role, ci)""")
query("l4_duplicate_members", "run_id:s step:l model:s role:s ci:d candidate_id:l", lambda V: audit.duplicate_members(V.evals, DUP, "candidate_id"), """
SELECT run_id, step, model, role, ci, candidate_id FROM (SELECT *, count(*) OVER (PARTITION BY run_id, step, model, role, ci) AS n FROM v_evals) WHERE n > 1""")
query("l5_cross_split_duplicates", "n:l splits:l first_id:l", lambda V: audit.cross_split_duplicates(
    V.unit_grids.withColumn("split", F.when(F.col("unit") == "none", "train").otherwise(F.col("split")))
    .withColumn("vals", F.transform("vals", lambda x: F.floor(x * 1e6 + 0.5)))), """
WITH c AS (SELECT sample_id, unit, CASE WHEN unit = 'none' THEN 'train' ELSE split END AS split,
  string_agg(floor(v * 1000000.0::DOUBLE + 0.5::DOUBLE)::BIGINT, ',' ORDER BY idx) AS h FROM v_unit_cells GROUP BY ALL)
SELECT count(*) AS n, count(DISTINCT split) AS splits, min(sample_id) AS first_id FROM c GROUP BY h HAVING count(DISTINCT split) > 1""")
query("l6_missing_id_ranges", "run_id:s first_missing:l last_missing:l", lambda V: audit.missing_id_ranges(
    V.evals, "candidate_id", 0, V.evals.agg(F.max("candidate_id").alias("high")), by="run_id", bucket=512), """
WITH i AS (SELECT run_id, candidate_id AS id, lag(candidate_id, 1, -1) OVER (PARTITION BY run_id ORDER BY candidate_id) AS p FROM v_evals)
SELECT run_id, p + 1 AS first_missing, id - 1 AS last_missing FROM i WHERE id - p > 1
UNION ALL SELECT run_id, max(id) + 1, (SELECT max(candidate_id) FROM v_evals) FROM i GROUP BY 1 HAVING max(id) < (SELECT max(candidate_id) FROM v_evals)""")
REC = ["score", "role", "status"]
query("l7_reconcile", "candidate_id:l side:s cell:s", lambda V: audit.reconcile(V.evals, V.evals_b, "candidate_id", REC), """
WITH j AS (SELECT coalesce(a.candidate_id, b.candidate_id) AS candidate_id, a.candidate_id AS l, b.candidate_id AS r,
  a.score AS s1, b.score AS s2, a.role AS r1, b.role AS r2, a.status AS t1, b.status AS t2 FROM v_evals a FULL JOIN v_evals_b b USING (candidate_id))
SELECT candidate_id, CASE WHEN r IS NULL THEN 'left_only' ELSE 'right_only' END AS side, '*' AS cell FROM j WHERE r IS NULL OR l IS NULL
UNION ALL SELECT candidate_id, 'both', 'score' FROM j WHERE l = r AND s1 IS DISTINCT FROM s2
UNION ALL SELECT candidate_id, 'both', 'role' FROM j WHERE l = r AND r1 IS DISTINCT FROM r2
UNION ALL SELECT candidate_id, 'both', 'status' FROM j WHERE l = r AND t1 IS DISTINCT FROM t2""")
query("l7_reconcile_summary", "exact_rows:l different_rows:l left_only:l right_only:l",
      lambda V: audit.reconcile_summary(V.evals, V.evals_b, "candidate_id", REC), """
SELECT count(CASE WHEN a.candidate_id = b.candidate_id AND a.score IS NOT DISTINCT FROM b.score THEN 1 END) AS exact_rows,
 count(CASE WHEN a.candidate_id = b.candidate_id AND a.score IS DISTINCT FROM b.score THEN 1 END) AS different_rows,
 count(CASE WHEN b.candidate_id IS NULL THEN 1 END) AS left_only, count(CASE WHEN a.candidate_id IS NULL THEN 1 END) AS right_only
FROM v_evals a FULL JOIN v_evals_b b ON a.candidate_id = b.candidate_id""")
query("l8_replay_compare", "metric:s n:l exact:l max_abs:d", lambda V: audit.replay_compare(
    V.evals, V.evals_b, "candidate_id", ["score", "cr", "ci"]), """
WITH j AS (SELECT unnest(['score', 'cr', 'ci']) AS metric, unnest([a.score, a.cr, a.ci]) AS s, unnest([b.score, b.cr, b.ci]) AS r FROM v_evals a JOIN v_evals_b b USING (candidate_id))
SELECT metric, count(*) AS n, count(CASE WHEN s IS NOT DISTINCT FROM r THEN 1 END) AS exact, max(abs(s - r)) AS max_abs FROM j GROUP BY 1""")
query("l9_score_identity", "max_abs:d n:l", lambda V: audit.score_identity(
    fields.score_fields(V.pair_grids, W, H), fields.WEIGHTS), "SELECT 0.0 AS max_abs, count(*) - 1 AS n FROM embeddings")
query("l10_null_block_audit", "step:l candidates:l computed_max:d stored_max:d ties:l candidate_id:l matches:b", lambda V: audit.null_block_audit(
    V.evals, V.evals_b.groupBy("step").agg(F.max("score").alias("stat")), "step"), """
WITH s AS (SELECT step, max(score) AS stored_max FROM v_evals_b GROUP BY 1), m AS (SELECT step, max(score) AS m, count(*) AS candidates FROM v_evals GROUP BY 1)
SELECT m.step, candidates, m AS computed_max, stored_max, count(*) AS ties, min(candidate_id) AS candidate_id, m = stored_max AS matches
FROM m JOIN s USING (step) JOIN v_evals e ON e.step = m.step AND e.score = m.m GROUP BY ALL""")


def _roles(V):
    return audit.classify_role(V.evals, [("other_run", F.col("run_id") != "1-URGENT"), ("baseline", F.col("candidate_id") < 100),
                                         ("primary", F.col("model").isin("m0", "m1")), ("failed", F.col("status") != "OK")], "control")


query("l11_classify_role", "audit_role:s run_id:s n:l", lambda V: _roles(V).groupBy("audit_role", "run_id").agg(F.count(F.lit(1)).alias("n")), """
SELECT CASE WHEN run_id <> '1-URGENT' THEN 'other_run' WHEN candidate_id < 100 THEN 'baseline' WHEN model IN ('m0', 'm1') THEN 'primary'
 WHEN status <> 'OK' THEN 'failed' ELSE 'control' END AS audit_role, run_id, count(*) AS n FROM v_evals GROUP BY ALL""")
query("l12_quality_counts", "n:l zero:l missing:l non_finite:l", lambda V: audit.quality_counts(V.messy), """
SELECT count(*) AS n, count(CASE WHEN score = 0 THEN 1 END) AS zero, count(CASE WHEN score IS NULL THEN 1 END) AS missing,
 count(CASE WHEN isnan(score) OR isinf(score) THEN 1 END) AS non_finite FROM v_messy""")
query("l13_orphans", "relation:s key:s", lambda V: audit.orphans(V.evals_b, V.evals, "candidate_id", "candidate_id", "copy -> log").unionByName(
    audit.orphans(V.table("documents"), V.table("labels"), "doc_id", "doc_id", "document -> label")), """
SELECT 'copy -> log' AS relation, candidate_id::VARCHAR AS key FROM v_evals_b WHERE candidate_id NOT IN (SELECT candidate_id FROM v_evals)
UNION ALL SELECT 'document -> label', doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")


def hash_sql(src, key):
    return f"""
hc AS (SELECT {key}, t // 4096 AS c, sha256(string_agg(floor(v * 1000000.0{D} + 0.5{D})::BIGINT, ',' ORDER BY t)) AS h FROM {src} GROUP BY ALL),
hd AS (SELECT {key}, c // 4096 AS c2, sha256(string_agg(h, ',' ORDER BY c)) AS h FROM hc GROUP BY ALL),
hs AS (SELECT {key}, sha256(string_agg(h, ',' ORDER BY c2)) AS content FROM hd GROUP BY ALL)"""


query("l14_content_hash", "name:s content:s", lambda V: audit.content_hash(V.named_series, "name"), f"WITH {hash_sql('v_named_series', 'name')} SELECT * FROM hs")
SET_ROW = "md5(" + " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("step", "candidate_id", "role", "status")) + ")"
query("l14_set_hash", "run_id:s rows:l hash_a:l hash_b:l", lambda V: audit.set_hash(V.evals, ["step", "candidate_id", "role", "status"], "run_id"), f"""
SELECT run_id, count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) % 1152921504606846976 AS hash_a, sum(('0x' || substr(h, 17, 15))::BIGINT::HUGEINT) % 1152921504606846976 AS hash_b
FROM (SELECT run_id, {SET_ROW} AS h FROM v_evals) GROUP BY 1""")
query("l15_collisions", "name:s first_name:s n:l", lambda V: audit.collisions(audit.content_hash(V.named_series, "name")), f"""
WITH {hash_sql('v_named_series', 'name')}, g AS (SELECT content, count(*) AS n, min(name) AS first_name FROM hs GROUP BY 1 HAVING count(*) > 1)
SELECT name, first_name, n FROM hs JOIN g USING (content)""")
query("l16_determinism_check", "differences:l states:l deterministic:b", lambda V: audit.determinism_check(
    V.evals.na.fill(-1.0, ["score"]), V.evals_b.na.fill(-1.0, ["score"]), "candidate_id", ["score"], 9), """
WITH u AS (SELECT candidate_id, s, sum(w) AS b FROM (
  SELECT candidate_id, floor(coalesce(score, -1) * 1000000000.0::DOUBLE + 0.5::DOUBLE) AS s, 1 AS w FROM v_evals
  UNION ALL SELECT candidate_id, floor(coalesce(score, -1) * 1000000000.0::DOUBLE + 0.5::DOUBLE), -1 FROM v_evals_b) GROUP BY ALL)
SELECT count(CASE WHEN b <> 0 THEN 1 END) AS differences, count(*) AS states, count(CASE WHEN b <> 0 THEN 1 END) = 0 AS deterministic FROM u""")
query("l17_feature_ranges", "name:s n:l non_finite:l negative:l above_one:l ok:b", lambda V: audit.feature_ranges(
    V.unit_features, ["repeated", "dominant"], ["distinct_values", "value_entropy"]), """
SELECT name, count(*) AS n, 0 AS non_finite, count(CASE WHEN value < 0 THEN 1 END) AS negative, count(CASE WHEN value > 1 + 1e-9 THEN 1 END) AS above_one,
 count(CASE WHEN value < 0 THEN 1 END) = 0 AND (name NOT IN ('repeated', 'dominant') OR count(CASE WHEN value > 1 + 1e-9 THEN 1 END) = 0) AS ok
FROM v_unit_features GROUP BY 1""")
query("l18_config_guard", "candidate_id:l cell:s", lambda V: audit.config_guard(V.evals, V.evals_b, "candidate_id", ["model", "cr", "score"]), """
SELECT candidate_id, 'score' AS cell FROM v_evals a JOIN v_evals_b b USING (candidate_id) WHERE a.score IS DISTINCT FROM b.score""")

# -- S: evidence tables --------------------------------------------------------------------------------------


def _batch(V):
    e = V.evals
    cut = 12 * 1998
    log = e.filter(F.col("step") < cut)
    late = log.filter(F.col("candidate_id") % 50 == 0)
    return log, e.filter(F.col("step") >= cut).unionByName(late)


query("s9_append_check", "run_id:s step:l candidate_id:l verdict:s", lambda V: evidence.append_check(*_batch(V)), """
WITH log AS (SELECT * FROM v_evals WHERE step < 23976), b AS (SELECT * FROM v_evals WHERE step >= 23976 UNION ALL SELECT * FROM log WHERE candidate_id % 50 = 0)
SELECT b.run_id, b.step, b.candidate_id, CASE WHEN EXISTS (SELECT 1 FROM log l WHERE l.run_id = b.run_id AND l.step = b.step AND l.candidate_id = b.candidate_id) THEN 'duplicate'
 WHEN b.step <= (SELECT max(step) FROM log l WHERE l.run_id = b.run_id) THEN 'late' ELSE 'accepted' END AS verdict FROM b""")
query("s10_upsert_latest", "run_id:s step:l candidate_id:l score:d ts:s", lambda V: evidence.upsert_latest(
    V.evals.select("run_id", "step", "candidate_id", "score", "ts"),
    V.evals_b.select("run_id", "step", "candidate_id", "score", F.expr("ts + interval 1 day").alias("ts")), ["run_id", "step", "candidate_id"])
      .withColumn("ts", F.date_format("ts", "yyyy-MM-dd")), """
WITH u AS (SELECT run_id, step, candidate_id, score, ts FROM v_evals UNION ALL SELECT run_id, step, candidate_id, score, ts + INTERVAL 1 DAY FROM v_evals_b)
SELECT run_id, step, candidate_id, arg_max_null(score, ts) AS score, strftime(max(ts), '%Y-%m-%d') AS ts FROM u GROUP BY ALL""")
query("s11_counter_ledger", "name:s total:l entries:l", lambda V: evidence.counter_ledger(
    V.table("events").select(F.col("event_type").alias("name"), (F.col("event_id") % 3).alias("delta"))), """
SELECT event_type AS name, sum(event_id % 3) AS total, count(*) AS entries FROM events GROUP BY 1""")
query("s13_flatten_metrics", "id:l test:s metric:s value:d meaning:s", lambda V: evidence.flatten_metrics(
    V.table("events").select(F.col("event_id").alias("id"), F.concat(
        F.lit('{"meaning": "'), "event_type", F.lit('", "run": {"props": '), "props", F.lit(', "list": ['), F.col("user_id").cast("string"),
        F.lit(', 2], "flag": true, "text": "x"}, "total": 1}')).alias("json"))), """
SELECT event_id AS id, 'run.props' AS test, 'k' AS metric, json_extract_string(props, '$.k')::DOUBLE AS value, event_type AS meaning FROM events
UNION ALL SELECT event_id, 'run', 'list[0]', user_id, event_type FROM events UNION ALL SELECT event_id, 'run', 'list[1]', 2, event_type FROM events
UNION ALL SELECT event_id, '', 'total', 1, event_type FROM events""")


def _long_wide(V):
    m = marginal.baseline_stats(V.cells, "sample_id")
    long = evidence.features_long(m, "sample_id", ["mean", "var", "min", "max"], {"mean": "centre", "var": "spread"})
    return long


STATS = "st AS (SELECT sample_id, avg(v) AS mean, var_pop(v) AS var, min(v) AS min, max(v) AS max FROM v_cells GROUP BY 1)"
query("s14_features_long", "sample_id:l name:s value:d family:s", _long_wide, f"""
WITH {STATS}, u AS (UNPIVOT st ON mean, var, min, max INTO NAME name VALUE value)
SELECT *, CASE name WHEN 'mean' THEN 'centre' WHEN 'var' THEN 'spread' ELSE 'other' END AS family FROM u""")
query("s14_features_wide", "sample_id:l mean:d var:d min:d max:d",
      lambda V: evidence.features_wide(_long_wide(V), "sample_id", ["mean", "var", "min", "max"]), f"WITH {STATS} SELECT * FROM st")

# -- K: sweeps ------------------------------------------------------------------------------------------------

DOMAIN = (0.0, 0.1, 1.0, 50.0)


def _scored_grid(V):
    g = sweep.grid_points(V.table("lineitem").select("l_discount", "l_quantity", "l_extendedprice"), DOMAIN, 5)
    kept = (F.col("l_discount") <= F.col("gx") + 1e-9) & (F.col("l_quantity") <= F.col("gy"))
    return g.groupBy("gx", "gy").agg((F.sum(F.when(kept, F.col("l_extendedprice")).otherwise(0.0)) / F.sum("l_extendedprice")).alias("score"))


query("k1_param_grid", "gx:d gy:d score:d", _scored_grid, """
SELECT gx, gy, sum(CASE WHEN l_discount <= gx + 1e-9 AND l_quantity <= gy THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) AS score
FROM lineitem, (SELECT i * 0.1::DOUBLE / 4 AS gx FROM range(5) a(i)), (SELECT 1 + 49.0::DOUBLE * j / 4 AS gy FROM range(5) b(j)) GROUP BY ALL""")
query("k2_topk_distinct", "candidate_id:l score:d cr:d ci:d", lambda V: sweep.topk_distinct(V.evals, 25, decimals=1), """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY floor(cr * 10.0::DOUBLE + 0.5::DOUBLE), floor(ci * 10.0::DOUBLE + 0.5::DOUBLE) ORDER BY score DESC, candidate_id) AS r FROM v_evals)
SELECT candidate_id, score, cr, ci FROM r WHERE r = 1 ORDER BY score DESC, candidate_id LIMIT 25""")
query("k3_stratified_starts", "quadrant:l candidate_id:l cr:d ci:d", lambda V: sweep.stratified_starts(V.evals.filter("status = 'OK'"), (0.0, 5.0, 0.0, 1.0)), """
WITH q AS (SELECT candidate_id, cr, ci, CASE WHEN cr > 2.5 THEN 1 ELSE 0 END + CASE WHEN ci > 0.5 THEN 2 ELSE 0 END AS quadrant FROM v_evals WHERE status = 'OK'),
r AS (SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY cr, ci, candidate_id) - 1 AS i, count(*) OVER (PARTITION BY quadrant) AS n FROM q)
SELECT quadrant, candidate_id, cr, ci FROM r WHERE i % greatest(1, n // 2) = 0 AND i // greatest(1, n // 2) < 2 ORDER BY quadrant, i""")


def _scores_by_role(V):
    return V.evals.groupBy("run_id", "step", F.col("model").alias("name")).agg(F.max("score").alias("score"))


query("k4_contrast_table", "run_id:s step:l c_full:d c_mean:d", lambda V: sweep.contrast_table(
    _scores_by_role(V), ["run_id", "step"], {"c_full": ("m0", "max", ["m1", "m2"]), "c_mean": ("m0", "mean", ["m1", "m2"])}), """
WITH s AS (SELECT run_id, step, max(CASE WHEN model = 'm0' THEN score END) AS a, max(CASE WHEN model = 'm1' THEN score END) AS b,
  max(CASE WHEN model = 'm2' THEN score END) AS c FROM v_evals GROUP BY ALL)
SELECT run_id, step, a - greatest(b, c) AS c_full, a - (b + c) / 2 AS c_mean FROM s""")
query("k5_uplifts", "run_id:s step:l control:s uplift:d", lambda V: sweep.uplifts(_scores_by_role(V), ["run_id", "step"], "m0", ["m1", "m2"]), """
WITH s AS (SELECT run_id, step, model, max(score) AS s FROM v_evals GROUP BY ALL)
SELECT c.run_id, c.step, c.model AS control, b.s - c.s AS uplift FROM s c JOIN s b ON b.run_id = c.run_id AND b.step = c.step AND b.model = 'm0' WHERE c.model <> 'm0'""")
query("k6_controls_at_best", "run_id:s model:s candidate_id:l score:d", lambda V: sweep.controls_at_best(V.evals, tol=0.05), """
WITH b AS (SELECT run_id, arg_min(cr, (-score, candidate_id)) AS bc, arg_min(ci, (-score, candidate_id)) AS bi FROM v_evals WHERE status = 'OK' GROUP BY 1),
n AS (SELECT e.*, row_number() OVER (PARTITION BY e.run_id, model ORDER BY candidate_id DESC) AS r FROM v_evals e JOIN b USING (run_id) WHERE abs(cr - bc) < 0.05::DOUBLE AND abs(ci - bi) < 0.05::DOUBLE)
SELECT run_id, model, candidate_id, score FROM n WHERE r = 1""")
query("k7_sensitivity_ranges", "run_id:s kind:s n:l range:d identical:b", lambda V: sweep.sensitivity_ranges(
    V.evals.withColumn("kind", F.concat_ws("/", "role", "model")), "run_id"), """
SELECT run_id, role || '/' || model AS kind, count(*) AS n, max(score) - min(score) AS range, max(score) = min(score) AS identical FROM v_evals GROUP BY ALL""")
query("k8_run_summary", "run_id:s evaluations:l failed:l models:l last_step:l best_score:d best_id:l", lambda V: sweep.run_summary(V.evals), """
SELECT run_id, count(*) AS evaluations, count(CASE WHEN status <> 'OK' THEN 1 END) AS failed, count(DISTINCT model) AS models, max(step) AS last_step,
 max(CASE WHEN status = 'OK' THEN score END) AS best_score, arg_min(candidate_id, (-score, candidate_id)) FILTER (status = 'OK') AS best_id FROM v_evals GROUP BY 1""")
query("k9_split_counts", "unit:s train:l validation:l holdout:l", lambda V: sweep.split_counts(V.samples, "unit"), """
SELECT unit, count(CASE WHEN split = 'train' THEN 1 END) AS train, count(CASE WHEN split = 'validation' THEN 1 END) AS validation,
 count(CASE WHEN split = 'holdout' THEN 1 END) AS holdout FROM v_samples GROUP BY 1""")

# -- D: gates ------------------------------------------------------------------------------------------------


def gate(name, rules):
    """Every log row contributes to one metric of its (run, step); the rule set decides per key."""
    ms = list(rules.metrics)

    def plan(V):
        pick = F.element_at(F.array(*[F.lit(m) for m in ms]), (F.col("candidate_id") % len(ms) + 1).cast("int"))
        m = V.evals.groupBy("run_id", "step", pick.alias("metric")).agg((F.avg("score") * 2.3).alias("value"))
        return gates.rule_cascade(m, ["run_id", "step"], rules)
    piv = ", ".join(f"coalesce(avg(CASE WHEN candidate_id % {len(ms)} = {i} THEN score END) * 2.3{D}, {float(d)}{D}) AS {m}" for i, (m, d) in enumerate(rules.metrics.items()))
    chk = ", ".join(f"({e}) AS {c}" for c, e in rules.checks.items())
    cas = " ".join(f"WHEN {e} THEN '{s}'" for s, e in rules.cascade)
    query(name, "run_id:s step:l " + " ".join(f"{c}:b" for c in rules.checks) + " status:s", plan, f"""
WITH p AS (SELECT run_id, step, {piv} FROM v_evals GROUP BY ALL), c AS (SELECT *, {chk} FROM p)
SELECT *, CASE {cas} ELSE '{rules.default}' END AS status FROM c""")


CUSTOM = gates.Rules(metrics={"low": 0.0, "high": 1.0, "mid": 0.5}, checks={"ordered": "low <= mid and mid <= high", "wide": "high - low > 0.3"},
                     cascade=(("ORDERED_WIDE", "ordered and wide"), ("ORDERED", "ordered")), default="MIXED")
gate("d1_rule_cascade", CUSTOM)
gate("d2_passive_rules", gates.PASSIVE)
gate("d3_matched_rules", gates.MATCHED)
gate("d4_artifact_rules", gates.ARTIFACT)
gate("d5_active_rules", gates.ACTIVE)
gate("d6_sweep_rules", gates.SWEEP)

# -- X: sets, U: extensions -------------------------------------------------------------------------------------

query("x1_last_n", "candidate_id:l step:l", lambda V: evidence.last_n(V.evals.select("step", "candidate_id"), ["step", "candidate_id"], 50),
      "SELECT candidate_id, step FROM v_evals ORDER BY step DESC, candidate_id DESC LIMIT 50")
query("x2_key_set_ops", "candidate_id:l membership:s", lambda V: evidence.key_set_ops(V.evals, V.evals_b, "candidate_id"), """
SELECT coalesce(a.candidate_id, b.candidate_id) AS candidate_id, CASE WHEN b.candidate_id IS NULL THEN 'left' WHEN a.candidate_id IS NULL THEN 'right' ELSE 'both' END AS membership
FROM v_evals a FULL JOIN v_evals_b b ON a.candidate_id = b.candidate_id""")


def _user_features(V):
    if "user_spread" not in evidence.FEATURES:
        evidence.register_feature("user_spread", "marginal", lambda c: F.max("v") - F.min("v"))
        evidence.register_feature("user_positive", "marginal", lambda c: F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0)))
    return evidence.extract(V.cells, "sample_id", ["user_spread", "user_positive"])


query("u1_register_feature", "sample_id:l name:s value:d family:s", _user_features, """
SELECT sample_id, 'user_spread' AS name, max(v) - min(v) AS value, 'marginal' AS family FROM v_cells GROUP BY 1
UNION ALL SELECT sample_id, 'user_positive', avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END), 'marginal' FROM v_cells GROUP BY 1""")


def _user_degradation(V):
    if "user_halve" not in degrade.DEGRADATIONS:
        degrade.register_degradation("user_halve", lambda c: F.floor(c.v * 4.0) / 4.0)
    return degrade.degrade_cells(V.cells, "user_halve").select("sample_id", "idx", "v")


query("u2_register_degradation", "sample_id:l idx:l v:d", _user_degradation, "SELECT sample_id, idx, floor(v * 4.0::DOUBLE) / 4.0::DOUBLE AS v FROM v_cells")

# -- P: projections and checks ------------------------------------------------------------------------------------


def _radec(V):
    ra, dec = sphere.unit_to_radec("ux", "uy", "uz")
    d = V.catalogue.select("sky_id", "event_id", ra.alias("ra"), dec.alias("dec"))
    x, y, z = sphere.radec_to_unit("ra", "dec")
    return d.withColumns({"x": x, "y": y, "z": z})


query("p1_radec_unit", "sky_id:l event_id:l ra:d dec:d x:d y:d z:d", _radec, """
SELECT sky_id, event_id, degrees(atan2(uy, ux)) + CASE WHEN uy < 0 THEN 360 ELSE 0 END AS ra, degrees(asin(uz)) AS dec, ux AS x, uy AS y, uz AS z FROM v_catalogue""")
query("p2_normalize_vec3", "vec_id:l x:d y:d z:d", lambda V: V.table("embeddings").select("vec_id", *[
    c.alias(n) for c, n in zip(sphere.normalize(*[F.col("embedding")[i].cast("double") for i in (4, 5, 6)]), "xyz")]), """
SELECT vec_id, a / n AS x, b / n AS y, c / n AS z FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (
 SELECT vec_id, embedding[5]::DOUBLE AS a, embedding[6]::DOUBLE AS b, embedding[7]::DOUBLE AS c FROM embeddings))""")
query("p3_energy_cut", "sky_id:l event_id:l", lambda V: sphere.energy_cut(V.catalogue, 1e19), "SELECT sky_id, event_id FROM v_catalogue WHERE energy IS NULL OR energy >= 1e19")
query("p4_admissible", "candidate_id:l reason:s", lambda V: V.evals.select("candidate_id", evidence.admissible(
    F.col("ci"), F.col("cr") / 5.0, F.col("score")).alias("reason")), """
SELECT candidate_id, CASE WHEN ci < 0.05::DOUBLE THEN 'escaped_fraction < 0.05' WHEN ci > 0.95::DOUBLE THEN 'escaped_fraction > 0.95' WHEN cr / 5.0::DOUBLE < 0.2::DOUBLE THEN 'normalized_entropy < 0.20'
 WHEN score < 0.05::DOUBLE THEN 'smooth_std < 0.05' ELSE 'admissible' END AS reason FROM v_evals""")
query("p5_select_features", "sample_id:l name:s value:d family:s", lambda V: evidence.select_features(V.features, families=["f0", "f2"]),
      "SELECT * FROM v_features WHERE family IN ('f0', 'f2')")
query("p6_validate_ranges", "id:l rule:s", lambda V: evidence.validate_ranges(V.messy, "id", {
    "score finite": F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")),
    "amount positive": F.col("amount") >= 0, "name not empty": F.length(F.trim("name")) > 0,
    "known segment": F.lower("name").isin("building", "machinery", "household", "furniture")}), """
SELECT id, 'score finite' AS rule FROM v_messy WHERE score IS NULL OR isnan(score) OR isinf(score)
UNION ALL SELECT id, 'amount positive' FROM v_messy WHERE amount < 0
UNION ALL SELECT id, 'known segment' FROM v_messy WHERE lower(name) NOT IN ('building', 'machinery', 'household', 'furniture')""")
SEGMENTS = {"aut": "AUTOMOBILE", "bui": "BUILDING", "fur": "FURNITURE", "mac": "MACHINERY", "hou": "HOUSEHOLD"}
query("p7_canonical_name", "id:l canonical:s", lambda V: evidence.canonical_name(V.messy, "alias", SEGMENTS), "SELECT id, upper(name) AS canonical FROM v_messy")
query("p8_label_map", "id:l label:s", lambda V: evidence.label_map(V.messy, "alias", {"goods": ["aut", "fur", "hou"], "works": ["bui", "mac"]}, "unknown"), """
SELECT id, CASE WHEN alias IN ('aut', 'fur', 'hou') THEN 'goods' WHEN alias IN ('bui', 'mac') THEN 'works' ELSE 'unknown' END AS label FROM v_messy""")
query("p9_reflect_clamp", "id:l reflected:d clamped:d", lambda V: V.messy.select(
    "id", evidence.reflect_into("amount", 0.0, 1500.0).alias("reflected"), clamp("amount", 0.0, 1500.0).alias("clamped")), """
SELECT id, CASE WHEN p > 1500 THEN 3000 - p ELSE p END AS reflected, least(greatest(amount, 0), 1500) AS clamped
FROM (SELECT id, amount, amount - floor(amount / 3000.0::DOUBLE) * 3000.0::DOUBLE AS p FROM v_messy)""")
query("p10_boundary_distance", "candidate_id:l distance:d edge:s suspect:b", lambda V: evidence.boundary_distance(V.evals, "cr", "ci", (0.0, 6.0, 0.0, 1.0)), """
WITH d AS (SELECT candidate_id, (cr - 0) / 6.0::DOUBLE AS a, (6 - cr) / 6.0::DOUBLE AS b, ci / 1.0::DOUBLE AS c, (1 - ci) / 1.0::DOUBLE AS d FROM v_evals)
SELECT candidate_id, least(a, b, c, d) AS distance, CASE least(a, b, c, d) WHEN a THEN 'cr_lo' WHEN b THEN 'cr_hi' WHEN c THEN 'ci_lo' ELSE 'ci_hi' END AS edge,
 least(a, b, c, d) < 0.05::DOUBLE AS suspect FROM d""")
query("p11_axis_angle", "sky_id:l event_id:l by_acos:d by_chord:d", lambda V: V.catalogue.select(
    "sky_id", "event_id", sphere.angle_acos(["ux", "uy", "uz"], [F.lit(0.6), F.lit(0.0), F.lit(0.8)]).alias("by_acos"),
    sphere.angle_chord(["ux", "uy", "uz"], [F.lit(0.6), F.lit(0.0), F.lit(0.8)]).alias("by_chord")), """
SELECT sky_id, event_id, acos(least(greatest(ux * 0.6::DOUBLE + uz * 0.8::DOUBLE, -1), 1)) AS by_acos,
 acos(least(greatest(ux * 0.6::DOUBLE + uz * 0.8::DOUBLE, -1), 1)) AS by_chord FROM v_catalogue""")
query("p12_stable_seed", "id:l seed:l", lambda V: V.messy.select("id", stable_seed("name", F.col("id"), 53000).alias("seed")))
