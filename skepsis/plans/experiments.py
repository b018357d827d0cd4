"""Queries over pairs, resampling and classifiers."""
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..operators import fields, models, pairing, resample, scale, sequence as seq
from .fixtures import H, UNITS, W
from .spec import query

TRAIN, TEST = ["g0", "g1", "g2", "g3", "g4"], ["g6", "g7"]
SEEN, UNSEEN = ["q255", "q15", "lut16"], ["block4", "noise", "xor"]
D = "::DOUBLE"


def lst(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def u(*parts):
    return f"(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 8))::BIGINT / 4294967296.0{D})"


def is_train():
    return F.col("grp").isin(TRAIN) & F.col("unit").isin(SEEN)


def is_test():
    return F.col("grp").isin(TEST)


# -- J: pairs ---------------------------------------------------------------------------------------

query("j1_pair_join", "grp:l seed:l unit:s name:s alt:d ref:d",
      lambda V: pairing.pair_join(V.unit_pairs, F.col("unit") == "N", F.col("unit") != "N"), """
SELECT a.grp, a.seed, a.unit, a.name, a.value AS alt, r.value AS ref FROM v_unit_pairs a
JOIN v_unit_pairs r ON r.grp = a.grp AND r.seed = a.seed AND r.name = a.name AND r.unit = 'N' WHERE a.unit <> 'N'""")
query("j2_feature_diff", "grp:s seed:l unit:s name:s d:d", lambda V: V.unit_diffs, "SELECT * FROM v_unit_diffs")
query("j3_mirror_augment", "grp:l seed:l unit:s name:s label:s value:d", lambda V: pairing.mirror_augment(V.pair_diffs), """
SELECT grp, seed, unit, name, 'A' AS label, d AS value FROM v_pair_diffs
UNION ALL SELECT grp, seed, unit, name, 'B', -d FROM v_pair_diffs""")
BAND = """
bd AS (SELECT *, avg(CASE WHEN flag = 0 THEN v END) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS base
  FROM v_type_series)"""
query("j4_band_baseline", "series_id:s t:l difference:d", lambda V: pairing.band_baseline(V.type_series, "series_id"), f"""
WITH {BAND} SELECT series_id, t, v - base AS difference FROM bd WHERE flag = 1 AND base IS NOT NULL""")
query("j5_event_response", "series_id:s n_event:l n_other:l event_mean:d other_mean:d delta:d",
      lambda V: pairing.event_response(V.type_series, "series_id"), f"""
WITH {BAND} SELECT series_id, count(CASE WHEN flag = 1 THEN 1 END) AS n_event, count(CASE WHEN flag = 0 THEN 1 END) AS n_other,
 avg(CASE WHEN flag = 1 THEN v - base END) AS event_mean, avg(CASE WHEN flag = 0 THEN v - base END) AS other_mean,
 avg(CASE WHEN flag = 1 THEN v - base END) - avg(CASE WHEN flag = 0 THEN v - base END) AS delta
FROM bd WHERE base IS NOT NULL GROUP BY 1""")
ADJ = """
aj AS (SELECT f.series_id, f.t, f.active, f.mean, f.flag, CASE WHEN b.t IS NULL THEN 'missing_baseline'
   WHEN f.active = 0 OR b.active = 0 THEN 'extinct' WHEN (f.mean = 0 AND f.std = 0) OR (b.mean = 0 AND b.std = 0) THEN 'zero_magnitude' END AS reason,
   f.mean - b.mean AS diff FROM v_trace f LEFT JOIN v_trace_base b USING (series_id, t)),
ok AS (SELECT *, avg(diff) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m,
   max(flag) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS pf FROM aj WHERE reason IS NULL),
rs AS (SELECT series_id, t, pf AS after_event, floor(active * 10)::BIGINT AS bin, diff - m AS detrended FROM ok)"""
query("j7_baseline_adjust", "series_id:l t:l reason:s adjusted:d", lambda V: pairing.baseline_adjust(V.trace, V.trace_base), f"""
WITH {ADJ} SELECT series_id, t, reason, CASE WHEN reason IS NULL THEN diff END AS adjusted FROM aj""")
query("j7_responses", "series_id:l t:l after_event:l bin:l detrended:d",
      lambda V: pairing.responses(pairing.baseline_adjust(V.trace, V.trace_base)), f"WITH {ADJ} SELECT * FROM rs")
#: The sequential rule: events of a bin in order, each taking the nearest control not in the list of used ones.
GREEDY = """
ev AS (SELECT series_id, bin, t, row_number() OVER (PARTITION BY series_id, bin ORDER BY t) AS k FROM rs WHERE after_event = 1),
gm AS (SELECT DISTINCT series_id, bin, 0::BIGINT AS k, NULL::BIGINT AS t, NULL::BIGINT AS control_t, []::BIGINT[] AS used FROM ev
 UNION ALL
 SELECT series_id, bin, k, t, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (
  SELECT e.series_id, e.bin, e.k, e.t, g.used, arg_min(c.t, 2 * abs(c.t - e.t) + CASE WHEN c.t > e.t THEN 1 ELSE 0 END) AS pick
  FROM gm g JOIN ev e ON e.series_id = g.series_id AND e.bin = g.bin AND e.k = g.k + 1
  LEFT JOIN rs c ON c.after_event = 0 AND c.series_id = e.series_id AND c.bin = e.bin AND c.t BETWEEN e.t - 10 AND e.t + 10 AND NOT list_contains(g.used, c.t)
  GROUP BY ALL)),
mt AS (SELECT series_id, bin, t, control_t FROM gm WHERE control_t IS NOT NULL)"""


def adjusted(V):
    return pairing.baseline_adjust(V.trace, V.trace_base)


query("j6_greedy_match", "series_id:l bin:l t:l control_t:l",
      lambda V: pairing.greedy_match(scale.materialize(pairing.responses(adjusted(V)))), f"WITH RECURSIVE {ADJ},{GREEDY} SELECT * FROM mt")
query("j7_exclusions", "series_id:l missing_baseline:l extinct:l zero_magnitude:l unobservable_predecessor:l usable:l eligible:l",
      lambda V: pairing.exclusions(adjusted(V)), f"""
WITH {ADJ} SELECT series_id, count(CASE WHEN reason = 'missing_baseline' THEN 1 END) AS missing_baseline, count(CASE WHEN reason = 'extinct' THEN 1 END) AS extinct,
 count(CASE WHEN reason = 'zero_magnitude' THEN 1 END) AS zero_magnitude, count(CASE WHEN reason IS NULL AND pf IS NULL THEN 1 END) AS unobservable_predecessor,
 count(pf) AS usable, count(CASE WHEN pf = 1 THEN 1 END) AS eligible FROM (SELECT * FROM ok UNION ALL SELECT *, NULL, NULL FROM aj WHERE reason IS NOT NULL) GROUP BY 1""")
query("j8_rank_join", "pair_id:l idx:l source:d matched:d", lambda V: pairing.rank_join(V.pairs_cells), """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY f, idx) AS rf, row_number() OVER (PARTITION BY pair_id ORDER BY t, idx) AS rt FROM v_pairs_cells)
SELECT a.pair_id, a.idx, a.f AS source, b.t AS matched FROM a JOIN a b ON b.pair_id = a.pair_id AND b.rt = a.rf""")
query("j9_result_join", "candidate_id:l cr:d ci:d score:d", lambda V: pairing.result_join(
    V.evals.select("candidate_id", "cr", "ci"), V.evals_b.select("candidate_id", "score")), """
SELECT a.candidate_id, a.cr, a.ci, b.score FROM v_evals a JOIN v_evals_b b USING (candidate_id)""")
query("j10_unseen_candidates", "candidate_id:l cr:d ci:d", lambda V: pairing.unseen_candidates(
    V.evals.select("candidate_id", "cr", "ci"), V.evals_b.filter("status = 'OK'")), """
SELECT candidate_id, cr, ci FROM v_evals a WHERE NOT EXISTS (SELECT 1 FROM v_evals_b b WHERE b.status = 'OK'
 AND floor(b.cr * 1000000.0::DOUBLE + 0.5::DOUBLE) = floor(a.cr * 1000000.0::DOUBLE + 0.5::DOUBLE)
 AND floor(b.ci * 1000000.0::DOUBLE + 0.5::DOUBLE) = floor(a.ci * 1000000.0::DOUBLE + 0.5::DOUBLE))""")


def _allow(V):
    allow = V.samples.filter(F.col("split") == "train").select("grp", "split").distinct().withColumn("label", F.lit(None).cast("string"))
    return pairing.allowlist_train(V.samples, allow)


query("j11_allowlist_train", "sample_id:l grp:s split:s label:s", _allow,
      "SELECT sample_id, grp, split, label FROM v_samples WHERE split = 'train'")
query("j12_evals_with_run", "run_id:s step:l candidate_id:l score:d run_n:l",
      lambda V: pairing.evals_with_run(V.evals, V.evals.groupBy("run_id").agg(F.count(F.lit(1)).alias("run_n"))), """
SELECT run_id, step, candidate_id, score, count(*) OVER (PARTITION BY run_id) AS run_n FROM v_evals""")
query("j13_flat_json", "event_id:l k:s event_type:s n:l", lambda V: pairing.flat_json(
    V.table("events"), ["props"], {"event_type": "event_type"}).select(
        "event_id", F.col("flat")["k"].alias("k"), F.col("flat")["event_type"].alias("event_type"), F.size("flat").alias("n")), """
SELECT event_id, json_extract_string(props, '$.k') AS k, event_type, len(json_keys(props)) + 1 AS n FROM events""")
query("j14_cross_params", "sample_id:l param:d scaled:d", lambda V: pairing.cross_params(
    V.grids, [0.5, 1.0, 2.0]).select("sample_id", "param", (fields.array_mean("vals") * F.col("param")).alias("scaled")), """
SELECT sample_id, p AS param, avg(v) * p AS scaled FROM v_cells, (SELECT unnest([0.5::DOUBLE, 1.0, 2.0]) AS p) GROUP BY sample_id, p""")

# -- N: nulls ----------------------------------------------------------------------------------------


def _draws(V):
    return scale.replicate(V.table("events").select("event_id"), 3).withColumn("u", hash_uniform(42, F.col("rep"), F.col("event_id")))


query("n1_hash_uniform", "event_id:l rep:l u:d9", _draws, f"""
SELECT event_id, r AS rep, {u("'42'", "r", "event_id")} AS u FROM events, range(3) q(r)""")
query("n2_shuffle_values", "series_id:s t:l shuffled:d",
      lambda V: resample.shuffle_values(V.type_series.select("series_id", "t", "v"), "series_id", "t", "v", 7), f"""
WITH r AS (SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id ORDER BY {u("'7'", "series_id", "t")}, t) AS r FROM v_type_series)
SELECT a.series_id, a.t, b.v AS shuffled FROM v_type_series a JOIN r b ON b.series_id = a.series_id AND b.r = a.t""")
EVN = """
n AS (SELECT series_id, count(*) AS n FROM v_type_series GROUP BY 1),
ev AS (SELECT series_id, t AS pos, v AS amp, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM v_type_series WHERE flag = 1),
eg AS (SELECT e.*, n, coalesce(lead(pos) OVER w - pos, n - pos + first_value(pos) OVER w) AS gap FROM ev e JOIN n USING (series_id)
  WINDOW w AS (PARTITION BY series_id ORDER BY pos))"""


def _events(V):
    return scale.materialize(seq.event_positions_gaps(V.type_series.withColumn("v", F.col("flag") * F.col("v"))))


def _lengths(V):
    return V.type_series.groupBy("series_id").agg(F.max("t").alias("n"))


query("n3_matched_event", "series_id:s k:l t:l amp:d",
      lambda V: resample.matched_event(V.type_series, _events(V), "series_id", 3), f"""
WITH {EVN}, s AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY {u("'3'", "series_id", "t")}, t) AS k FROM v_type_series)
SELECT series_id, k, s.t, amp FROM ev JOIN s USING (series_id, k)""")
query("n4_gap_matched", "series_id:s k:l t:l amp:d",
      lambda V: resample.gap_matched(_events(V), _lengths(V), "series_id", 4), f"""
WITH {EVN}, g AS (SELECT series_id, gap, row_number() OVER (PARTITION BY series_id ORDER BY {u("'4'", "series_id", "k")}, k) AS k FROM eg)
SELECT e.series_id, e.k, (first_value(pos) OVER w + coalesce(sum(g.gap) OVER (PARTITION BY e.series_id ORDER BY e.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1) % n + 1 AS t, amp
FROM eg e JOIN g ON g.series_id = e.series_id AND g.k = e.k WINDOW w AS (PARTITION BY e.series_id ORDER BY e.k)""")
query("n5_control_family", "series_id:s family:s n:l mean_score:d min_score:d max_score:d",
      lambda V: resample.control_family(V.type_series, _events(V), _lengths(V), "series_id", 5,
                                        F.when(F.col("t") % 2 == 0, F.col("amp")).otherwise(0.0)), f"""
WITH {EVN}, er AS (SELECT *, r AS rep FROM eg, range(5) q(r)),
s AS (SELECT series_id, r AS rep, t, row_number() OVER (PARTITION BY series_id, r ORDER BY {u("'m'", "r", "series_id", "t")}, t) AS k FROM v_type_series, range(5) q(r)),
g AS (SELECT series_id, rep, gap, row_number() OVER (PARTITION BY series_id, rep ORDER BY {u("'g'", "rep", "series_id", "k")}, k) AS k FROM er),
gm AS (SELECT e.series_id, e.rep, (first_value(pos) OVER w + coalesce(sum(g.gap) OVER (PARTITION BY e.series_id, e.rep ORDER BY e.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1) % n + 1 AS t, amp
  FROM er e JOIN g ON g.series_id = e.series_id AND g.k = e.k AND g.rep = e.rep WINDOW w AS (PARTITION BY e.series_id, e.rep ORDER BY e.k)),
a AS (SELECT series_id, rep, s.t, amp, 'matched' AS family FROM er JOIN s USING (series_id, rep, k)
  UNION ALL SELECT series_id, rep, t, amp, 'gap_matched' FROM gm
  UNION ALL SELECT series_id, rep, (pos - 1 + (rep + 1) * 7) % n + 1, amp, 'shifted' FROM er),
o AS (SELECT series_id, family, rep, sum(CASE WHEN t % 2 = 0 THEN amp ELSE 0 END) AS s FROM a GROUP BY ALL)
SELECT series_id, family, count(*) AS n, avg(s) AS mean_score, min(s) AS min_score, max(s) AS max_score FROM o GROUP BY ALL""")

# pairwise model on mirrored differences, closed form


def pair_sql(src, train, test, by="", pair="grp, seed, unit"):
    b = by + ", " if by else ""
    on = "".join(f" AND m.{c} = t.{c}" for c in by.split(", ")) if by else ""
    pc = ", ".join(f"t.{c.strip()}" for c in pair.split(","))
    bt = ", ".join(f"t.{c}" for c in by.split(", ")) + ", " if by else ""
    return f"""
mo AS (SELECT {b}name, avg(d) AS m, CASE WHEN sqrt(avg(d * d)) > 1e-10 THEN sqrt(avg(d * d)) ELSE 1 END AS s FROM {src} WHERE {train} GROUP BY ALL),
hits AS (SELECT {bt}{pc}, CASE WHEN max(abs(d)) < 1e-9 THEN 0.5{D} WHEN sum(d / s * (2 * m / s)) >= -1e-12 THEN 1 ELSE 0 END AS hit
  FROM {src} t JOIN mo m ON m.name = t.name{on} WHERE {test} GROUP BY ALL)"""


SQL_TRAIN = f"grp IN {lst(TRAIN)} AND unit IN {lst(SEEN)}"
SQL_TEST = f"grp IN {lst(TEST)}"
HITS = pair_sql("v_unit_diffs", SQL_TRAIN, SQL_TEST)


def _hits(V):
    return models.pairwise_discriminate(V.unit_diffs, is_train(), is_test())


query("m8_pairwise_discriminate", "grp:s seed:l unit:s hit:d", _hits, f"WITH {HITS} SELECT * FROM hits")
query("m8_pairwise_return_flags", "unit:s n:l accuracy:d tie_rate:d",
      lambda V: models.accuracy(models.pairwise_discriminate(V.pair_diffs, F.col("grp") % 2 == 0, F.col("grp") % 2 == 1), "unit"), f"""
WITH {pair_sql('v_pair_diffs', 'grp % 2 = 0', 'grp % 2 = 1')}
SELECT unit, count(*) AS n, avg(hit) AS accuracy, avg(CASE WHEN hit = 0.5 THEN 1.0{D} ELSE 0 END) AS tie_rate FROM hits GROUP BY 1""")


def boot_sql(src, by, rid, reps, seed):
    """Bootstrap of hits in {0, 1/2, 1} by cumulative counts."""
    return f"""
bc AS (SELECT {by}, count(*) AS n, count(CASE WHEN hit = 0 THEN 1 END) AS c0, count(CASE WHEN hit < 1 THEN 1 END) AS c1, avg(hit) AS mean FROM {src} GROUP BY ALL),
bm AS (SELECT {by}, r AS rep, n, mean, avg(CASE WHEN j < c0 THEN 0.0{D} WHEN j < c1 THEN 0.5 ELSE 1 END) AS m FROM (
   SELECT *, floor({u(f"'{seed}'", "'rep'", "r", rid)} * n) AS j FROM {src} JOIN bc USING ({by}), range({reps}) q(r)) GROUP BY ALL),
bo AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY m, rep) - 1 AS rn FROM bm),
ci AS (SELECT {by}, any_value(n) AS n, any_value(mean) AS mean, max(CASE WHEN rn = {int(.025 * reps)} THEN m END) AS lo,
   max(CASE WHEN rn = {int(.975 * reps)} THEN m END) AS hi FROM bo GROUP BY ALL)"""


def _hit_ids(V):
    return _hits(V).withColumn("rid", F.concat_ws("/", "grp", "seed", "unit"))


query("n6_bootstrap_ci", "unit:s n:l mean:d lo:d hi:d", lambda V: resample.bootstrap_ci(_hit_ids(V), "unit", "rid", 200, 1), f"""
WITH {HITS}, hi2 AS (SELECT *, grp || '/' || seed || '/' || unit AS rid FROM hits), {boot_sql('hi2', 'unit', 'rid', 200, 1)} SELECT * FROM ci""")
DIFFS = f"WITH {BAND}, df AS (SELECT series_id, t, v - base AS difference FROM bd WHERE flag = 1 AND base IS NOT NULL)"


def tree_boot_sql(src, by, order, value, reps, seed):
    """Replicate means `bm(by, rep, m)` of `src`: draws split down a tree over leaves of at most 1,024 rows, then spread over each leaf."""
    normal = f"sqrt(-2.0{D} * ln(greatest({u(f"'{seed}'", "'split'", 'rep', by, 'lo', 'hi', "'a'")}, 1.0{D} / 4294967296.0{D}))) * cos(2.0{D} * pi() * {u(f"'{seed}'", "'split'", 'rep', by, 'lo', 'hi', "'b'")})"
    return f"""
bo AS (SELECT *, ceil(n / 1024.0{D})::BIGINT AS k FROM (SELECT {by}, {value} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {src})),
lf AS (SELECT {by}, leaf, list(x ORDER BY i) AS xs FROM (SELECT *, floor(i * k / n::DOUBLE)::BIGINT AS leaf FROM bo) GROUP BY ALL),
tr AS (SELECT DISTINCT {by}, r AS rep, n, k, 0::BIGINT AS lo, k AS hi, n AS m FROM bo, range({reps}) q(r)
 UNION ALL
 SELECT {by}, rep, n, k, CASE side WHEN 0 THEN lo ELSE mid END, CASE side WHEN 0 THEN mid ELSE hi END, CASE side WHEN 0 THEN l ELSE m - l END FROM (
  SELECT *, least(greatest(floor(m * p + sqrt(m * p * (1.0{D} - p)) * z + 0.5{D}), 0), m)::BIGINT AS l FROM (
   SELECT *, (ceil(mid * n / k::DOUBLE) - ceil(lo * n / k::DOUBLE)) / (ceil(hi * n / k::DOUBLE) - ceil(lo * n / k::DOUBLE)) AS p, {normal} AS z
   FROM (SELECT *, (lo + hi) // 2 AS mid FROM tr WHERE hi - lo > 1))), (VALUES (0), (1)) AS sides(side)),
dr AS (SELECT {by}, rep, n, lo AS leaf, unnest(range(m)) AS d FROM tr WHERE hi - lo = 1),
bm AS (SELECT {by}, rep, sum(xs[1 + floor(('0x' || substr(md5(concat_ws(':', '{seed}', 'draw', rep, {by}, leaf, d // 4)), (1 + 8 * (d % 4))::INT, 8))::BIGINT / 4294967296.0{D} * len(xs))::INT]) / any_value(n) AS m
  FROM dr JOIN lf USING ({by}, leaf) GROUP BY ALL)"""


query("n7_bootstrap_mean_ci", "series_id:s lo:d hi:d", lambda V: resample.bootstrap_mean_ci(
    pairing.band_baseline(V.type_series, "series_id"), "series_id", "t", F.floor(F.col("t") / 512), reps=100, seed=2), f"""
{DIFFS.replace("WITH", "WITH RECURSIVE", 1)}, {tree_boot_sql("df", "series_id", "t", "difference", 100, 2)}
SELECT series_id, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY 1""")
query("n8_block_bootstrap_ci", "series_id:s lo:d hi:d", lambda V: resample.block_bootstrap_ci(
    V.type_series, "series_id", "v", 21, 100, 5), f"""
WITH n AS (SELECT series_id, count(*) AS n FROM v_type_series GROUP BY 1),
b AS (SELECT series_id, n, r AS rep, unnest(range((n - 1) // 21 + 1)) AS b FROM n, range(100) q(r)),
s AS (SELECT *, floor({u("'5'", "rep", "series_id", "b")} * n)::BIGINT AS st, unnest(range(21)) AS o FROM b),
m AS (SELECT s.series_id, rep, sum(v) / any_value(n) AS m FROM s JOIN v_type_series t ON t.series_id = s.series_id AND t.t = (st + o) % n + 1
  WHERE b * 21 + o < n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY m, rep) - 1 AS rn FROM m)
SELECT series_id, max(CASE WHEN rn = 2 THEN m END) AS lo, max(CASE WHEN rn = 97 THEN m END) AS hi FROM r GROUP BY 1""")
query("n9_sign_flip_test", "series_id:s exceedances:l p:d", lambda V: resample.sign_flip_test(
    pairing.band_baseline(V.type_series, "series_id"), "series_id", "t", reps=200, seed=9), f"""
{DIFFS}, r AS (SELECT series_id, r, sum(difference * CASE WHEN {u("'9'", "r", "series_id", "t")} < 0.5{D} THEN -1 ELSE 1 END) AS s, sum(difference) AS o
  FROM df, range(200) q(r) GROUP BY ALL)
SELECT series_id, count(CASE WHEN abs(s) >= abs(o) - 1e-9 THEN 1 END) AS exceedances, (count(CASE WHEN abs(s) >= abs(o) - 1e-9 THEN 1 END) + 1) / 201.0{D} AS p FROM r GROUP BY 1""")

# generic classifier in SQL: z-scores, centroids, mean-difference weights


def model_sql(train, by=""):
    b = by + ", " if by else ""
    us = f"({b}name)"
    return f"""
st AS (SELECT {b}name, avg(value) AS mu, CASE WHEN stddev_pop(value) > 1e-10 THEN stddev_pop(value) ELSE 1 END AS sd, sum(value) AS s, count(*) AS n FROM {train} GROUP BY ALL),
cl AS (SELECT {b}name, label, avg(value) AS m, sum(value) AS sc, count(*) AS nc FROM {train} GROUP BY ALL),
md AS (SELECT {b}name, label, mu, sd, (m - mu) / sd AS c, ((s - sc) / (n - nc) - mu) / sd AS r FROM cl JOIN st USING {us})"""


def score_sql(test, by="", sample="sample_id"):
    b = by + ", " if by else ""
    us = f"({b}name)"
    return f"""
sc AS (SELECT {b}{sample}, md.label AS label, sum(((value - mu) / sd - c) * ((value - mu) / sd - c)) AS dist2,
   sum((value - mu) / sd * (c - r) - 0.5{D} * (c - r) * (c + r)) AS score FROM {test} t JOIN md USING {us} GROUP BY ALL)"""


def pred_sql(by="", sample="sample_id"):
    b = by + ", " if by else ""
    return f"""
pr AS (SELECT {b}{sample}, arg_min(label, (dist2, label)) AS pred_centroid, arg_min(label, (-score, label)) AS pred_meandiff FROM sc GROUP BY ALL)"""


UF = "sample_id, unit"
UKEY = ["sample_id", "unit"]
TR = f"tr AS (SELECT * FROM v_unit_features WHERE grp IN {lst(TRAIN)})"
TE = f"te AS (SELECT sample_id, unit, label AS true_label, name, value FROM v_unit_features WHERE grp IN {lst(TEST)})"
TED = f"te AS (SELECT sample_id, unit, name, value FROM v_unit_features WHERE grp IN {lst(TEST)})"
CLASSIFIER = f"{TR}, {TED}, {model_sql('tr')}, {score_sql('te', sample=UF)}, {pred_sql(sample=UF)}"


def _train(V):
    return V.unit_features.filter(F.col("grp").isin(TRAIN))


def _test(V):
    return V.unit_features.filter(F.col("grp").isin(TEST))


def _scores(V):
    return models.class_scores(_test(V), models.fit(_train(V)), (), UKEY)


def _preds(V):
    truth = V.unit_grids.filter(F.col("grp").isin(TEST)).select("sample_id", "unit", "grp", "label")
    return models.predict(_scores(V), (), UKEY).join(truth, UKEY)


PREDS = f"""{CLASSIFIER}, pl AS (SELECT sample_id, unit, 'g' || (sample_id % 8) AS grp, CASE WHEN unit = 'none' THEN 'continuous' ELSE 'computational' END AS label,
   pred_meandiff AS pred FROM pr)"""

query("m1_zscore", "sample_id:l unit:s name:s z:d",
      lambda V: models.zscore_transform(_test(V), models.zscore_fit(_train(V))), f"""
WITH {TR}, {TE}, {model_sql('tr')} SELECT sample_id, unit, name, (value - mu) / sd AS z FROM te JOIN st USING (name)""")
query("m2_centroid", "sample_id:l unit:s pred_centroid:s", lambda V: models.predict(_scores(V), (), UKEY),
      f"WITH {CLASSIFIER} SELECT sample_id, unit, pred_centroid FROM pr")
query("m3_meandiff", "sample_id:l unit:s pred_meandiff:s", lambda V: models.predict(_scores(V), (), UKEY),
      f"WITH {CLASSIFIER} SELECT sample_id, unit, pred_meandiff FROM pr")
PROBS = """
pb AS (SELECT sample_id, unit, label, 1 / (sqrt(dist2) + 1e-10) / sum(1 / (sqrt(dist2) + 1e-10)) OVER w AS p_centroid,
  exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS p_meandiff FROM sc WINDOW w AS (PARTITION BY sample_id, unit))"""
query("m4_combined_predict", "sample_id:l unit:s label:s p_centroid:d p_meandiff:d p:d",
      lambda V: models.probabilities(_scores(V), (), UKEY), f"""
WITH {CLASSIFIER}, {PROBS} SELECT *, (p_centroid + p_meandiff) / 2 AS p FROM pb""")


def _sc2(V):
    names = ["repeated", "dominant"]
    key = F.concat_ws("/", "sample_id", "unit")
    tr = _train(V).filter(F.col("name").isin(names)).withColumn("key", key)
    te = _test(V).filter(F.col("name").isin(names)).withColumn("key", key)
    d = models.standardized_centroid(tr, te, names, "key")
    return d.select("key", "pred", F.col("dists")["continuous"].alias("d_continuous"), F.col("dists")["computational"].alias("d_computational"))


query("m5_standardized_centroid", "key:s pred:s d_continuous:d d_computational:d", _sc2, f"""
WITH tr AS (SELECT * FROM v_unit_features WHERE grp IN {lst(TRAIN)} AND name IN ('repeated', 'dominant')),
te AS (SELECT sample_id || '/' || unit AS key, name, value FROM v_unit_features WHERE grp IN {lst(TEST)} AND name IN ('repeated', 'dominant')),
{model_sql('tr')}, {score_sql('te', sample='key')}
SELECT key, arg_min(label, (dist2, label)) AS pred, max(CASE WHEN label = 'continuous' THEN dist2 END) AS d_continuous,
 max(CASE WHEN label = 'computational' THEN dist2 END) AS d_computational FROM sc GROUP BY 1""")
REPORT_COLS = "tp:l tn:l fp:l fn:l excluded:l n:l accuracy:d balanced_accuracy:d recall:d specificity:d precision:d f1:d always_positive:d majority:d"


def report_sql(src, by=""):
    b = by + ", " if by else ""
    return f"""
SELECT {b}tp, tn, fp, fn, 0 AS excluded, tp + tn + fp + fn AS n, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy,
 (tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2 AS balanced_accuracy, tp / nullif(tp + fn, 0)::DOUBLE AS recall,
 tn / nullif(tn + fp, 0)::DOUBLE AS specificity, tp / nullif(tp + fp, 0)::DOUBLE AS precision, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1,
 (tp + fn) / (tp + tn + fp + fn)::DOUBLE AS always_positive, greatest(tp + fn, tn + fp) / (tp + tn + fp + fn)::DOUBLE AS majority
FROM (SELECT {b}count(CASE WHEN label = 'computational' AND pred = label THEN 1 END) AS tp, count(CASE WHEN label = 'continuous' AND pred = label THEN 1 END) AS tn,
 count(CASE WHEN label = 'continuous' AND pred <> label THEN 1 END) AS fp, count(CASE WHEN label = 'computational' AND pred <> label THEN 1 END) AS fn FROM {src} GROUP BY ALL)"""


query("m6_classification_report", "unit:s " + REPORT_COLS,
      lambda V: models.classification_report(_preds(V), "computational", "continuous", "unit"), f"WITH {PREDS} {report_sql('pl', 'unit')}")
query("m6_confusion", "label:s pred:s n:l", lambda V: models.confusion(_preds(V)),
      f"WITH {PREDS} SELECT label, pred, count(*) AS n FROM pl GROUP BY ALL")
query("m7_report_by", "grp:s unit:s n:l accuracy:d classes:l set_id:l", lambda V: models.report_by(_preds(V), ["grp", "unit"]), f"""
WITH {PREDS} SELECT grp, unit, count(*) AS n, avg(CASE WHEN label = pred THEN 1.0{D} ELSE 0 END) AS accuracy, count(DISTINCT label) AS classes,
 grouping_id(grp, unit) AS set_id FROM pl GROUP BY CUBE (grp, unit)""")
query("m9_balance_per_group", "grp:s sample_id:l label:s",
      lambda V: models.balance_per_group(V.doc_features.filter("name = 'length'"), "grp"), """
WITH s AS (SELECT * FROM v_doc_features WHERE name = 'length'), c AS (SELECT grp, label, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT grp, min(n) AS m FROM c GROUP BY 1 HAVING count(*) = 2),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, label ORDER BY sample_id) AS r FROM s)
SELECT grp, sample_id, label FROM r JOIN m USING (grp) WHERE r <= m""")
query("m10_group_split", "sample_id:l grp:s split:s", lambda V: models.group_split(
    V.samples, {"train": TRAIN, "validation": ["g5"]}), "SELECT sample_id, grp, split FROM v_samples")


def _loo(V):
    train, test = models.leave_one_out(V.unit_diffs, "unit", SEEN + UNSEEN)
    return models.accuracy(models.pairwise_hits(test, models.pairwise_fit(train, ["fold"]), ["fold"]), "fold")


query("m11_leave_one_out", "fold:s n:l accuracy:d tie_rate:d", _loo, f"""
WITH tr AS (SELECT d.*, fold FROM v_unit_diffs d, (SELECT unnest({SEEN + UNSEEN}) AS fold) WHERE fold <> unit),
mo AS (SELECT fold, name, avg(d) AS m, CASE WHEN sqrt(avg(d * d)) > 1e-10 THEN sqrt(avg(d * d)) ELSE 1 END AS s FROM tr GROUP BY ALL),
h AS (SELECT fold, grp, seed, CASE WHEN max(abs(d)) < 1e-9 THEN 0.5{D} WHEN sum(d / s * (2 * m / s)) >= -1e-12 THEN 1 ELSE 0 END AS hit
  FROM v_unit_diffs t JOIN mo ON mo.fold = t.unit AND mo.name = t.name GROUP BY ALL)
SELECT fold, count(*) AS n, avg(hit) AS accuracy, avg(CASE WHEN hit = 0.5 THEN 1.0{D} ELSE 0 END) AS tie_rate FROM h GROUP BY 1""")
query("m12_disjoint_matrix", "cell:s n:l accuracy:d tie_rate:d", lambda V: models.accuracy(models.disjoint_matrix(
    V.unit_diffs, TRAIN, TEST, SEEN, UNSEEN), "cell"), f"""
WITH {pair_sql('v_unit_diffs', SQL_TRAIN, 'true')},
c AS (SELECT *, CASE WHEN grp IN {lst(TRAIN)} THEN 'seen_grp' WHEN grp IN {lst(TEST)} THEN 'unseen_grp' END || '/' ||
  CASE WHEN unit IN {lst(SEEN)} THEN 'seen_unit' WHEN unit IN {lst(UNSEEN)} THEN 'unseen_unit' END AS cell FROM hits)
SELECT cell, count(*) AS n, avg(hit) AS accuracy, avg(CASE WHEN hit = 0.5 THEN 1.0{D} ELSE 0 END) AS tie_rate FROM c WHERE cell IS NOT NULL GROUP BY 1""")
FAMILIES = {"count": ["distinct_values", "repeated"], "shape": ["dominant", "value_entropy"]}
SETS = models.ablation_sets(FAMILIES)
ABL = "sets(set_name, name) AS (VALUES " + ", ".join(f"('{s}', '{f}')" for s, f in SETS) + "), ab AS (SELECT d.*, set_name FROM v_unit_diffs d JOIN sets USING (name))"
ABLS = f"WITH {ABL}, {pair_sql('ab', SQL_TRAIN, SQL_TEST, 'set_name')}, ac AS (SELECT set_name, count(*) AS n, avg(hit) AS accuracy FROM hits GROUP BY 1)"


def _ablate(V):
    return models.accuracy(models.ablation(V.unit_diffs, SETS, is_train(), is_test()), "set").withColumn("set_name", F.col("set"))


query("m13_ablation", "set_name:s n:l accuracy:d", _ablate, f"{ABLS} SELECT * FROM ac")
query("m13_ablation_summary", "singles_above_chance:l min_drop_one:d redundant:b", lambda V: models.ablation_summary(_ablate(V)), f"""
{ABLS} SELECT count(CASE WHEN set_name LIKE 'single:%' AND accuracy > 0.55{D} THEN 1 END) AS singles_above_chance,
 min(CASE WHEN set_name LIKE 'drop:%' THEN accuracy END) AS min_drop_one, min(CASE WHEN set_name LIKE 'drop:%' THEN accuracy END) > 0.55{D} AS redundant FROM ac""")
BLOCKS = [(f"family:{k}", f) for k, fs in FAMILIES.items() for f in fs] + [("all", f) for fs in FAMILIES.values() for f in fs]


def _blocks(V):
    h = models.ablation(V.unit_diffs, BLOCKS, is_train(), is_test())
    return resample.bootstrap_ci(h.withColumn("rid", F.concat_ws("/", "grp", "seed", "unit")), "set", "rid", 200, 3).withColumn("set_name", F.col("set"))


BSET = "sets(set_name, name) AS (VALUES " + ", ".join(f"('{s}', '{f}')" for s, f in BLOCKS) + "), ab AS (SELECT d.*, set_name FROM v_unit_diffs d JOIN sets USING (name))"
query("m14_feature_block_separation", "set_name:s n:l mean:d lo:d hi:d", _blocks, f"""
WITH {BSET}, {pair_sql('ab', SQL_TRAIN, SQL_TEST, 'set_name')}, hi2 AS (SELECT *, grp || '/' || seed || '/' || unit AS rid FROM hits),
{boot_sql('hi2', 'set_name', 'rid', 200, 3)} SELECT * FROM ci""")


def _separation(V):
    truth = _test(V).select("sample_id", "unit", F.col("label").alias("true_label")).distinct()
    return models.score_separation(models.probabilities(_scores(V), (), UKEY).join(truth, UKEY), "computational", by="unit")


query("m15_score_separation", "positive_mean:d negative_mean:d separation:d", lambda V: models.score_separation(
    models.probabilities(_scores(V), (), UKEY).withColumn(
        "true_label", F.when(F.col("unit") == "none", "continuous").otherwise("computational")), "computational"), f"""
WITH {CLASSIFIER}, {PROBS}, q AS (SELECT (p_centroid + p_meandiff) / 2 AS p, unit FROM pb WHERE label = 'computational')
SELECT avg(CASE WHEN unit <> 'none' THEN p END) AS positive_mean, avg(CASE WHEN unit = 'none' THEN p END) AS negative_mean,
 abs(avg(CASE WHEN unit <> 'none' THEN p END) - avg(CASE WHEN unit = 'none' THEN p END)) AS separation FROM q""")


def _robust(V):
    from ..operators import degrade
    g = V.unit_grids.filter(F.col("grp").isin(TEST))
    arms = F.array(*[F.struct(F.lit(o).alias("obs"), degrade.array_unit(o, F.col("vals"), F.col("sample_id"), W, H).alias("vals"))
                     for o in ("none", "decimal3", "levels12")])
    d = g.select("sample_id", "unit", "label", F.explode(arms).alias("a")).select("sample_id", "unit", "label", "a.obs", "a.vals")
    f = degrade.discreteness_features(d, ["sample_id", "unit", "label", "obs"])
    p = models.predict(models.class_scores(f, models.fit(_train(V)), (), UKEY + ["obs"]), (), UKEY + ["obs"])
    p = p.withColumn("label", F.when(F.col("unit") == "none", "continuous").otherwise("computational"))
    return models.classification_report(p, "computational", "continuous", "obs")


query("m16_robustness", "obs:s " + REPORT_COLS, _robust, f"""
WITH {TR}, {model_sql('tr')},
rg AS (SELECT sample_id, unit, v, min(v) OVER (PARTITION BY sample_id, unit) AS lo, max(v) OVER (PARTITION BY sample_id, unit) AS hi
  FROM v_unit_cells WHERE grp IN {lst(TEST)}),
dg AS (SELECT sample_id, unit, 'none' AS obs, v FROM rg UNION ALL SELECT sample_id, unit, 'decimal3', round_even(v * 1000.0{D}, 0) / 1000.0{D} FROM rg
  UNION ALL SELECT sample_id, unit, 'levels12', lo + least(trunc((v - lo) / (hi - lo) * 12.0{D}), 11) * (hi - lo) / 12.0{D} FROM rg),
hh AS (SELECT sample_id, unit, obs, v, count(*) AS n FROM dg GROUP BY ALL),
ag AS (SELECT sample_id, unit, obs, count(*)::DOUBLE AS distinct_values, 1.0{D} - count(*) / sum(n)::DOUBLE AS repeated, max(n) / sum(n)::DOUBLE AS dominant,
  ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n) AS value_entropy FROM hh GROUP BY ALL),
te AS (UNPIVOT ag ON distinct_values, repeated, dominant, value_entropy INTO NAME name VALUE value),
{score_sql('te', sample='sample_id, unit, obs')}, {pred_sql(sample='sample_id, unit, obs')},
pl AS (SELECT obs, CASE WHEN unit = 'none' THEN 'continuous' ELSE 'computational' END AS label, pred_meandiff AS pred FROM pr)
{report_sql('pl', 'obs')}""")
query("m17_probe_table", "unit:s n:l accuracy:d tie_rate:d distinct_values:d value_entropy:d",
      lambda V: models.probe_table(_hits(V), _test(V).filter("unit <> 'none'")), f"""
WITH {HITS}, f AS (SELECT unit, avg(CASE WHEN name = 'distinct_values' THEN value END) AS distinct_values,
  avg(CASE WHEN name = 'value_entropy' THEN value END) AS value_entropy FROM v_unit_features WHERE {SQL_TEST} GROUP BY 1)
SELECT unit, count(*) AS n, avg(hit) AS accuracy, avg(CASE WHEN hit = 0.5 THEN 1.0{D} ELSE 0 END) AS tie_rate,
 any_value(distinct_values) AS distinct_values, any_value(value_entropy) AS value_entropy FROM hits JOIN f USING (unit) GROUP BY 1""")
query("m18_cohort_audit", "split:s n:l distinct_content:l distinct_values:d repeated:d",
      lambda V: models.cohort_audit(V.unit_grids, "split", V.unit_features, ["distinct_values", "repeated"]), """
WITH c AS (SELECT split, sample_id, unit, md5(string_agg(v, ',' ORDER BY idx)) AS h FROM v_unit_cells GROUP BY ALL),
f AS (SELECT split, avg(CASE WHEN name = 'distinct_values' THEN value END) AS distinct_values, avg(CASE WHEN name = 'repeated' THEN value END) AS repeated
  FROM v_unit_features GROUP BY 1)
SELECT split, count(*) AS n, count(DISTINCT h) AS distinct_content, any_value(distinct_values) AS distinct_values, any_value(repeated) AS repeated
FROM c JOIN f USING (split) GROUP BY 1""")
query("m19_detection_rate", "unit:s n:l detected:l missed:l rate:d",
      lambda V: models.detection_rate(_preds(V), "unit", "computational"), f"""
WITH {PREDS} SELECT unit, count(*) AS n, count(CASE WHEN pred = 'computational' THEN 1 END) AS detected,
 count(CASE WHEN pred <> 'computational' THEN 1 END) AS missed, avg(CASE WHEN pred = 'computational' THEN 1.0{D} ELSE 0 END) AS rate FROM pl GROUP BY 1""")
query("m20_frozen_model_digest", "digest:s rows:l", lambda V: models.FrozenModel.digest(
    models.fit(_train(V)).select("name", "label", *[F.floor(F.col(c) * 1e6 + 0.50013).alias(c) for c in ("mu", "sd", "c", "w", "b")])))

# -- nulls on top of the classifiers ---------------------------------------------------------------------

UNIT_NO = lambda: F.array_position(F.array(*[F.lit(u) for u in UNITS]), F.col("unit")) - 1


def _label_perm(V):
    return models.label_permutation_null(_train(V), _test(V), 10, "perm", F.col("sample_id") * len(UNITS) + UNIT_NO(), sample=UKEY)


def _label_perm_summary(V):
    return models.permutation_summary(models.accuracies(_preds(V)), _label_perm(V))


LABEL_PERM = f"""ids AS (SELECT DISTINCT sample_id, unit, label, sample_id * {len(UNITS)} + list_position([{', '.join(f"'{u_}'" for u_ in UNITS)}], unit) - 1 AS id
  FROM v_unit_features WHERE grp IN {lst(TRAIN)}),
rp AS (SELECT *, r AS rep, row_number() OVER (PARTITION BY r ORDER BY id) AS p, row_number() OVER (PARTITION BY r ORDER BY {u("'perm'", "r", "id")}, id) AS q FROM ids, range(10) w(r)),
tr AS (SELECT a.rep, b.label, f.name, f.value FROM rp a JOIN rp b ON b.rep = a.rep AND b.q = a.p JOIN v_unit_features f ON f.sample_id = a.sample_id AND f.unit = a.unit),
te AS (SELECT r AS rep, sample_id, unit, name, value FROM v_unit_features, range(10) w(r) WHERE grp IN {lst(TEST)}),
{model_sql('tr', 'rep')}, {score_sql('te', 'rep', UF)}, {pred_sql('rep', UF)},
lh AS (SELECT rep, unit = 'none' AS t, count(*) AS n, count(CASE WHEN (unit = 'none') = (pred_meandiff = 'continuous') THEN 1 END) AS h FROM pr GROUP BY ALL),
nl AS (SELECT rep, sum(n) AS n, sum(h) / sum(n)::DOUBLE AS accuracy, avg(h / n::DOUBLE) AS balanced FROM lh GROUP BY 1)"""
query("n10_label_permutation_null", "rep:l n:l accuracy:d balanced:d", _label_perm, f"WITH {LABEL_PERM} SELECT * FROM nl")
query("n10_label_permutation_summary", "real:d reps:l mean:d min:d max:d p:d", _label_perm_summary, f"""
SELECT any_value(b.real) AS real, count(*) AS reps, avg(a.balanced) AS mean, min(a.balanced) AS min, max(a.balanced) AS max,
 (count(CASE WHEN a.balanced >= b.real - 1e-12{D} THEN 1 END) + 1) / (count(*) + 1.0{D}) AS p
FROM (WITH {LABEL_PERM} SELECT * FROM nl) a, (WITH {PREDS}, rc AS (SELECT label, avg(CASE WHEN label = pred THEN 1.0{D} ELSE 0 END) AS h FROM pl GROUP BY 1)
 SELECT avg(h) AS real FROM rc) b""")


def _feature_perm(V):
    te = _test(V).withColumn("id", F.concat_ws("/", "sample_id", "unit"))
    sh = resample.shuffle_values(te.select("name", "id", "value", "sample_id"), "name", "id", "value", "fp", F.substring("id", 1, 1))
    fam = F.array(*[F.struct(F.lit(k).alias("fam"), F.array(*[F.lit(f) for f in fs]).alias("fs")) for k, fs in FAMILIES.items()],
                  F.struct(F.lit("baseline").alias("fam"), F.array().cast("array<string>").alias("fs")))
    j = te.join(sh.select("name", "id", "shuffled"), ["name", "id"]).withColumn("_f", F.explode(fam))
    x = j.select("_f.fam", "id", "unit", "name", F.when(F.array_contains("_f.fs", F.col("name")), F.col("shuffled")).otherwise(F.col("value")).alias("value"))
    p = models.predict(models.class_scores(x, models.fit(_train(V)), (), ["fam", "id", "unit"]), (), ["fam", "id", "unit"])
    ok = F.when((F.col("unit") == "none") == (F.col("pred") == "continuous"), 1.0).otherwise(0.0)
    return p.groupBy("fam").agg(F.avg(ok).alias("accuracy"))


query("n11_feature_permutation", "fam:s accuracy:d", _feature_perm, f"""
WITH te0 AS (SELECT sample_id || '/' || unit AS id, unit, name, value FROM v_unit_features WHERE grp IN {lst(TEST)}),
pm AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS p, row_number() OVER (PARTITION BY name ORDER BY {u("'fp'", "name", "id")}, id) AS q FROM te0),
sh AS (SELECT a.id, a.unit, a.name, a.value, b.value AS shuffled FROM pm a JOIN pm b ON b.name = a.name AND b.q = a.p),
te AS (SELECT fam, id, unit, name, CASE WHEN (fam = 'count' AND name IN ('distinct_values', 'repeated')) OR (fam = 'shape' AND name IN ('dominant', 'value_entropy'))
   THEN shuffled ELSE value END AS value FROM sh, (SELECT unnest(['count', 'shape', 'baseline']) AS fam)),
{TR}, {model_sql('tr')}, {score_sql('te', sample='fam, id, unit')}, {pred_sql(sample='fam, id, unit')}
SELECT fam, avg(CASE WHEN (unit = 'none') = (pred_meandiff = 'continuous') THEN 1.0{D} ELSE 0 END) AS accuracy FROM pr GROUP BY 1""")


def _donor(V):
    d = V.unit_diffs.withColumn("id", F.concat_ws("/", "grp", "seed", "unit"))
    ids = scale.replicate(d.select("id").distinct(), 5)
    p = resample.permutation(ids, "rep", "id", hash_uniform("donor", F.col("rep"), F.col("id")), F.substring("id", 1, 4))
    m = p.join(d.select(F.col("id").alias("donor"), "name", "d"), "donor")
    parts = F.split("id", "/")
    m = m.select("rep", parts[0].alias("grp"), parts[1].cast("bigint").alias("seed"), parts[2].alias("unit"), "name", "d")
    return models.accuracy(models.pairwise_discriminate(m, is_train(), is_test(), ["rep"]), "rep")


query("n12_donor_permutation", "rep:l n:l accuracy:d tie_rate:d", _donor, f"""
WITH ids AS (SELECT DISTINCT grp || '/' || seed || '/' || unit AS id, grp, seed, unit FROM v_unit_diffs),
rp AS (SELECT *, r AS rep, row_number() OVER (PARTITION BY r ORDER BY id) AS p, row_number() OVER (PARTITION BY r ORDER BY {u("'donor'", "r", "id")}, id) AS q FROM ids, range(5) w(r)),
dd AS (SELECT a.rep, a.grp, a.seed, a.unit, f.name, f.d FROM rp a JOIN rp b ON b.rep = a.rep AND b.q = a.p
  JOIN v_unit_diffs f ON f.grp = b.grp AND f.seed = b.seed AND f.unit = b.unit),
{pair_sql('dd', SQL_TRAIN, SQL_TEST, 'rep')}
SELECT rep, count(*) AS n, avg(hit) AS accuracy, avg(CASE WHEN hit = 0.5 THEN 1.0{D} ELSE 0 END) AS tie_rate FROM hits GROUP BY 1""")
NULLS = """
nul AS (SELECT run_id, step, max(score) AS stat FROM v_evals WHERE step % 12 <> 0 GROUP BY ALL),
obs AS (SELECT run_id, avg(stat) AS observed FROM (SELECT run_id, step, max(score) AS stat FROM v_evals WHERE step % 12 = 0 GROUP BY ALL) GROUP BY 1)"""


def _null(V):
    """Monthly best scores: eleven months are the null searches, the twelfth is observed."""
    s = resample.search_null(V.evals, ["run_id", "step"])
    obs = s.filter(F.col("step") % 12 == 0).groupBy("run_id").agg(F.avg("stat").alias("observed"))
    return s.filter(F.col("step") % 12 != 0), obs


query("n14_empirical_p", "run_id:s observed:d n_null:l null_mean:d null_sd:d p_value:d z:d",
      lambda V: resample.empirical_p(*_null(V), "run_id"), f"""
WITH {NULLS} SELECT run_id, any_value(observed) AS observed, count(*) AS n_null, avg(stat) AS null_mean, stddev_pop(stat) AS null_sd,
 (count(CASE WHEN stat >= observed THEN 1 END) + 1) / (count(*) + 1)::DOUBLE AS p_value, (any_value(observed) - avg(stat)) / stddev_pop(stat) AS z
FROM nul JOIN obs USING (run_id) GROUP BY 1""")
query("n15_null_statistics", "run_id:s status:s observed:d n:l null_mean:d null_std:d null_median:d null_max:d minus_mean:d percentile:d exceedances:l search_null:d minimum_attainable:d",
      lambda V: resample.null_statistics(*_null(V), "run_id"), f"""
WITH {NULLS} SELECT run_id, 'OK' AS status, any_value(observed) AS observed, count(*) AS n, avg(stat) AS null_mean, stddev_samp(stat) AS null_std,
 median(stat) AS null_median, max(stat) AS null_max, any_value(observed) - avg(stat) AS minus_mean,
 100.0{D} * count(CASE WHEN stat < observed THEN 1 END) / count(*) AS percentile, count(CASE WHEN stat >= observed THEN 1 END) AS exceedances,
 (count(CASE WHEN stat >= observed THEN 1 END) + 1) / (count(*) + 1)::DOUBLE AS search_null, 1 / (count(*) + 1)::DOUBLE AS minimum_attainable
FROM nul JOIN obs USING (run_id) GROUP BY 1""")
query("n16_search_null", "run_id:s step:l stat:d candidate_id:l budget:l", lambda V: resample.search_null(V.evals, ["run_id", "step"]), """
SELECT run_id, step, max(score) AS stat, arg_min(candidate_id, (-score, candidate_id)) AS candidate_id, count(*) AS budget
FROM v_evals WHERE score IS NOT NULL GROUP BY ALL""")


def _identical(V):
    """Every pair differs from itself by nothing, in both orientations."""
    zero = V.unit_diffs.withColumn("d", F.col("d") - F.col("d"))
    both = pairing.mirror_augment(zero).select("grp", "seed", "unit", "name", F.col("label").alias("orientation"), F.col("value").alias("d"))
    h = models.pairwise_hits(both, models.pairwise_fit(V.unit_diffs.filter(is_train())), (), ["grp", "seed", "unit", "orientation"])
    return models.accuracy(h, "orientation")


query("n17_identical_null", "orientation:s n:l accuracy:d tie_rate:d", _identical, """
SELECT o AS orientation, count(*) AS n, 0.5 AS accuracy, 1.0 AS tie_rate
FROM (SELECT DISTINCT grp, seed, unit FROM v_unit_diffs), (SELECT unnest(['A', 'B']) AS o) GROUP BY 1""")


def _artifact(V):
    """Both members are reference samples; only the rank remapping onto a neighbour differs."""
    m = pairing.rank_join(V.pairs_cells)
    c = V.pairs_cells.select("pair_id", "idx", F.col("f").alias("v"), F.lit("reference").alias("unit")).unionByName(
        m.select("pair_id", "idx", F.col("matched").alias("v"), F.lit("remapped").alias("unit")))
    g = fields.to_grids(c, ["pair_id", "unit"], W, H)
    f = fields.gradient_energy(g, ["pair_id", "unit"], W, H).withColumnRenamed("gradient_energy", "value").withColumn("name", F.lit("gradient_energy"))
    f = f.select(F.col("pair_id").alias("seed"), F.concat(F.lit("g"), (F.col("pair_id") % 8).cast("string")).alias("grp"), "unit", "name", "value")
    d = pairing.feature_diff(f, F.col("unit") == "reference", F.col("unit") == "remapped")
    return models.accuracy(models.pairwise_discriminate(d, F.col("grp").isin(TRAIN), is_test()), "unit")


query("n18_artifact_null", "unit:s n:l accuracy:d tie_rate:d", _artifact, f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY f, idx) AS rf, row_number() OVER (PARTITION BY pair_id ORDER BY t, idx) AS rt FROM v_pairs_cells),
m AS (SELECT a.pair_id, a.y, a.x, a.f, b.t AS g FROM a JOIN a b ON b.pair_id = a.pair_id AND b.rt = a.rf),
n AS (SELECT *, lead(f) OVER r AS fr, lead(f) OVER c AS fd, lead(g) OVER r AS gr, lead(g) OVER c AS gd FROM m
  WINDOW r AS (PARTITION BY pair_id, y ORDER BY x), c AS (PARTITION BY pair_id, x ORDER BY y)),
dd AS (SELECT 'g' || (pair_id % 8) AS grp, pair_id AS seed, 'remapped' AS unit, 'gradient_energy' AS name,
  (sum((gr - g) * (gr - g)) + sum((gd - g) * (gd - g))) - (sum((fr - f) * (fr - f)) + sum((fd - f) * (fd - f))) AS d FROM n GROUP BY ALL),
{pair_sql('dd', f"grp IN {lst(TRAIN)}", f"t.grp IN {lst(TEST)}")}
SELECT unit, count(*) AS n, avg(hit) AS accuracy, avg(CASE WHEN hit = 0.5 THEN 1.0{D} ELSE 0 END) AS tie_rate FROM hits GROUP BY 1""")


def _matched_trajectory(V):
    f = V.frames
    nxt = f.select("series_id", (F.col("t") - 1).alias("t"), "idx", F.col("v").alias("target"))
    p = f.join(nxt, ["series_id", "t", "idx"]).select("series_id", F.col("t").alias("frame"), "idx", F.col("v").alias("f"), F.col("target").alias("t"))
    return pairing.rank_join(p, ["series_id", "frame"])


query("n19_matched_trajectory", "series_id:l frame:l idx:l source:d matched:d", _matched_trajectory, """
WITH p AS (SELECT a.series_id, a.t AS frame, a.idx, a.v AS f, b.v AS g FROM v_frames a JOIN v_frames b ON b.series_id = a.series_id AND b.t = a.t + 1 AND b.idx = a.idx),
a AS (SELECT *, row_number() OVER (PARTITION BY series_id, frame ORDER BY f, idx) AS rf, row_number() OVER (PARTITION BY series_id, frame ORDER BY g, idx) AS rt FROM p)
SELECT a.series_id, a.frame, a.idx, a.f AS source, b.g AS matched FROM a JOIN a b ON b.series_id = a.series_id AND b.frame = a.frame AND b.rt = a.rf""")
query("n20_surrogate_summary", "run_id:s n:l mean:d sd:d median:d p90:d p95:d max:d",
      lambda V: resample.surrogate_summary(_null(V)[0], "run_id"), f"""
WITH {NULLS}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY stat) - 1 AS r, count(*) OVER (PARTITION BY run_id) AS n FROM nul)
SELECT run_id, count(*) AS n, avg(stat) AS mean, stddev_pop(stat) AS sd, max(CASE WHEN r = floor(0.5{D} * n) THEN stat END) AS median,
 max(CASE WHEN r = floor(0.9{D} * n) THEN stat END) AS p90, max(CASE WHEN r = floor(0.95{D} * n) THEN stat END) AS p95, max(stat) AS max FROM o GROUP BY 1""")
query("n21_effect_size", "series_id:s n:l mean:d sd:d effect:d status:s", lambda V: resample.effect_size(
    pairing.band_baseline(V.type_series, "series_id"), "series_id"), f"""
{DIFFS} SELECT series_id, count(*) AS n, avg(difference) AS mean, stddev_samp(difference) AS sd, avg(difference) / stddev_samp(difference) AS effect,
 CASE WHEN count(*) < 20 THEN 'INSUFFICIENT_DATA' WHEN max(abs(difference)) = 0 THEN 'DEGENERATE' ELSE 'OK' END AS status FROM df GROUP BY 1""")
query("n22_paired_temporal_test", "n:l mean:d sd:d effect:d status:s lo:d hi:d exceedances:l p:d missing_baseline:l extinct:l zero_magnitude:l unobservable_predecessor:l usable:l eligible:l",
      lambda V: resample.paired_temporal_test(V.trace, V.trace_base, reps=1000, seed=6), f"""
WITH RECURSIVE {ADJ},{GREEDY},
df AS (SELECT 1 AS one, m.series_id, m.t, a.detrended - c.detrended AS difference FROM mt m JOIN rs a ON a.series_id = m.series_id AND a.t = m.t JOIN rs c ON c.series_id = m.series_id AND c.t = m.control_t),
{tree_boot_sql("df", "one", "series_id, t", "difference", 1000, 6)},
sf AS (SELECT r, sum(difference * CASE WHEN {u("'6'", "r", "one", "series_id", "t")} < 0.5{D} THEN -1 ELSE 1 END) AS s, sum(difference) AS o FROM df, range(1000) q(r) GROUP BY 1),
sp AS (SELECT nullif(count(CASE WHEN abs(s) >= abs(o) - 1e-9 THEN 1 END), CASE WHEN count(*) = 0 THEN 0 ELSE -1 END) AS exceedances, (count(CASE WHEN abs(s) >= abs(o) - 1e-9 THEN 1 END) + 1) / 1001.0{D} AS p0, count(*) AS reps FROM sf),
ef AS (SELECT count(*) AS n, avg(difference) AS mean, stddev_samp(difference) AS sd, avg(difference) / nullif(stddev_samp(difference), 0) AS effect,
  CASE WHEN count(*) < 20 THEN 'INSUFFICIENT_DATA' WHEN max(abs(difference)) = 0 THEN 'DEGENERATE' ELSE 'OK' END AS status FROM df),
ex AS (SELECT count(CASE WHEN reason = 'missing_baseline' THEN 1 END) AS missing_baseline, count(CASE WHEN reason = 'extinct' THEN 1 END) AS extinct, count(CASE WHEN reason = 'zero_magnitude' THEN 1 END) AS zero_magnitude FROM aj),
us AS (SELECT count(*) - count(pf) AS unobservable_predecessor, count(pf) AS usable, count(CASE WHEN pf = 1 THEN 1 END) AS eligible FROM ok)
SELECT ef.*, (SELECT quantile_cont(m, 0.025) FROM bm) AS lo, (SELECT quantile_cont(m, 0.975) FROM bm) AS hi, exceedances, CASE WHEN reps > 0 THEN p0 END AS p, ex.*, us.* FROM ef, sp, ex, us""")
