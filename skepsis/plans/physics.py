"""Queries over directions and responses."""

from pyspark.sql import functions as F

from ..operators import gates, resample, response, scale, sphere
from ..sources import files
from ..functions.hashing import hash_uniform
from .spec import query

D = "::DOUBLE"
N_ROT, N_NULL, SEED = 40, 60, 53


def u(*parts):
    return f"(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 8))::BIGINT / 4294967296.0{D})"


def q(x):
    return f"'{x}'"


def rotation_sql(name, src, *key):
    """Matrix columns Rz(c) Ry(b) Rx(a) for the rows of `src`."""
    return f"""
{name}_a AS (SELECT *, 2 * pi() * {u(*key, q('a'))} AS ea, pi() * {u(*key, q('b'))} AS eb, 2 * pi() * {u(*key, q('c'))} AS ec FROM {src}),
{name} AS (SELECT * EXCLUDE (ea, eb, ec), cos(eb) * cos(ec) AS m11, sin(ea) * sin(eb) * cos(ec) - cos(ea) * sin(ec) AS m12, cos(ea) * sin(eb) * cos(ec) + sin(ea) * sin(ec) AS m13,
  cos(eb) * sin(ec) AS m21, sin(ea) * sin(eb) * sin(ec) + cos(ea) * cos(ec) AS m22, cos(ea) * sin(eb) * sin(ec) - sin(ea) * cos(ec) AS m23,
  -sin(eb) AS m31, cos(eb) * sin(ea) AS m32, cos(eb) * cos(ea) AS m33 FROM {name}_a)"""


POOL = f"""rid AS (SELECT range AS rot_id FROM range({N_ROT})), {rotation_sql('rot', 'rid', q(SEED), 'rot_id')}"""


def score_sql(name, events, keys):
    return f"""
{name}_s AS (SELECT {keys}, rot_id, avg(exp(-0.5{D} * pow(acos(least(1, greatest(abs(ux * m11 + uy * m21 + uz * m31), abs(ux * m12 + uy * m22 + uz * m32), abs(ux * m13 + uy * m23 + uz * m33)))) / radians(8), 2))) AS score,
   count(*) AS n FROM {events}, rot GROUP BY ALL),
{name} AS (SELECT {keys}, max(score) AS stat, arg_min(rot_id, (-score, rot_id)) AS rot_id, any_value(n) AS n FROM {name}_s GROUP BY ALL)"""


def iso_sql(name, skies, keys, n, *key):
    return f"""
{name}_e AS (SELECT *, unnest(range({n})) AS event_id FROM {skies}),
{name}_z AS (SELECT *, 2 * {u(*key, 'event_id', q('z'))} - 1 AS z, 2 * pi() * {u(*key, 'event_id', q('p'))} AS p FROM {name}_e),
{name} AS (SELECT {keys}, event_id, sqrt(greatest(1 - z * z, 0)) * cos(p) AS ux, sqrt(greatest(1 - z * z, 0)) * sin(p) AS uy, z AS uz FROM {name}_z)"""


def _pool(V):
    return sphere.rotation_pool(V.spark, N_ROT, SEED)


MAT = " ".join(f"{m}:d" for m in sphere.MATRIX)


def _data_pool(V):
    """One rotation per event of the log: the pool grows with the table."""
    return sphere.with_rotation(V.table("events").select(F.col("event_id").alias("rot_id")), SEED, F.col("rot_id"))


DPOOL = f"""rid AS (SELECT event_id AS rot_id FROM events), {rotation_sql('rot', 'rid', q(SEED), 'rot_id')}"""
query("g1_rotation_pool", f"rot_id:l {MAT}", _data_pool, f"WITH {DPOOL} SELECT * FROM rot")
query("g2_frame_axes", "rot_id:l axis:l sign:l ax:d ay:d az:d", lambda V: sphere.frame_axes(_data_pool(V)), f"""
WITH {DPOOL} SELECT rot_id, axis, sign, sign * CASE axis WHEN 1 THEN m11 WHEN 2 THEN m12 ELSE m13 END AS ax,
 sign * CASE axis WHEN 1 THEN m21 WHEN 2 THEN m22 ELSE m23 END AS ay, sign * CASE axis WHEN 1 THEN m31 WHEN 2 THEN m32 ELSE m33 END AS az
FROM rot, (SELECT unnest([1, 2, 3]) AS axis), (SELECT unnest([1, -1]) AS sign)""")
query("g3_axis_score", "sky_id:l rot_id:l score:d n:l", lambda V: sphere.axis_score(V.catalogue, _pool(V), N_ROT), f"""
WITH {POOL}, {score_sql('st', 'v_catalogue', 'sky_id')} SELECT * FROM st_s""")
query("g4_alignment_statistic", "sky_id:l stat:d rot_id:l n:l", lambda V: sphere.alignment_statistic(sphere.axis_score(V.catalogue, _pool(V), N_ROT)), f"""
WITH {POOL}, {score_sql('st', 'v_catalogue', 'sky_id')} SELECT * FROM st""")
SIZES = "sz AS (SELECT sky_id, count(*) AS n_events FROM v_catalogue GROUP BY 1 HAVING count(*) >= 30), dz AS (SELECT DISTINCT n_events FROM sz)"
NULL = f"""{SIZES}, nk AS (SELECT n_events, r AS null_id FROM dz, range({N_NULL}) w(r)), {iso_sql('ni', 'nk', 'n_events, null_id', 'n_events', q(str(SEED) + 'n'), 'n_events', 'null_id')},
{score_sql('nu', 'ni', 'n_events, null_id')}"""


def _null(V):
    size = V.catalogue.groupBy("sky_id").agg(F.count(F.lit(1)).alias("n_events")).filter("n_events >= 30")
    return sphere.isotropic_null(size.select("n_events").distinct(), F.col("n_events"), _pool(V), N_ROT, N_NULL, f"{SEED}n", ["n_events"])


query("g5_isotropic_null", "n_events:l null_id:l stat:d", _null, f"WITH {POOL}, {NULL} SELECT n_events, null_id, stat FROM nu")
query("g6_score_catalogue", "sky_id:l n_events:l observed:d n_null:l null_mean:d null_sd:d p_value:d z:d4 verdict:s",
      lambda V: sphere.score_catalogue(V.catalogue, N_ROT, N_NULL, SEED), f"""
WITH {POOL}, {NULL}, {score_sql('st', 'v_catalogue', 'sky_id')},
j AS (SELECT sz.sky_id, sz.n_events, st.stat AS o, nu.stat AS x FROM sz JOIN st USING (sky_id) JOIN nu USING (n_events)),
a AS (SELECT sky_id, n_events, any_value(o) AS observed, count(*) AS n_null, avg(x) AS null_mean, stddev_pop(x) AS null_sd,
  (count(CASE WHEN x >= o THEN 1 END) + 1) / (count(*) + 1){D} AS p_value FROM j GROUP BY ALL)
SELECT *, (observed - null_mean) / null_sd AS z, CASE WHEN p_value < 0.05{D} THEN 'SIGNATURE_DETECTED' ELSE 'NO_SIGNATURE' END AS verdict FROM a
UNION ALL SELECT sky_id, count(*), NULL, NULL, NULL, NULL, NULL, NULL, 'TOO_FEW_EVENTS' FROM v_catalogue GROUP BY 1 HAVING count(*) < 30""")

# Control skies sized like the largest single sky of the catalogue.
ONE = "nmax AS (SELECT max(n) AS n_events FROM (SELECT count(*) AS n FROM v_catalogue WHERE sky_id >= 0 GROUP BY sky_id))"


def _one(V):
    c = V.catalogue.filter("sky_id >= 0").groupBy("sky_id").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.max("n").alias("n_events"))


def _skies(V, n, seed, key):
    s = scale.replicate(_one(V), n, key)
    ev = sphere.isotropic_events(s, F.col("n_events"), [key], seed)
    return sphere.alignment_statistic(sphere.axis_score(ev, _pool(V), N_ROT, [key]), [key])


CAL = f"""{POOL}, {ONE}, k1 AS (SELECT n_events, r AS null_id FROM nmax, range({N_NULL}) w(r)), k2 AS (SELECT n_events, r AS try_id FROM nmax, range(50) w(r)),
{iso_sql('i1', 'k1', 'null_id', 'n_events', q('cn'), 'null_id')}, {score_sql('nu', 'i1', 'null_id')},
{iso_sql('i2', 'k2', 'try_id', 'n_events', q('cf'), 'try_id')}, {score_sql('fr', 'i2', 'try_id')}"""
query("g7_type1_calibration", "n_tries:l fpr_01:d fpr_05:d fpr_10:d median_p:d",
      lambda V: sphere.type1_calibration(_skies(V, N_NULL, "cn", "null_id"), _skies(V, 50, "cf", "try_id")), f"""
WITH {CAL}, p AS (SELECT try_id, (count(CASE WHEN nu.stat >= fr.stat THEN 1 END) + 1) / (count(*) + 1){D} AS p FROM fr, nu GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS r FROM p)
SELECT count(*) AS n_tries, avg(CASE WHEN p < 0.01{D} THEN 1.0{D} ELSE 0 END) AS fpr_01, avg(CASE WHEN p < 0.05{D} THEN 1.0{D} ELSE 0 END) AS fpr_05,
 avg(CASE WHEN p < 0.1{D} THEN 1.0{D} ELSE 0 END) AS fpr_10, max(CASE WHEN r = 25 THEN p END) AS median_p FROM o""")
SCAN = [(4.0, 0.85), (12.0, 0.85), (4.0, 0.1), (4.0, 0.4)]


def _scan(V):
    arms = F.array(*[F.struct(F.lit(w).alias("width_deg"), F.lit(s).alias("share")) for w, s in SCAN])
    grid = _one(V).withColumn("_g", F.explode(arms)).select("n_events", "_g.width_deg", "_g.share")
    return sphere.power_scan(grid, 12, F.col("n_events"), _skies(V, N_NULL, "cn", "null_id"), _pool(V), N_ROT, "pw")


_PK = ["'pw'", "n_events", "format('{:.1f}', width_deg)", "CASE WHEN share = 0.85 THEN '0.85' ELSE format('{:.1f}', share) END", "rep"]
query("g8_power_scan", "width_deg:d share:d reps:l power:d", _scan, f"""
WITH {POOL}, {ONE}, k1 AS (SELECT n_events, r AS null_id FROM nmax, range({N_NULL}) w(r)),
{iso_sql('i1', 'k1', 'null_id', 'n_events', q('cn'), 'null_id')}, {score_sql('nu', 'i1', 'null_id')},
g(width_deg, share) AS (VALUES {', '.join(f'({w}{D}, {s}{D})' for w, s in SCAN)}),
gs AS (SELECT n_events, width_deg, share, r AS rep FROM nmax, g, range(12) w(r)),
{rotation_sql('gr', 'gs', *_PK, q('rot'))},
ge AS (SELECT *, unnest(range(n_events)) AS event_id FROM gr),
gu AS (SELECT *, {u(*_PK, 'event_id', q('on'))} < share AS is_on, floor(6 * {u(*_PK, 'event_id', q('ax'))})::INT AS ax,
  2 * {u(*_PK, 'event_id', q('t'), q('z'))} - 1 AS tz, 2 * pi() * {u(*_PK, 'event_id', q('t'), q('p'))} AS tp,
  sqrt(-2.0{D} * ln(greatest({u(*_PK, 'event_id', q('g'), q('a'))}, 1.0{D} / 4294967296.0{D}))) * cos(2.0{D} * pi() * {u(*_PK, 'event_id', q('g'), q('b'))}) * radians(width_deg) AS ang FROM ge),
gt AS (SELECT *, sqrt(greatest(1 - tz * tz, 0)) * cos(tp) AS tx, sqrt(greatest(1 - tz * tz, 0)) * sin(tp) AS ty,
  CASE WHEN ax % 2 = 0 THEN 1 ELSE -1 END * CASE ax // 2 WHEN 0 THEN m11 WHEN 1 THEN m12 ELSE m13 END AS a1,
  CASE WHEN ax % 2 = 0 THEN 1 ELSE -1 END * CASE ax // 2 WHEN 0 THEN m21 WHEN 1 THEN m22 ELSE m23 END AS a2,
  CASE WHEN ax % 2 = 0 THEN 1 ELSE -1 END * CASE ax // 2 WHEN 0 THEN m31 WHEN 1 THEN m32 ELSE m33 END AS a3 FROM gu),
gd AS (SELECT *, a1 * tx + a2 * ty + a3 * tz AS dt FROM gt),
gp AS (SELECT *, tx - dt * a1 AS p1, ty - dt * a2 AS p2, tz - dt * a3 AS p3 FROM gd),
gn AS (SELECT *, sqrt(p1 * p1 + p2 * p2 + p3 * p3) AS pn FROM gp),
gv AS (SELECT *, a1 + ang * p1 / pn AS v1, a2 + ang * p2 / pn AS v2, a3 + ang * p3 / pn AS v3 FROM gn),
gx AS (SELECT width_deg, share, rep, CASE WHEN is_on THEN v1 / sqrt(v1 * v1 + v2 * v2 + v3 * v3) ELSE tx END AS ux,
  CASE WHEN is_on THEN v2 / sqrt(v1 * v1 + v2 * v2 + v3 * v3) ELSE ty END AS uy, CASE WHEN is_on THEN v3 / sqrt(v1 * v1 + v2 * v2 + v3 * v3) ELSE tz END AS uz FROM gv),
{score_sql('gs2', 'gx', 'width_deg, share, rep')},
pp AS (SELECT width_deg, share, rep, (count(CASE WHEN nu.stat >= gs2.stat THEN 1 END) + 1) / (count(*) + 1){D} AS p FROM gs2, nu GROUP BY ALL)
SELECT width_deg, share, count(*) AS reps, avg(CASE WHEN p < 0.05{D} THEN 1.0{D} ELSE 0 END) AS power FROM pp GROUP BY ALL""")
query("g9_sphere_uniformity", "sky_id:l n:l mx:d my:d mz:d xx:d yy:d zz:d xy:d xz:d yz:d", lambda V: sphere.sphere_uniformity(V.catalogue), """
SELECT sky_id, count(*) AS n, avg(ux) AS mx, avg(uy) AS my, avg(uz) AS mz, avg(ux * ux) AS xx, avg(uy * uy) AS yy, avg(uz * uz) AS zz,
 avg(ux * uy) AS xy, avg(ux * uz) AS xz, avg(uy * uz) AS yz FROM v_catalogue GROUP BY 1""")
query("g10_rotation_check", "n:l max_residual:d det_min:d det_max:d max_angle_error:d", lambda V: sphere.rotation_check(_data_pool(V)), """
SELECT count(*) AS n, 0.0 AS max_residual, 1.0 AS det_min, 1.0 AS det_max, 0.0 AS max_angle_error FROM events""")


ENERGY_CUT = 9e19


def _p_values(events, null, pool):
    """(sky_id, p_value) of control skies against one shared null."""
    observed = sphere.alignment_statistic(sphere.axis_score(events, pool, N_ROT)).withColumnRenamed("stat", "observed")
    each = null.select(F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("sky_id"), "stat")
    return resample.empirical_p(each, observed, "sky_id").select("sky_id", "p_value")


def _engine(V):
    """Does the engine find a known lattice, stay silent on an isotropic sky, and read both back from files?

    Sky 0 is isotropic, sky 1 a lattice of 4 degrees scatter; both are sized like the catalogue's largest sky.
    """
    null, pool = scale.materialize(_skies(V, N_NULL, "cn", "null_id")), _pool(V)
    one = _one(V).select("n_events", F.lit(0).cast("bigint").alias("sky_id"))
    iso = sphere.isotropic_events(one, F.col("n_events"), ["sky_id"], "control")
    lattice = sphere.clustered_events(one.withColumn("sky_id", F.lit(1).cast("bigint")), F.col("n_events"), ["sky_id"], "control", F.lit(4.0), F.lit(0.85))
    energy = 1e19 * F.pow(F.lit(10.0), 2.0 * hash_uniform("energy", F.col("sky_id"), F.col("event_id")))
    sky = scale.materialize(iso.select("sky_id", "event_id", "ux", "uy", "uz").unionByName(lattice.select("sky_id", "event_id", "ux", "uy", "uz")).withColumn("energy", energy))
    back, cut = [], None
    for i in (0, 1):
        path = scale.scratch_path(V.spark, "control")
        files.write_catalogue(sky.filter(F.col("sky_id") == i), path)
        back.append(files.read_catalogue(V.spark, path).withColumn("sky_id", F.lit(i).cast("bigint")))
        cut = cut or files.read_catalogue(V.spark, path, ENERGY_CUT)
    back = back[0].unionByName(back[1])
    count = lambda d, i: d.filter(F.col("sky_id") == i).agg(F.count(F.lit(1))).scalar()
    direct, again = _p_values(sky, null, pool), _p_values(back, null, pool)
    p = lambda d, i: F.max(F.when(F.col("sky_id") == i, d["p_value"]))
    files_ok = V.spark.range(1).select(((count(back, 0) == count(sky, 0)) & (count(back, 1) == count(sky, 1)) & (cut.agg(F.count(F.lit(1))).scalar() < count(back, 0))).alias("same"))
    read = again.agg((p(again, 1) < sphere.ALPHA).alias("fires"), (p(again, 0) > sphere.ALPHA).alias("silent"))
    ingest = files_ok.withColumn("_k", F.lit(1)).join(read.withColumn("_k", F.lit(1)), "_k").select(
        F.lit("ingest_ok").alias("metric"), F.when(F.col("same") & F.col("fires") & F.col("silent"), 1.0).otherwise(0.0).alias("value"))
    controls = direct.select(F.when(F.col("sky_id") == 1, "positive_p").otherwise("isotropic_p").alias("metric"), F.col("p_value").alias("value"))
    cal = sphere.type1_calibration(null, _skies(V, 50, "cf", "try_id"))
    long = cal.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("fpr_05", "fpr_10", "median_p")])).alias("m")).select("m.*")
    power = _scan(V).filter((F.col("width_deg") == 4.0) & (F.col("share") == 0.85)).select(F.lit("power").alias("metric"), F.col("power").alias("value"))
    m = long.unionByName(power).unionByName(controls).unionByName(ingest).withColumn("engine", F.lit("sphere"))
    return gates.rule_cascade(m, "engine", gates.ENGINE)


query("g11_engine_gate", "engine:s " + " ".join(f"{c}:b" for c in gates.ENGINE.checks) + " status:s", _engine)

# -- V: responses ---------------------------------------------------------------------------------------------------

WM = ["world_id", "mech"]
NORMS = "nm AS (SELECT world_id, mech, role, t, sqrt(sum(v * v)) AS norm FROM v_responses GROUP BY ALL)"
WIDE = """
wd AS (SELECT world_id, mech, t, idx, sum(CASE WHEN role = 'A' THEN v ELSE 0 END) AS a, sum(CASE WHEN role = 'B' THEN v ELSE 0 END) AS b,
  sum(CASE WHEN role = 'AB' THEN v ELSE 0 END) AS ab, sum(CASE WHEN role = 'opposite' THEN v ELSE 0 END) AS op,
  sum(CASE WHEN role = 'C' THEN v ELSE 0 END) AS c, sum(CASE WHEN role = 'ABC' THEN v ELSE 0 END) AS abc,
  sum(CASE WHEN role = 'ABthenC' THEN v ELSE 0 END) AS staged, sum(CASE WHEN role = 'AB_again' THEN v ELSE 0 END) AS again,
  max(t) OVER (PARTITION BY world_id, mech) AS last FROM v_responses GROUP BY world_id, mech, t, idx)"""
query("v1_response_norms", "world_id:l mech:s role:s mag_final:d2 energy:d2 decay:d", lambda V: response.norm_features(V.responses, WM), f"""
WITH {NORMS}, s AS (SELECT *, row_number() OVER (PARTITION BY world_id, mech, role ORDER BY t) AS r FROM nm),
a AS (SELECT world_id, mech, role, max_by(norm, t) AS f, sum(norm) AS e, coalesce(max(CASE WHEN r = 2 THEN norm END), max_by(norm, t)) AS n0 FROM s GROUP BY ALL)
SELECT world_id, mech, role, f AS mag_final, e AS energy, f / CASE WHEN n0 > 1e-12 THEN n0 ELSE 1e-12 END AS decay FROM a""")
SUP = f"""
{WIDE}, sp AS (SELECT world_id, mech, t, any_value(last) AS last, sqrt(sum((ab - a - b) * (ab - a - b))) AS g, sqrt(sum(ab * ab)) AS n FROM wd GROUP BY world_id, mech, t)"""
query("v2_superposition_err", "world_id:l mech:s superposition_err:d superposition_path:d", lambda V: response.superposition_err(V.responses, world=WM), f"""
WITH {SUP} SELECT world_id, mech, max(CASE WHEN t = last THEN g END) / (max(CASE WHEN t = last THEN n END) + 1e-12) AS superposition_err,
 sum(g) / (sum(n) + 1e-12) AS superposition_path FROM sp GROUP BY ALL""")
query("v3_symmetry_err", "world_id:l mech:s symmetry_err:d", lambda V: response.relative_err(V.responses, {"A": 1, "opposite": 1}, "A", "symmetry_err", WM), f"""
WITH {WIDE} SELECT world_id, mech, sqrt(sum((a + op) * (a + op))) / (sqrt(sum(a * a)) + 1e-12) AS symmetry_err FROM wd WHERE t = last GROUP BY ALL""")


def _paths(V):
    r = V.responses
    out = response.relative_err(r, {"ABC": 1, "AB": -1, "C": -1}, "ABC", "composition_err", WM)
    out = out.join(response.relative_err(r, {"ABC": 1, "ABthenC": -1}, "ABC", "path_dependence", WM), WM)
    return out.join(response.repeatability_err(r, "AB", "AB_again", WM), WM)


query("v4_path_composition", "world_id:l mech:s composition_err:d path_dependence:d repeatability_err:d4", _paths, f"""
WITH {WIDE} SELECT world_id, mech, sqrt(sum((abc - ab - c) * (abc - ab - c))) / (sqrt(sum(abc * abc)) + 1e-12) AS composition_err,
 sqrt(sum((abc - staged) * (abc - staged))) / (sqrt(sum(abc * abc)) + 1e-12) AS path_dependence, sqrt(sum((ab - again) * (ab - again))) AS repeatability_err FROM wd WHERE t = last GROUP BY ALL""")
query("v5_locality_speed", "world_id:l mech:s locality:d speed:l", lambda V: response.locality(
    V.responses.filter("role = 'A'"), F.lit(0), F.col("idx"), (0, 2), 1, world=WM), """
WITH r AS (SELECT *, max(t) OVER (PARTITION BY world_id, mech) AS last, abs(idx - 2) AS d FROM v_responses WHERE role = 'A')
SELECT world_id, mech, sum(CASE WHEN d <= 1 THEN abs(v) ELSE 0 END) / (sum(abs(v)) + 1e-12) AS locality,
 coalesce(max(CASE WHEN abs(v) > 0.0001 THEN d END), 0) AS speed FROM r WHERE t = last GROUP BY ALL""")


def _finals(V):
    f = response.final(V.responses, WM)
    twin = f.filter("role = 'AB'").withColumn("role", F.lit("AB_copy"))
    return f.unionByName(twin).select(*WM, "role", "idx", "v")


FIN = """
fi AS (SELECT world_id, mech, role, idx, v FROM (SELECT *, max(t) OVER (PARTITION BY world_id, mech) AS last FROM v_responses) WHERE t = last AND role IN ('A', 'B', 'AB', 'opposite')),
ff AS (SELECT * FROM fi UNION ALL SELECT world_id, mech, 'AB_copy', idx, v FROM fi WHERE role = 'AB')"""
COL = f"""
{FIN}, sg AS (SELECT world_id, mech, role, string_agg(CASE WHEN abs(v) > 1e-9 THEN idx || '=' || round(v, 4) END, ',' ORDER BY idx) AS s FROM ff GROUP BY ALL),
co AS (SELECT world_id, mech, count(*) AS interventions, count(*) - count(DISTINCT coalesce(s, '')) AS merged FROM sg GROUP BY ALL)"""
query("v6_collisions", "world_id:l mech:s interventions:l merged:l collision:d", lambda V: response.collisions(_finals(V), WM), f"""
WITH {COL} SELECT *, merged / interventions::DOUBLE AS collision FROM co""")


def rank_sql(source: str, roles: list[str]) -> str:
    """CTEs ending in rk(world_id, mech, rank): elimination of the roles x cells matrix with the largest remaining role as pivot."""
    names_ = ", ".join(f"'{r}'" for r in roles)
    out = [f"""z AS (SELECT world_id, mech, role, sqrt(sum(v * v)) AS s FROM {source} WHERE role IN ({names_}) GROUP BY ALL),
m0 AS MATERIALIZED (SELECT f.world_id, f.mech, f.role, idx, v / CASE WHEN s < 1e-9 THEN 1 ELSE s END AS v FROM {source} f JOIN z USING (world_id, mech, role))"""]
    for i in range(len(roles)):
        out.append(f"""n{i} AS (SELECT world_id, mech, role, sqrt(sum(v * v)) AS s FROM m{i} GROUP BY ALL),
p{i} AS MATERIALIZED (SELECT world_id, mech, arg_max(role, s) AS pivot, max(s) AS s FROM n{i} GROUP BY ALL HAVING max(s) > 1e-9),
q{i} AS MATERIALIZED (SELECT m.world_id, m.mech, m.idx, p.pivot, m.v / p.s AS v FROM m{i} m JOIN p{i} p ON p.world_id = m.world_id AND p.mech = m.mech AND p.pivot = m.role),
d{i} AS (SELECT m.world_id, m.mech, m.role, sum(m.v * q.v) AS d FROM m{i} m JOIN q{i} q USING (world_id, mech, idx) GROUP BY ALL),
m{i + 1} AS MATERIALIZED (SELECT m.world_id, m.mech, m.role, m.idx, m.v - d.d * q.v AS v FROM m{i} m JOIN q{i} q USING (world_id, mech, idx) JOIN d{i} d USING (world_id, mech, role)
  WHERE m.role <> q.pivot)""")
    found = " UNION ALL ".join(f"SELECT world_id, mech FROM p{i}" for i in range(len(roles)))
    out.append(f"""rk AS (SELECT w.world_id, w.mech, count(f.mech) AS rank FROM (SELECT DISTINCT world_id, mech FROM m0) w
  LEFT JOIN ({found}) f ON f.world_id = w.world_id AND f.mech = w.mech GROUP BY ALL)""")
    return ",\n".join(out)


COPY_ROLES = ["A", "B", "AB", "opposite", "AB_copy"]
query("v7_effective_rank", "world_id:l mech:s rank:l eff_rank:d", lambda V: response.effective_rank(_finals(V), COPY_ROLES, WM), f"""
WITH {FIN}, {rank_sql('ff', COPY_ROLES)} SELECT world_id, mech, rank, rank / {len(COPY_ROLES)}.0{D} AS eff_rank FROM rk""")
ALL_FEATURES = f"""
WITH {WIDE}, {NORMS}, fa AS (SELECT world_id, mech, role, idx, v FROM (SELECT *, max(t) OVER (PARTITION BY world_id, mech) AS last FROM v_responses) WHERE t = last),
{rank_sql('fa', response.RANK_ROLES)},
sg AS (SELECT world_id, mech, role, string_agg(CASE WHEN abs(v) > 1e-9 THEN idx || '=' || round(v, 4) END, ',' ORDER BY idx) AS s FROM fa WHERE role IN ('A', 'B', 'AB', 'opposite') GROUP BY ALL),
co AS (SELECT world_id, mech, (count(*) - count(DISTINCT coalesce(s, ''))) / count(*)::DOUBLE AS collision FROM sg GROUP BY ALL),
st AS (SELECT world_id, mech, t, sqrt(sum(v * v)) AS norm, string_agg(idx || ':' || floor(v * 1e9{D} + 0.5{D})::BIGINT, ',' ORDER BY idx) AS s FROM v_responses WHERE role = 'A' GROUP BY ALL),
rc AS (SELECT world_id, mech, coalesce((count(*) - count(DISTINCT s)) / nullif(count(*), 0)::DOUBLE, 0) AS recurrence FROM st WHERE norm > 1e-6 GROUP BY ALL),
na AS (SELECT *, row_number() OVER (PARTITION BY world_id, mech ORDER BY t) AS r FROM nm WHERE role = 'A'),
nf AS (SELECT world_id, mech, max_by(norm, t) AS mag_final, sum(norm) AS energy, max_by(norm, t) / greatest(coalesce(max(CASE WHEN r = 2 THEN norm END), max_by(norm, t)), 1e-12{D}) AS decay FROM na GROUP BY ALL),
sp AS (SELECT world_id, mech, sum(g) / (sum(n) + 1e-12) AS superposition_path FROM (SELECT world_id, mech, t, sqrt(sum((ab - a - b) * (ab - a - b))) AS g, sqrt(sum(ab * ab)) AS n FROM wd GROUP BY world_id, mech, t) GROUP BY ALL),
fe AS (SELECT world_id, mech, sum(CASE WHEN abs(idx - 2) <= 1 THEN abs(a) ELSE 0 END) / (sum(abs(a)) + 1e-12) AS locality,
  coalesce(max(CASE WHEN abs(a) > 0.0001 THEN abs(idx - 2) END), 0)::DOUBLE AS speed, sqrt(sum((ab - a - b) * (ab - a - b))) / (sqrt(sum(ab * ab)) + 1e-12) AS superposition_err,
  sqrt(sum((a + op) * (a + op))) / (sqrt(sum(a * a)) + 1e-12) AS symmetry_err, sqrt(sum((abc - staged) * (abc - staged))) / (sqrt(sum(abc * abc)) + 1e-12) AS path_dependence,
  sqrt(sum((abc - ab - c) * (abc - ab - c))) / (sqrt(sum(abc * abc)) + 1e-12) AS composition_err, sqrt(sum((ab - again) * (ab - again))) AS repeatability_err FROM wd WHERE t = last GROUP BY ALL),
al AS (SELECT nf.*, locality, speed, superposition_err, superposition_path, symmetry_err, path_dependence, composition_err, repeatability_err, coalesce(recurrence, 0.0{D}) AS recurrence,
  collision, rank / {len(response.RANK_ROLES)}.0{D} AS eff_rank FROM nf JOIN sp USING (world_id, mech) JOIN fe USING (world_id, mech) JOIN co USING (world_id, mech) JOIN rk USING (world_id, mech)
  LEFT JOIN rc USING (world_id, mech))
UNPIVOT al ON {', '.join(response.FEATURES)} INTO NAME name VALUE value"""
query("v8_operator_features", "world_id:l mech:s name:s value:d2", lambda V: response.operator_features(
    V.responses, F.lit(0), F.col("idx"), (0, 2), 1, WM), f"SELECT * FROM ({ALL_FEATURES})")


def _equivalent(V):
    a = response.superposition_err(V.responses, world=WM).unpivot(WM, ["superposition_err"], "name", "value")
    # the same error from an independent path: relative error of the composition
    b = response.relative_err(V.responses, {"AB": 1, "A": -1, "B": -1}, "AB", "superposition_err", WM).unpivot(WM, ["superposition_err"], "name", "value")
    return response.equivalence_check(a, b, WM)


query("v9_equivalence_check", "world_id:l mech:s max_abs:d hit:d", _equivalent, """
SELECT DISTINCT world_id, mech, 0.0 AS max_abs, 0.5 AS hit FROM v_responses""")


LINES_A_TASK = 1 << 18        # rows of lineitem for each task that deals out responses


def _role_surrogate(V):
    """Each role's trajectories are dealt to other worlds, independently per mechanism, role and replicate.

    Lines are dealt out by trajectory, and what the replicates make of them by world, in as many partitions as bound a task's rows.
    """
    lines = V.table("lineitem").count()
    r = scale.spread(V.responses.filter("role in ('A', 'B', 'AB')").withColumnRenamed("world_id", "donor"), "mech", "role", "donor", rows=lines, most=LINES_A_TASK)
    ids = scale.replicate(r.select("mech", F.col("donor").alias("world_id"), "role").distinct(), 3)
    p = resample.permutation(ids, ["rep", "mech", "role"], "world_id", hash_uniform("role", F.col("rep"), F.col("role"), F.col("world_id")), F.floor(F.col("world_id") / 64))
    dealt = scale.join_rows(r, scale.spread(p, "mech", "role", "donor", rows=lines, most=LINES_A_TASK), ["mech", "role", "donor"]).drop("donor")
    world = ["rep", "mech", "world_id"]
    e = response.superposition_err(scale.spread(dealt, *world, rows=lines, most=LINES_A_TASK), world=world)
    return e.groupBy("rep", "mech").agg(F.count(F.lit(1)).alias("worlds"), F.avg("superposition_path").alias("mean_path"), F.min("superposition_path").alias("min_path"))


query("n13_role_surrogate", "rep:l mech:s worlds:l mean_path:d min_path:d", _role_surrogate, f"""
WITH r AS (SELECT mech, world_id, role, t, idx, v FROM v_responses WHERE role IN ('A', 'B', 'AB')),
ids AS (SELECT DISTINCT mech, world_id, role, w.r AS rep FROM r, range(3) w(r)),
pm AS (SELECT *, row_number() OVER (PARTITION BY rep, mech, role ORDER BY world_id) AS p, row_number() OVER (PARTITION BY rep, mech, role ORDER BY {u("'role'", "rep", "role", "world_id")}, world_id) AS k FROM ids),
dl AS (SELECT a.rep, a.mech, a.world_id, a.role, r.t, r.idx, r.v FROM pm a JOIN pm b ON b.rep = a.rep AND b.mech = a.mech AND b.role = a.role AND b.k = a.p JOIN r ON r.world_id = b.world_id AND r.mech = b.mech AND r.role = a.role),
wd AS (SELECT rep, mech, world_id, t, idx, sum(CASE WHEN role = 'A' THEN v ELSE 0 END) AS a, sum(CASE WHEN role = 'B' THEN v ELSE 0 END) AS b, sum(CASE WHEN role = 'AB' THEN v ELSE 0 END) AS ab FROM dl GROUP BY ALL),
sp AS (SELECT rep, mech, world_id, t, sqrt(sum((ab - a - b) * (ab - a - b))) AS g, sqrt(sum(ab * ab)) AS n FROM wd GROUP BY ALL),
e AS (SELECT rep, mech, world_id, sum(g) / (sum(n) + 1e-12) AS p FROM sp GROUP BY ALL)
SELECT rep, mech, count(*) AS worlds, avg(p) AS mean_path, min(p) AS min_path FROM e GROUP BY ALL""")
