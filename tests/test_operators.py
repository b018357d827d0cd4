"""Closed forms, calibration and regression tests for known defects of such toolkits."""
import math
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skepsis.functions import numeric
from skepsis.operators import (audit, degrade, evidence, fields, gates, leakage, marginal, models, pairing, resample, response, sequence as seq,
                               spectral, sphere, surrogates)
from skepsis.sources import files


def grids(spark, **named):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in named.items()], "sample_id string, vals array<double>")


def by_id(df, key="sample_id"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def shapes(spark):
    xy = [(y, x) for y in range(8) for x in range(8)]
    blobs = [1.0 if (y < 2 and x < 2) or (y > 5 and x > 5) else 0.0 for y, x in xy]
    snake = [1.0 if y % 2 == 0 or x == (7 if y % 4 == 1 else 0) else 0.0 for y, x in xy]
    return grids(spark, flat=[0.5] * 64, ramp=[x / 7 for _, x in xy], check=[(-1) ** (x + y) for y, x in xy], blobs=blobs, snake=snake)


def test_field_closed_forms(shapes):
    g = by_id(fields.gradient_stats(shapes, "sample_id", 8, 8))
    assert g["flat"]["grad_mean"] == 0 and g["flat"]["grad_std"] == 0
    a = by_id(fields.anisotropy(shapes, "sample_id", 8, 8))
    assert a["ramp"]["contrast"] == pytest.approx(1) and a["flat"]["contrast"] == 0 and a["flat"]["horizontal"] == 0.5
    lap = by_id(fields.laplacian_stats(shapes, "sample_id", 8, 8))
    assert lap["ramp"]["lap_mean"] == pytest.approx(0, abs=1e-12)
    acf = {(r.sample_id, r.lag): r.acf for r in fields.row_acf(shapes, "sample_id", 8, 8).collect()}
    assert acf["check", 1] == pytest.approx(-1) and acf["flat", 1] == 0
    assert by_id(fields.neighbour_similarity(shapes, "sample_id", 8, 8))["check"]["similarity"] == 0
    assert by_id(spectral.dct_bands(shapes, "sample_id", 8, 8))["check"]["dct_high"] > 0.9
    e = by_id(marginal.hist_entropy(fields.explode_arrays(shapes, 8, 8), "sample_id"))
    assert e["flat"]["entropy"] == 0


def test_components(shapes):
    c = by_id(fields.components(shapes, "sample_id", 8, 8, 0.6))
    assert (c["blobs"]["n_components"], c["blobs"]["mean_size"], c["blobs"]["max_size"]) == (2, 4.0, 4)
    assert c["flat"]["n_components"] == 0 and c["flat"]["max_size"] == 0
    assert c["snake"]["n_components"] == 1 and c["snake"]["max_size"] == 36  # one long winding path


def test_scores_of_equal_fields(shapes):
    p = shapes.filter("sample_id = 'ramp'").select(F.lit(1).alias("pair_id"), F.col("vals").alias("f"), F.col("vals").alias("t"))
    r = fields.score_fields(p, 8, 8).first().asDict()
    assert all(r[n] == pytest.approx(1) for n in [*fields.WEIGHTS, "score"])
    flat = shapes.filter("sample_id = 'flat'").select(F.lit(1).alias("pair_id"), F.col("vals").alias("f"), F.col("vals").alias("t"))
    assert fields.score_fields(flat, 8, 8).first().pearson01 == 0.5


def test_shape_check(spark):
    with pytest.raises(Exception, match="64 finite"):
        fields.explode_arrays(grids(spark, bad=[1.0] * 63), 8, 8).collect()


def test_half_precision_matches_ieee(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=300), rng.normal(size=100) * 1e-6, rng.normal(size=100) * 1e4, [0.0, 1.0, 0.5, 2.0 ** -14, 2.0 ** -24, 65504.0, 1e9, -1e9]])
    d = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = [r.h for r in d.select(degrade.to_float16("v").alias("h")).collect()]
    assert got == [float(v) for v in np.clip(x, -65504, 65504).astype(np.float16)]


def test_truncate_mantissa(spark):
    d = spark.createDataFrame([(v,) for v in (0.0, 1.0, -1.0, 0.3, 3.14159, -2.7, 0.001)], "v double")

    def want(x, k=5):
        if x == 0:
            return 0.0
        m, e = math.frexp(x)
        return math.ldexp(math.ldexp(math.floor(math.ldexp(m, k)), -k), e)
    r = d.select("v", degrade.truncate_mantissa("v", 5).alias("q")).collect()
    assert [x.q for x in r] == [want(x.v) for x in r]


def test_runs_and_sequences(spark):
    s = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate([1, 1, 2, 2, 2, 3])] + [("b", i + 1, float(i % 2)) for i in range(20)], "series_id string, t bigint, v double")
    runs = sorted((r.start, r.length) for r in seq.islands(s.filter("series_id = 'a'"), "series_id", "t", "v", 4).collect())
    assert runs == [(1, 2), (3, 3), (6, 1)]
    assert by_id(seq.cycle_period(s), "series_id")["b"]["period"] == 2
    assert {(r.series_id, r.lag): r.acf for r in seq.autocorr(s, (1,)).collect()}["b", 1] == pytest.approx(-0.95)


def test_constant_feature_carries_no_information(spark):
    rows = [(i, "const", 0.0, f"g{i // 10}") for i in range(40)] + [(i, "id", float(i // 10), f"g{i // 10}") for i in range(40)]
    mi = {r.name: r.mi_min for r in leakage.binned_mi(spark.createDataFrame(rows, "sample_id bigint, name string, value double, grp string"), {"grp": "grp"}, 4).collect()}
    assert mi["const"] == 0 and mi["id"] == pytest.approx(1)


def test_pairwise_closed_form_equals_mirrored_model(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(f"g{i % 4}", i, "u", n, rng.gauss(0.3 if n == "a" else -0.1, 1)) for i in range(60) for n in "abc"], "grp string, seed bigint, unit string, name string, d double")
    train, test = F.col("seed") < 40, F.col("seed") >= 40
    hits = {r.seed: r.hit for r in models.pairwise_discriminate(d, train, test).collect()}
    mirrored = pairing.mirror_augment(d.filter(train))
    full = models.predict(models.class_scores(d.filter(test).withColumnRenamed("d", "value"), models.fit(mirrored), (), "seed"), (), "seed")
    assert {r.seed: 1.0 if r.pred == "A" else 0.0 for r in full.collect()} == hits


def test_identical_pairs_are_exactly_chance(spark):
    d = spark.createDataFrame([("g0", i, "u", n, 0.0) for i in range(9) for n in "ab"] + [("g1", 1, "u", n, 1.0) for n in "ab"], "grp string, seed bigint, unit string, name string, d double")
    h = models.pairwise_discriminate(d, F.col("grp") == "g1", F.col("grp") == "g0")
    assert h.agg(F.avg("hit")).first()[0] == 0.5


def test_greedy_match_against_sequential(spark):
    rng = random.Random(5)
    rows = [(1, t, int(rng.random() < 0.25), rng.randrange(2), 0.0) for t in range(1, 400) if rng.random() < 0.8]
    r = spark.createDataFrame(rows, "series_id bigint, t bigint, after_event bigint, bin bigint, detrended double")
    got = {x.t: x.control_t for x in pairing.greedy_match(r, size=37).collect()}
    used, want, at = set(), {}, {t: (e, b) for _, t, e, b, _ in rows}
    for t in sorted(at):
        if at[t][0] == 1:
            c = [k for k in range(t - 10, t + 11) if at.get(k) == (0, at[t][1]) and k not in used]
            if c:
                k = min(c, key=lambda k: (abs(k - t), k))
                used.add(k)
                want[t] = k
    assert got == want


def test_greedy_match_of_one_dense_chain(spark):
    """No gap lets a chain end, and choices reach over every border: chunks are matched again until they agree with one pass."""
    rng = random.Random(9)
    rows = [(s, t, int(rng.random() < 0.6), 0, 0.0) for s in (1, 2) for t in range(1, 900)]
    r = spark.createDataFrame(rows, "series_id bigint, t bigint, after_event bigint, bin bigint, detrended double")
    want = {}
    for s in (1, 2):
        flag, used = {t: e for k, t, e, _, _ in rows if k == s}, set()
        for t in sorted(flag):
            c = [k for k in range(t - 10, t + 11) if flag[t] == 1 and flag.get(k) == 0 and k not in used]
            if c:
                want[s, t] = min(c, key=lambda k: (abs(k - t), k))
                used.add(want[s, t])
    for size in (20, 64, 1 << 16):
        assert {(x.series_id, x.t): x.control_t for x in pairing.greedy_match(r, size=size).collect()} == want
    assert pairing.greedy_match(r.filter("after_event = 1")).count() == 0 and pairing.greedy_match(r.filter("false")).count() == 0
    sizes = [len(x.ts) + len(x.cs) for x in pairing.match_chunks(r, size=64).collect()]
    assert max(sizes) <= 84


def test_tree_draws_are_a_multinomial(spark):
    """Every replicate draws exactly n rows; leaves share them as chance would."""
    for n, leaves in ((1, 1), (5000, 5), (70_000, 69)):
        d = spark.range(leaves).withColumnRenamed("id", "leaf").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(199))))
        m = d.select("rep", "leaf", resample.leaf_draws(F.col("rep"), F.col("leaf"), F.lit(leaves), F.lit(n), 3, F.lit("g")).alias("m")).toPandas()
        assert (m.groupby("rep").m.sum() == n).all() and (m.m >= 0).all()
        if leaves > 1:
            size = np.array([-(-(k + 1) * n // leaves) - -(-k * n // leaves) for k in range(leaves)])
            got = m.pivot(index="rep", columns="leaf", values="m").to_numpy()
            z = (got - size) / np.sqrt(size * (1 - size / n))
            assert abs(z.mean()) < 0.05 and 0.85 < z.std() < 1.15


def test_bootstrap_mean_interval(spark):
    v = np.random.default_rng(4).normal(1.0, 2.0, 3000)
    d = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)] + [(2, 0, 5.0)], "k bigint, t bigint, difference double")
    got = {r.k: (r.lo, r.hi) for r in resample.bootstrap_mean_ci(d, "k", "t", F.floor(F.col("t") / 512), reps=300, seed=1).collect()}
    se = v.std() / np.sqrt(len(v))
    assert got[2] == (5.0, 5.0) and got[1][0] == pytest.approx(v.mean() - 1.96 * se, abs=0.5 * se) and got[1][1] == pytest.approx(v.mean() + 1.96 * se, abs=0.5 * se)


def test_phase_surrogate_keeps_spectrum(spark):
    v = np.random.default_rng(2).normal(2.0, 1.0, 64)
    s = spark.createDataFrame([("a", i + 1, float(x)) for i, x in enumerate(v)], "k string, t bigint, v double")
    sp = np.zeros(64, complex)
    for r in surrogates.spectrum(s, "k").collect():
        sp[r.i] = complex(r.re, r.im)
    assert np.allclose(sp, np.fft.fft(v))
    out = np.array([r.v for r in surrogates.phase_surrogate(s, "k", 1).orderBy("t").collect()])
    assert np.allclose(np.abs(np.fft.fft(out)), np.abs(np.fft.fft(v))) and not np.allclose(out, v) and out.mean() == pytest.approx(v.mean())


def test_gap_matched_keeps_gaps(spark):
    s = spark.createDataFrame([("a", t, 1.0 if t in (3, 5, 9) else 0.0) for t in range(1, 11)], "series_id string, t bigint, v double")
    e = seq.event_positions_gaps(s)
    assert sorted(r.gap for r in e.collect()) == [2, 4, 4]
    n = s.groupBy("series_id").agg(F.max("t").alias("n"))
    t = sorted(r.t for r in resample.gap_matched(e, n, "series_id", 1).collect())
    gaps = sorted([b - a for a, b in zip(t, t[1:])] + [10 - t[-1] + t[0]])
    assert gaps == [2, 4, 4] and 3 in t


def test_missing_ids(spark):
    d = spark.createDataFrame([(i,) for i in (1, 2, 5, 6, 9)], "id bigint")
    for bucket in (2, 1000):
        r = sorted((x.first_missing, x.last_missing) for x in audit.missing_id_ranges(d, "id", 1, 10, bucket=bucket).collect())
        assert r == [(3, 4), (7, 8), (10, 10)]


def test_null_p_values(spark):
    null = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, stat double")
    obs = spark.createDataFrame([("a", 100.0), ("b", 1.0)], "k string, observed double")
    assert resample.empirical_p(null, obs, "k").first().p_value == pytest.approx(1 / 11)
    st = by_id(resample.null_statistics(null, obs, "k"), "k")
    assert st["b"]["status"] == "UNRESOLVED" and st["b"]["percentile"] is None and st["a"]["percentile"] == 100


def test_axis_score_of_events_on_axes(spark):
    ev = spark.createDataFrame([(0, *[float(s if j == i else 0) for j in range(3)]) for i in range(3) for s in (1, -1)], "sky_id bigint, ux double, uy double, uz double")
    eye = spark.createDataFrame([(0, *[float(i == j) for i in range(3) for j in range(3)])], "rot_id bigint, " + ", ".join(f"{m} double" for m in sphere.MATRIX))
    assert sphere.axis_score(ev, eye, 1).first().score == pytest.approx(1)


def test_sphere_is_uniform_and_rotations_are_proper(spark):
    u = sphere.sphere_uniformity(sphere.isotropic_events(spark.range(1).withColumnRenamed("id", "sky_id"), 30000, ["sky_id"], 1)).first()
    assert all(abs(u[c]) < 0.02 for c in ("mx", "my", "mz", "xy", "xz", "yz")) and all(abs(u[c] - 1 / 3) < 0.02 for c in ("xx", "yy", "zz"))
    r = sphere.rotation_check(sphere.rotation_pool(spark, 2000, 1)).first()
    assert r.max_residual < 1e-9 and abs(r.det_min - 1) < 1e-9 and r.max_angle_error < 1e-6


def test_catalogue_rules(spark):
    d = tempfile.mkdtemp(prefix="spark-cat-", dir="/tmp")
    p = os.path.join(d, "c.csv")
    with open(p, "w") as f:
        f.write("# comment\n\nRA,Dec,Energy\n10.0,20.0,8e19\n10.0,,7e19\nabc,1,2\n30.0,40.0,\n50,60,1e19\n")
    r = files.read_catalogue(spark, p, 5e19).collect()
    assert len(r) == 2 and sum(x.energy is None for x in r) == 1  # the blank cell never shifts columns
    w = os.path.join(d, "w.txt")
    with open(w, "w") as f:
        f.write("0 90\n0 0 5\n")
    assert sorted(round(x.uz, 6) for x in files.read_catalogue(spark, w).collect()) == [0.0, 1.0]


def test_value_file(spark):
    d = tempfile.mkdtemp(prefix="spark-val-", dir="/tmp")
    with open(os.path.join(d, "v.txt"), "w") as f:
        f.write("1 2 3\n\n4\n5   6\n")
    assert [(r.t, r.v) for r in files.read_value_file(spark, d).orderBy("t").collect()] == [(i, float(i)) for i in range(1, 7)]


def test_unknown_name_is_an_error(spark):
    d = spark.createDataFrame([("v1",), ("nope",)], "alias string")
    with pytest.raises(Exception, match="unknown name"):
        evidence.canonical_name(d, "alias", {"v1": "FULL"}).collect()


def test_additive_responses(spark):
    rows = [(1, r, t, i, v * (t + 1)) for t in range(3) for i in range(4) for r, v in (("A", 1.0 + i), ("B", 2.0), ("AB", 3.0 + i), ("opposite", -1.0 - i))]
    r = spark.createDataFrame(rows, "world_id bigint, role string, t bigint, idx bigint, v double")
    assert response.superposition_err(r).first().superposition_err == pytest.approx(0, abs=1e-12)
    assert response.relative_err(r, {"A": 1, "opposite": 1}, "A", "s").first().s == 0
    assert response.effective_rank(response.final(r), ["A", "B", "AB", "opposite"]).first()["rank"] == 2


def test_all_response_features(spark):
    """World 1 is linear; in world 2 the staged response differs, AB is measured differently and A returns to an earlier state."""
    base = {"A": lambda i: 1.0 + i, "B": lambda i: 2.0, "C": lambda i: float(i * i), "opposite": lambda i: -1.0 - i}
    rows = []
    for world in (1, 2):
        for t in range(4):
            for i in range(5):
                grow = (t + 1) if world == 1 else 1 + t % 2
                v = {r: f(i) * grow for r, f in base.items()}
                v |= {"AB": v["A"] + v["B"], "ABC": v["A"] + v["B"] + v["C"]}
                v |= {"AB_again": v["AB"] + (0.5 if world == 2 else 0.0), "ABthenC": v["ABC"] * (1.0 if world == 1 else 1.1)}
                rows += [(world, r, t, i, x) for r, x in v.items()]
    r = spark.createDataFrame(rows, "world_id bigint, role string, t bigint, idx bigint, v double")
    got = {(x.world_id, x.name): x.value for x in response.operator_features(r, F.lit(0), F.col("idx"), (0, 2), 1).collect()}
    assert {n for w, n in got if w == 1} == set(response.FEATURES) and len(got) == 2 * len(response.FEATURES)
    for n in ("superposition_err", "superposition_path", "symmetry_err", "path_dependence", "composition_err", "repeatability_err", "recurrence"):
        assert got[1, n] == pytest.approx(0, abs=1e-9), n
    assert got[1, "decay"] == pytest.approx(2) and got[1, "locality"] == pytest.approx(9 / 15) and got[1, "speed"] == 2
    assert got[1, "mag_final"] == pytest.approx(4 * math.sqrt(55)) and got[1, "energy"] == pytest.approx(10 * math.sqrt(55))
    assert got[1, "eff_rank"] == pytest.approx(3 / 7) and got[1, "collision"] == 0
    assert got[2, "recurrence"] == 0.5 and got[2, "path_dependence"] == pytest.approx(0.1) and got[2, "repeatability_err"] == pytest.approx(0.5 * math.sqrt(5))
    assert response.operator_features(r.limit(0), F.lit(0), F.col("idx"), (0, 2), 1).count() == 0


def test_rule_cascades_reach_every_status(spark):
    def status(rules, **m):
        rows = [("k", a, float(b)) for a, b in m.items()] or [("k", next(iter(rules.metrics)), float(next(iter(rules.metrics.values()))))]
        return gates.rule_cascade(spark.createDataFrame(rows, "k string, metric string, value double"), "k", rules).first().status
    good = dict(generator_holdout=.9, substrate_holdout=.9, permutation=.5, identical=.5, matched=.9, matched_hash=.9)
    assert status(gates.PASSIVE, **good) == "VALID_COMPUTATIONAL_SIGNATURE"
    assert status(gates.PASSIVE, **{**good, "generator_holdout": .5}) == "GENERATOR_CONFOUNDED"
    assert status(gates.PASSIVE, **{**good, "identical": .6}) == "BENCHMARK_INVALID"
    assert status(gates.PASSIVE, **{**good, "matched": .5}) == "QUANTIZATION_DETECTOR"
    assert status(gates.MATCHED, primary_a=.5, primary_b=.5, hist=.5, spectrum=.5, temporal=.5, unknown_min=.5) == "NO_GENERALIZATION"
    assert status(gates.ARTIFACT, artifact=1.0, artifact_low=.9) == "BRANCH_CLOSED"
    assert status(gates.ACTIVE, primary_acc=.5) == "BRANCH_CLOSED"
    assert status(gates.SWEEP, kernel_ok=0) == "IMPLEMENTATION_ERROR"
    assert status(gates.ENGINE, positive_p=.003, isotropic_p=.4, fpr_05=.05, fpr_10=.1, median_p=.47, power=1, ingest_ok=1) == "ENGINE_VALID"


def test_bootstrap_interval_covers(spark):
    h = spark.createDataFrame([("k", i, float(i % 2)) for i in range(200)], "k string, id bigint, hit double")
    r = resample.bootstrap_ci(h, "k", "id", 300, 1).first()
    assert r.mean == 0.5 and 0.40 < r.lo < 0.5 < r.hi < 0.60


# -- nothing is dropped: no caps, prefixes or lost rows ------------------------------------------------------

def test_missing_ids_reach_the_largest_id(spark):
    ids = spark.createDataFrame([("a", i) for i in (0, 1, 70_000)] + [("b", 30_000)], "run string, id long")
    top = ids.agg(F.max("id"))
    got = {(r["run"], r["first_missing"], r["last_missing"]) for r in audit.missing_id_ranges(ids, "id", 0, top, by="run", bucket=512).collect()}
    assert got == {("a", 2, 69_999), ("b", 0, 29_999), ("b", 30_001, 70_000)}


def test_every_quadrant_has_its_starts(spark):
    from skepsis.operators import sweep
    points = spark.createDataFrame([(100 * q + i, 0.1 * i + 5 * (q % 2), 0.1 * i + 5 * (q // 2)) for q in range(4) for i in range(5)] , "candidate_id long, cr double, ci double")
    got = sweep.stratified_starts(points, (0.0, 9.0, 0.0, 9.0)).groupBy("quadrant").count().collect()
    assert {r["quadrant"]: r["count"] for r in got} == {0: 2, 1: 2, 2: 2, 3: 2}


def test_frame_divergence_uses_all_cells(spark):
    base = [0.0] * 1800
    moved = [1.0 if i == 1 else 0.0 for i in range(1800)]
    frames = spark.createDataFrame([(1, 1, base), (1, 2, moved)], "series_id long, t long, vals array<double>")
    assert seq.frame_divergence(frames, 1800).first()["divergence"] == pytest.approx(1 / 1800)
    assert seq.frame_divergence(frames, 1800, stride=9).first()["divergence"] == 0


def test_small_sky_is_reported(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(45, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    events = spark.createDataFrame([(1 if i < 5 else 2, *map(float, x)) for i, x in enumerate(v)], "sky_id long, ux double, uy double, uz double")
    got = {r["sky_id"]: r for r in sphere.score_catalogue(events, 5, 9, "s").collect()}
    assert (got[1]["verdict"], got[1]["n_events"], got[1]["p_value"]) == ("TOO_FEW_EVENTS", 5, None)
    assert got[2]["n_events"] == 40 and 0 < got[2]["p_value"] <= 1


def test_missing_features_count_as_zero(spark):
    train = spark.createDataFrame([(i, "ab"[i % 2], f, float(i % 2 * 3 + (i // 2) % 2 + k)) for i in range(8) for k, f in enumerate(("f", "g"))],
                                  "sample_id long, label string, name string, value double")
    model = models.fit(train)
    m = {(r["name"], r["label"]): r for r in model.collect()}
    test = spark.createDataFrame([(1, "f", 4.0), (2, "unknown", 1.0)], "sample_id long, name string, value double")
    got = {(r["sample_id"], r["label"]): (r["dist2"], r["score"]) for r in models.class_scores(test, model).collect()}
    for sample, value in ((1, 4.0), (2, None)):
        for label in "ab":
            z = {"f": 0.0 if value is None else (value - m["f", label]["mu"]) / m["f", label]["sd"], "g": 0.0}
            want = (sum((z[n] - m[n, label]["c"]) ** 2 for n in "fg"), sum(z[n] * m[n, label]["w"] + m[n, label]["b"] for n in "fg"))
            assert got[sample, label] == pytest.approx(want)
    assert models.predict(models.class_scores(test, model)).count() == 2


def test_result_rows_do_not_depend_on_the_selection(spark, tmp_path):
    good = "\t".join(["1"] + ["0.5"] * 11 + ["4", "0.5", "0.5", "OK"])
    (tmp_path / "r.tsv").write_text("\n".join([good, good.replace("0.5", "x", 1), "1\t2", good + "\textra\tmore"]) + "\n")
    d = files.read_result_tsv(spark, str(tmp_path))
    assert d.count() == d.select("score").count() == len(d.collect()) == len(d.select("score").collect()) == 1
    assert files.read_result_tsv(spark, str(tmp_path), strict=True).filter("_corrupt_record is not null").count() == 3


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    n = 20_000
    (tmp_path / "v.txt").write_text("".join(f"{i} {i + 0.5}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        d = files.read_value_file(spark, str(tmp_path))
        assert d.filter(F.col("v") != (F.col("t") - 1) / 2).count() == 0 and d.count() == 2 * n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_of_two_copies_in_a_batch_is_accepted(spark):
    row = "run_id string, step long, candidate_id long, score double"
    log = spark.createDataFrame([("r", 1, 1, 0.5)], row)
    batch = spark.createDataFrame([("r", 2, 7, 0.1), ("r", 2, 7, 0.1), ("r", 1, 1, 0.5), ("r", 1, 9, 0.2), ("s", 1, 1, 0.3)], row)
    got = sorted((r["run_id"], r["candidate_id"], r["verdict"]) for r in evidence.append_check(log, batch).collect())
    assert got == [("r", 1, "duplicate"), ("r", 7, "accepted"), ("r", 7, "duplicate"), ("r", 9, "late"), ("s", 1, "accepted")]


def test_collisions_within_the_tolerance(spark):
    grid = 1e-8
    a = [0.5 * grid, 1.0]
    rows = [(1, r, i, v) for r, d in (("A", 0.0), ("B", 2e-11), ("AB", 8e-9), ("opposite", 5.0)) for i, v in enumerate([a[0] - 1e-11 + d, a[1]])]
    got = response.collisions(spark.createDataFrame(rows, "world_id long, role string, idx long, v double")).first()
    assert (got["interventions"], got["merged"]) == (4, 1)


def test_rank_of_nearly_parallel_roles(spark):
    def rank(*vectors):
        rows = [(1, f"r{k}", i, float(x)) for k, v in enumerate(vectors) for i, x in enumerate(v)]
        return response.effective_rank(spark.createDataFrame(rows, "world_id long, role string, idx long, v double"), [f"r{k}" for k in range(len(vectors))]).first()["rank"]
    assert rank((1, 0), (1, 1e-5)) == 2 and rank((1, 0), (1, 1e-12)) == 1 and rank((1, 2, 3), (2, 4, 6), (0, 0, 0)) == 1
    assert rank((1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 3)) == 3


def test_manifest_states(spark, tmp_path):
    for n, t in (("a", "1"), ("b", "2"), ("c", "3")):
        (tmp_path / n).write_text(t)
    stored = [tuple(r) for r in files.file_manifest(spark, str(tmp_path)).collect()]
    (tmp_path / "a").unlink()
    (tmp_path / "b").write_text("two")
    (tmp_path / "d").write_text("4")
    before = spark.createDataFrame(stored, "file string, bytes long, sha256 string")
    got = {r["file"].rsplit("/", 1)[-1]: r["state"] for r in files.compare_manifest(before, files.file_manifest(spark, str(tmp_path))).collect()}
    assert got == {"a": "missing", "b": "changed", "c": "same", "d": "new"}


def test_stable_seed_is_crc32(spark):
    import zlib
    from skepsis.functions.hashing import stable_seed, stable_seed_scalar
    names = ["", "a", "É\u0301日本", "x" * 500]
    got = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, k long").select("name", "k", stable_seed("name", F.col("k"), 53000).alias("s")).collect()
    assert [r["s"] for r in got] == [(53000 + 1000 * r["k"] + zlib.crc32(r["name"].encode())) % 2**31 for r in got] == [stable_seed_scalar(r["name"], r["k"], 53000) for r in got]


def test_append_keeps_accepted_and_rejected(spark, tmp_path):
    row = "run_id string, step long, candidate_id long, score double"
    log = spark.createDataFrame([("r", 1, 1, 0.5)], row)
    batch = spark.createDataFrame([("r", 2, 7, 0.1), ("r", 2, 7, 0.1), ("r", 1, 1, 0.5)], row)
    evidence.append_evals(log, batch, str(tmp_path / "log"), str(tmp_path / "rejected"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1 and spark.read.parquet(str(tmp_path / "rejected")).count() == 2


def test_null_median_of_ties_and_groups_without_null(spark):
    null = spark.createDataFrame([("a", float(v)) for v in (1, 1, 2, 8)], "g string, stat double")
    obs = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "g string, observed double")
    got = {r["g"]: r for r in resample.null_statistics(null, obs, "g").collect()}
    assert (got["a"]["null_median"], got["a"]["minus_median"], got["a"]["exceedances"]) == (1.5, 1.5, 1)
    assert (got["b"]["status"], got["b"]["null_median"]) == ("UNRESOLVED", None)


def test_streams_order_batches_and_close_runs(spark, tmp_path):
    from skepsis.streaming import streams
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda xs: spark.createDataFrame(xs, "k string, t long, q long, s long").selectExpr("k", "t", "q", "timestamp_seconds(1700000000 + s) as ts")
    for part in ([("a", 2, 1, 2), ("a", 1, 1, 1), ("b", 1, 5, 1)], [("a", 3, 0, 3), ("b", 2, 5, 2)], [("z", 1, 0, 10**8)]):
        rows(part).coalesce(1).write.mode("append").parquet(src)
    d = spark.readStream.schema("k string, t long, q long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    streams.to_table(streams.runs(d, "k", delay="1 day"), out, str(tmp_path / "state"))
    got = {(r["k"], r["q"], r["start"], r["length"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1, 1, 2), ("a", 0, 3, 1), ("b", 5, 1, 2)}


def test_close_points_by_counts(spark):
    rng = np.random.default_rng(3)
    sets = {1: rng.normal(size=(300, 3)),                                                                  # all distances
            2: np.repeat(rng.integers(-2, 3, (40, 3)) * 0.25, 9, 0),                                       # ties, pairs exactly at a radius
            3: np.r_[rng.normal(size=(200, 3)) * 1e-7, rng.normal(size=(200, 3)) * 1e-7 + [0.5, 0, 0]],    # clusters about a radius apart
            4: np.array([[0.0, 0, 0], [1e12, 0, 0], [1e12, 0.1, 0]]), 5: np.zeros((1, 3))}
    rows = [(k, t, *map(float, x), 0.25, 0.5) for k, xs in sets.items() for t, x in enumerate(xs)]
    rows += [(1, 900, None, 0.0, 0.0, 0.25, 0.5), (1, 901, float("nan"), 0.0, 0.0, 0.25, 0.5), (1, 902, float("inf"), 0.0, 0.0, 0.25, 0.5)]
    pts = spark.createDataFrame(rows, "k int, t int, x0 double, x1 double, x2 double, r1 double, r2 double")

    def plain(xs):
        d = np.sqrt(sum((xs[:, None, i] - xs[None, :, i]) ** 2 for i in range(3)))[np.triu_indices(len(xs), 1)]
        return int((d < 0.25).sum()), int((d < 0.5).sum())
    want = {k: plain(xs) for k, xs in sets.items()}
    for spare, deepest in ((16, 40), (0, 4), (10 ** 6, 40)):
        got = seq.count_close_points(pts, "k", {"c1": "r1", "c2": "r2"}, spare=spare, deepest=deepest).collect()
        assert {r["k"]: (r["c1"], r["c2"]) for r in got} == want
    assert seq.count_close_points(pts.limit(0), "k", {"c1": "r1", "c2": "r2"}).count() == 0


def test_close_points_of_one_dense_series(spark):
    n = 200_000
    u = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)) * 1e-3
    pts = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), *[u(i).alias(f"x{i}") for i in range(3)], F.lit(0.1).alias("r1"), F.lit(0.4).alias("r2"))
    r = seq.count_close_points(pts, "k", {"c1": "r1", "c2": "r2"}).first()
    assert (r["c1"], r["c2"]) == (n * (n - 1) // 2,) * 2


def test_cycle_period_when_values_equal_the_mean(spark):
    """The mean is that of the values added in order, however the rows lie in tasks."""
    def period(vs, order):
        total = 0.0
        for i in order:
            total += vs[i]
        at = [t for t in range(1, len(vs)) if vs[t - 1] < total / len(vs) <= vs[t]]
        return (at[-1] - at[0]) / (len(at) - 1) if len(at) > 1 else float(len(vs))

    draw, data = random.Random(3), []
    while len(data) < 300:          # series of which a value is the mean in one order of adding only
        vs = [draw.randint(1, 60) / 100 for _ in range(25)]
        if period(vs, range(25)) != period(vs, sorted(range(25), key=lambda i: (i % 3, i))):
            data.append(vs)
    s = spark.createDataFrame([(k, t + 1, v) for k, vs in enumerate(data) for t, v in enumerate(vs)], "series_id bigint, t bigint, v double")
    want = [(k, period(vs, range(25))) for k, vs in enumerate(data)]
    got = seq.cycle_period(s.repartition(7, F.xxhash64("t", "v"))).orderBy("series_id").collect()
    assert [(r.series_id, r.period) for r in got] == want


def test_streamed_catalogue_keeps_directions(spark):
    """Written and read back as a stream, directions are the same to the last digits, the zero vector too."""
    from types import SimpleNamespace

    from skepsis.plans import io
    n = (0.3, 0.4, 0.5)
    size = math.sqrt(sum(x * x for x in n))
    cat = [(0, *[x / size for x in n], 2e19), (0, 0.0, 0.0, 0.0, None), (0, 1e-9, 0.0, 1.0, 3e19), (0, 0.6, 0.8, 0.0, 1e18), (-1, 1.0, 0.0, 0.0, 2e19)]
    V = SimpleNamespace(spark=spark, catalogue=spark.createDataFrame(cat, "sky_id bigint, ux double, uy double, uz double, energy double"))
    got = sorted((r.ux, r.uy, r.uz) for r in io._stream_catalogue(V).collect())
    want = sorted(c[1:4] for c in cat[:3])
    assert len(got) == 3 and all(abs(x - y) < 1e-15 for a, b in zip(got, want) for x, y in zip(a, b))
