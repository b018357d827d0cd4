"""One-pass fingerprint, row-local components and the label-permutation null."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skepsis.operators import audit, evidence, fields, fingerprint, models


def fields_of(spark, named):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in named.items()], "sample_id string, vals array<double>")


def wide(df):
    return {r["sample_id"]: r.asDict() for r in df.collect()}


def test_closed_forms_and_constant_field(spark):
    xy = [(y, x) for y in range(6) for x in range(10)]
    d = fields_of(spark, {"flat": [0.5] * 60, "ramp": [x / 9 for _, x in xy], "check": [(-1) ** (x + y) for y, x in xy]})
    f = wide(fingerprint.fingerprint_wide(d, "sample_id", 10, 6))
    flat, ramp, check = f["flat"], f["ramp"], f["check"]
    assert set(flat) == {"sample_id", *fingerprint.FEATURES} and all(v is not None and math.isfinite(v) for r in f.values() for k, v in r.items() if k != "sample_id")
    assert flat["var"] == flat["skew"] == flat["kurt"] == flat["lag1"] == flat["directional"] == flat["slope"] == 0 and flat["horizontal"] == 0.5
    assert flat["distinct_values"] == 1 and flat["n_components"] == 1 and flat["max_size"] == 60 and flat["near_recurrence"] == pytest.approx(59 / 60)
    assert ramp["contrast"] == pytest.approx(1) and ramp["grad_mean"] == pytest.approx(0.5 / 9) and ramp["lap_std"] == pytest.approx(0, abs=1e-9)
    assert ramp["n_components"] == 1 and ramp["max_size"] == 30 and ramp["row_acf_1"] > 0.5
    assert check["lag1"] < 0 and check["row_acf_1"] == pytest.approx(-1) and check["row_acf_2"] == pytest.approx(1) and check["similarity"] == 0
    assert check["n_components"] == 30 and check["max_size"] == 1 and check["dct_high"] > 0.9


def test_agrees_with_single_operators(spark):
    rng = np.random.default_rng(5)
    d = fields_of(spark, {f"s{i}": rng.random(7 * 5) for i in range(4)}).cache()
    f = wide(fingerprint.fingerprint_wide(d, "sample_id", 7, 5))
    for op in (fields.gradient_stats, fields.laplacian_stats, fields.anisotropy, fields.local_variance, fields.components, fields.gradient_energy):
        for k, r in wide(op(d, "sample_id", 7, 5)).items():
            assert all(f[k][n] == pytest.approx(v, abs=1e-9) for n, v in r.items() if n != "sample_id"), op.__name__


def test_one_scan_and_only_the_parts_asked_for(spark, tmp_path):
    fields_of(spark, {"a": range(64)}).write.parquet(str(tmp_path / "g"))
    d = spark.read.parquet(str(tmp_path / "g"))
    plan = fingerprint.fingerprint(d, "sample_id", 8, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    some = fingerprint.fingerprint(d, "sample_id", 8, 8, which=["mean", "grad_mean"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "cos" not in plan and {r.name for r in some.collect()} == {"mean", "grad_mean"}
    assert {r.family for r in fingerprint.fingerprint(d, "sample_id", 8, 8, families=["spectral"]).select("family").distinct().collect()} == {"spectral"}


def test_errors_and_user_features(spark):
    d = fields_of(spark, {"a": range(64)})
    with pytest.raises(ValueError):
        fingerprint.fingerprint(d, "sample_id", 8, 8, which=["no such"])
    for bad in ([1.0] * 63, [float("nan")] + [1.0] * 63):
        with pytest.raises(Exception, match="finite values"):
            fingerprint.fingerprint(fields_of(spark, {"b": bad}), "sample_id", 8, 8, which=["mean"]).collect()
    assert fingerprint.fingerprint(d.limit(0), "sample_id", 8, 8).count() == 0
    fingerprint.register("test_energy", "user", lambda p: fingerprint.total(fingerprint.squares(p.dev)))
    try:
        with pytest.raises(ValueError):
            fingerprint.register("test_energy", "user", lambda p: p.mean)
        r = fingerprint.fingerprint(d, "sample_id", 8, 8, families=["user"]).first()
        assert r.value == pytest.approx(64 * np.var(np.arange(64)))
    finally:
        del fingerprint.FEATURES["test_energy"]


def test_components_of_winding_and_random_fields(spark):
    w, h = 30, 20
    rnd = random.Random(3)
    named = {f"r{i}": [float(rnd.random() < 0.6) for _ in range(w * h)] for i in range(6)}
    named["snake"] = [float(y % 2 == 0 or x == (w - 1 if y % 4 == 1 else 0)) for y in range(h) for x in range(w)]
    named["none"] = [0.0] * (w * h)

    def plain(v):
        seen, sizes = set(), []
        for s in range(w * h):
            if v[s] >= 0.5 and s not in seen:
                stack, size = [s], 0
                seen.add(s)
                while stack:
                    c = stack.pop()
                    size += 1
                    y, x = divmod(c, w)
                    for yy, xx in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)):
                        o = yy * w + xx
                        if 0 <= yy < h and 0 <= xx < w and o not in seen and v[o] >= 0.5:
                            seen.add(o)
                            stack.append(o)
                sizes.append(size)
        return len(sizes), sum(sizes) / max(len(sizes), 1), max(sizes, default=0)
    got = wide(fields.components(fields_of(spark, named), "sample_id", w, h))
    for k, v in named.items():
        assert (got[k]["n_components"], got[k]["mean_size"], got[k]["max_size"]) == pytest.approx(plain(v))


def test_user_cell_features_share_one_aggregation(spark):
    cells = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "sample_id string, v double")
    evidence.register_feature("t_max", "user", lambda c: F.max("v"))
    evidence.register_feature("t_n", "user", lambda c: F.count("v"))
    evidence.register_feature("t_frame", "other", lambda c: c.groupBy("sample_id").agg(F.min("v").alias("value")))
    try:
        got = {(r.sample_id, r.name): (r.value, r.family) for r in evidence.extract(cells, "sample_id", ["t_max", "t_n", "t_frame"]).collect()}
        assert got["a", "t_max"] == (4.0, "user") and got["a", "t_n"] == (2.0, "user") and got["b", "t_frame"] == (2.0, "other") and len(got) == 6
        plan = evidence.extract(cells, "sample_id", ["t_max", "t_n"])._jdf.queryExecution().executedPlan().toString()
        assert "Union" not in plan
        with pytest.raises(ValueError):
            evidence.extract(cells, "sample_id", ["no such"])
    finally:
        for n in ("t_max", "t_n", "t_frame"):
            del evidence.FEATURES[n]


def test_label_permutation_null_is_about_chance(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" if i % 4 == 0 else "y", n, float(rng.normal() + (3.0 if i % 4 == 0 and n == "f0" else 0.0))) for i in range(240) for n in ("f0", "f1")]
    d = spark.createDataFrame(rows, "sample_id long, label string, name string, value double")
    train, test = d.filter("sample_id < 160"), d.filter("sample_id >= 160")
    null = models.label_permutation_null(train, test, 12, 7, F.col("sample_id"), per_bucket=32)
    real = models.accuracies(models.predict(models.class_scores(test, models.fit(train))).join(test.select("sample_id", "label").distinct(), "sample_id"))
    s = models.permutation_summary(real, null).first()
    assert s.reps == 12 and s.real > 0.85 and 0.3 < s["mean"] < 0.7 and s["min"] <= s["mean"] <= s["max"]
    got = [r.n for r in null.collect()]
    assert got == [80] * 12
    assert models.label_permutation_null(train.limit(0), test, 3, 7, F.col("sample_id")).count() == 0


def test_set_hash_adds_up(spark):
    rows = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else "x") for i in range(20)] * 2
    h = lambda r: audit.set_hash(spark.createDataFrame(r, "a int, b string"), ["a", "b"]).first()
    whole, left, right = h(rows), h(rows[:7]), h(rows[7:])
    assert h(rows[::-1]) == whole and whole["rows"] == 40
    assert whole.hash_a == (left.hash_a + right.hash_a) % 2 ** 60 and whole.hash_b == (left.hash_b + right.hash_b) % 2 ** 60
    assert h([(1, None)]) != h([(1, "")]) and h(rows[:20]) != whole
