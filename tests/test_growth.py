"""Joins whose sides grow with the data: nothing that an explode multiplies is sent through the driver."""
import re

import pytest
from pyspark.sql import functions as F

from skepsis.operators import models, resample, scale, sequence, sphere

from .conftest import SF, rows


@pytest.fixture(scope="module")
def series(spark):
    return scale.materialize(spark.range(200).select((F.col("id") % 2).alias("series_id"), (F.floor(F.col("id") / 2) + 1).alias("t"), F.sin("id").alias("v")))


@pytest.fixture(scope="module")
def events(series):
    return scale.materialize(series.filter("t % 5 = 0").select("series_id", (F.col("t") / 5).cast("bigint").alias("k"), F.col("t").alias("pos"), F.col("v").alias("amp"), F.lit(5).cast("bigint").alias("gap")))


def broadcasts_replicates(df):
    """Does a broadcast of the plan hold rows that an explode has multiplied since the last shuffle?"""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    depth = lambda s: len(re.match(r"[\s:+\-|*]*", s).group())
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        for below in lines[i + 1:]:
            if depth(below) <= depth(line) or re.search(r"(?<!Broadcast)Exchange ", below):
                break
            if "Generate explode" in below:
                return True
    return False


def lengths(s):
    return s.groupBy("series_id").agg(F.max("t").alias("n"))


def test_block_bootstrap_sends_no_draws_to_the_driver(series):
    assert not broadcasts_replicates(resample.block_bootstrap_ci(series, "series_id", "v", 7, 20, 1))


def test_block_bootstrap_of_short_series_wraps(spark):
    s = spark.createDataFrame([(1, t, float(t * t)) for t in range(1, 6)], "series_id bigint, t bigint, v double")
    # one block that covers the circle, whatever its start
    assert rows(resample.block_bootstrap_ci(s, "series_id", "v", 21, 10, 1)) == [(1, 11.0, 11.0)]


def test_control_family_sends_no_replicated_events_to_the_driver(series, events):
    assert not broadcasts_replicates(resample.control_family(series, events, lengths(series), "series_id", 5, F.col("amp")))


def test_shuffled_replicates_are_not_sent_to_the_driver(series):
    d = scale.replicate(series, 5)
    got = resample.shuffle_values(d, ["rep", "series_id"], "t", "v", 1)
    assert not broadcasts_replicates(got)
    assert rows(got.groupBy("rep", "series_id").agg(F.sort_array(F.collect_list("shuffled")).alias("x")), "rep", "series_id") == rows(
        d.groupBy("rep", "series_id").agg(F.sort_array(F.collect_list("v")).alias("x")), "rep", "series_id")


def test_label_permutations_are_not_sent_to_the_driver(spark):
    f = spark.range(40).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"),
                               F.explode(F.array(F.lit("x"), F.lit("y"))).alias("name"), F.sin("id").alias("value"))
    f = scale.materialize(f)
    got = models.label_permutation_null(f.filter("sample_id < 30"), f.filter("sample_id >= 30"), 4, "s", F.col("sample_id"))
    assert not broadcasts_replicates(got)
    assert [(r.rep, r.n) for r in got.orderBy("rep").collect()] == [(r, 10) for r in range(4)]


def test_events_of_one_null_sky_are_made_in_many_tasks(spark):
    n = 5 * sphere.RUN + 3
    one = spark.range(1).select(F.lit(n).cast("bigint").alias("n_events"))
    null = sphere.isotropic_events(scale.replicate(one, 2, "null_id"), F.col("n_events"), ["n_events", "null_id"], "s")
    got = null.groupBy("null_id").agg(F.count_distinct("event_id").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    assert rows(got, "null_id") == [(0, n, 0, n - 1), (1, n, 0, n - 1)]
    assert null.groupBy(F.spark_partition_id().alias("p")).count().count() > 1


def test_axis_score_adds_up_skies_that_share_batches(spark):
    ev = spark.range(500).select((F.col("id") % 7).alias("sky_id"), F.concat(F.lit("k"), F.col("id") % 3).alias("name"), *[c.alias(n) for c, n in zip(sphere.direction("d", F.col("id")), ("ux", "uy", "uz"))])
    pool = sphere.rotation_pool(spark, 4, 1)
    j = ev.crossJoin(pool)
    dots = [F.abs(F.col("ux") * F.col(f"m1{k}") + F.col("uy") * F.col(f"m2{k}") + F.col("uz") * F.col(f"m3{k}")) for k in (1, 2, 3)]
    w = F.exp(-0.5 * F.pow(F.acos(F.least(F.lit(1.0), F.greatest(*dots))) / F.radians(F.lit(8.0)), F.lit(2.0)))
    want = j.groupBy("sky_id", "name", "rot_id").agg(F.avg(w).alias("score"), F.count(F.lit(1)).alias("n"))
    flat = lambda d: [(r.sky_id, r.name, r.rot_id, pytest.approx(r.score, abs=1e-12), r.n) for r in d.orderBy("sky_id", "name", "rot_id").collect()]
    got = sphere.axis_score(ev, pool, 4, ["sky_id", "name"])
    assert [(r.sky_id, r.name, r.rot_id, r.score, r.n) for r in got.orderBy("sky_id", "name", "rot_id").collect()] == flat(want)


def test_few_bytes_of_much_work_are_dealt_over_tasks(spark):
    from skepsis.plans.fixtures import Views
    tasks = lambda d: d.groupBy(F.spark_partition_id().alias("p")).count().count()
    assert tasks(Views(spark, SF).unit_grids) > 1
    hits = spark.range(400, numPartitions=1).select(F.lit("a").alias("set"), F.col("id").cast("string").alias("rid"), (F.col("id") % 2).cast("double").alias("hit"))
    got = resample.bootstrap_ci(hits, "set", "rid", 20, 1)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().optimizedPlan().toString() or "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got.select("n", "mean")) == [(400, 0.5)]


def test_digests_are_those_of_the_library():
    from hashlib import md5

    import numpy as np

    from skepsis.functions.digest import digester
    heads, tails = [b"6:%d" % r for r in range(0, 1200, 37)] + [b""], [b":1:%d:%d" % (i, i * i) for i in range(40)] + [b"", b"x" * 54, b"y" * 53, b"z" * 70]
    seen = {}
    for i, j, words in digester(tile=100)(heads, tails):
        raw = np.stack(words, axis=-1).astype("<u4")
        seen |= {(a, b): raw[x, y].tobytes() for x, a in enumerate(i.tolist()) for y, b in enumerate(j.tolist())}
    assert seen == {(a, b): md5(h + t).digest() for a, h in enumerate(heads) for b, t in enumerate(tails)}


def test_sign_flips_are_those_of_the_hash_and_not_one_row_per_draw(spark):
    from skepsis.functions.hashing import hash_sign
    d = spark.range(300).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 9 > 0, F.sin("id") + 0.1).alias("difference"))
    got = resample.sign_flip_test(d, "g", "id", reps=40, seed="s")
    flips = scale.replicate(d, 40).groupBy("g", "rep").agg(F.sum(hash_sign("s", F.col("rep"), F.col("g"), F.col("id")) * F.col("difference")).alias("f"), F.sum("difference").alias("o"))
    want = flips.groupBy("g").agg(F.count(F.when(F.abs("f") >= F.abs("o") - 1e-9, 1)).alias("exceedances"))
    assert rows(got.select("g", "exceedances"), "g") == rows(want, "g")
    assert "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_task_holds_a_bounded_number_of_pairs(spark):
    d = spark.range(10000).select(F.col("id").alias("pair_id"))
    assert scale.spread(d, "pair_id", rows=10000, most=500).rdd.getNumPartitions() == 20
    from skepsis.plans.fixtures import Views
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # as for large tables: what the join's own shuffle leaves is merged by size in bytes
    try:
        assert Views(spark, SF).pair_grids.groupBy(F.spark_partition_id().alias("p")).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("length,sent", [(12, 2), (60, 2)])
def test_points_are_sent_to_few_neighbours(spark, length, sent):
    """Short series meet in slabs along one axis: a point is sent to as few cells as keep the pairs in proportion."""
    import itertools
    import math
    x = [tuple(math.sin(1.7 * i * (j + 1)) * 3 for j in range(3)) for i in range(length)]
    p = spark.createDataFrame([(k, *v, 0.2, 1.0) for k in (1, 2) for v in x], "series_id long, x0 double, x1 double, x2 double, r1 double, r2 double")
    got = sequence.count_close_points(p, "series_id", {"n1": "r1", "n2": "r2"})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("struct(x0") for line in plan.splitlines() if "explode(array(" in line) == sent
    want = [sum(math.dist(a, b) < r for a, b in itertools.combinations(x, 2)) for r in (0.2, 1.0)]
    assert {r.series_id: [r.n1, r.n2] for r in got.collect()} == {1: want, 2: want}


def test_role_surrogate_deals_worlds_by_the_rows(spark, monkeypatch):
    """What the replicates make of a table goes to tasks by its rows; the optimizer's merging of partitions by bytes doesn't touch it."""
    from skepsis.plans import physics
    from skepsis.plans.fixtures import Views
    views = Views(spark, str(SF))
    monkeypatch.setattr(physics, "LINES_A_TASK", 20)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-views.table("lineitem").count() // 20))
    plan = physics._role_surrogate(views)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if f", {parts}), REPARTITION_BY_NUM" in line]
    assert any(re.search(r"hashpartitioning\(rep#\w+, mech#\w+, world_id#", line) for line in dealt)
    assert any(re.search(r"hashpartitioning\(mech#\w+, role#\w+, donor#", line) for line in dealt)
