"""Chunked primitives give the whole-window answer for any chunk size, also when one key dominates."""
import random

import pytest
from pyspark.sql import Window as W, functions as F

from skepsis.operators import pairing, resample, scale, sequence as seq

random.seed(3)
LENGTHS = {1: 200, 2: 7, 3: 1}  # series 1 holds nearly everything


@pytest.fixture(scope="module")
def series(spark):
    data = [(k, t, round(random.random() * 4, 2), int(random.random() < 0.3)) for k, n in LENGTHS.items() for t in range(1, n + 1)]
    return spark.createDataFrame(data, "series_id bigint, t bigint, v double, flag bigint").cache()


def same(a, b, places=9):
    norm = lambda df: sorted(tuple(round(x, places) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert norm(a) == norm(b)


@pytest.mark.parametrize("size", [3, 16, 1000])
def test_local_window(series, size):
    w = W.partitionBy("series_id").orderBy("t")
    got = scale.with_local(series, "series_id", "t", {"l": lambda w: F.lag("v", 2).over(w), "a": lambda w: F.avg("v").over(w.rangeBetween(-2, 3))},
                           before=2, after=3, size=size)
    want = series.withColumns({"l": F.lag("v", 2).over(w), "a": F.avg("v").over(w.rangeBetween(-2, 3))})
    same(got, want)


@pytest.mark.parametrize("size", [5, 1000])
def test_running(series, size):
    w = W.partitionBy("series_id").orderBy("t")
    got = scale.running(series, "series_id", "t", {"s": ("flag", "sum"), "m": ("v", "max")}, size)
    want = series.withColumns({"s": F.sum("flag").over(w), "m": F.max("v").over(w)})
    same(got.select(*want.columns), want)
    before = scale.running(series, "series_id", "t", {"m": ("v", "max")}, size, exclusive=True)
    same(before, series.withColumn("m", F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1))))


def test_dense_position(series):
    got = scale.dense_position(series, "series_id", ["v", "t"], F.floor(F.col("v") * 2), out="r")
    want = series.withColumn("r", F.row_number().over(W.partitionBy("series_id").orderBy("v", "t")).cast("bigint"))
    same(got.select(*want.columns), want)


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_value_ranks(series, buckets):
    got = scale.value_ranks(series, "series_id", "v", buckets)
    w = W.partitionBy("series_id")
    want = (series.withColumns({"below": F.rank().over(w.orderBy("v")) - 1, "total": F.count("v").over(w)})
            .groupBy("series_id", "v", "below", "total").agg(F.count(F.lit(1)).alias("n_at")))
    same(got.select("series_id", "v", "below", "total", "n_at"), want)


def test_quantiles_match_numpy(series):
    import numpy as np
    v = np.array([r.v for r in series.filter("series_id = 1").collect()])
    q = scale.rank_quantiles(series, "series_id", "v", {"a": lambda t: (t - 1) * 0.25, "b": lambda t: (t - 1) * 0.9}, 8)
    r = q.filter("series_id = 1").first()
    assert abs(r.a - np.quantile(v, 0.25)) < 1e-12 and abs(r.b - np.quantile(v, 0.9)) < 1e-12


@pytest.mark.parametrize("op", [
    lambda s, z: seq.moving_average_clamped(s, 5, size=z), lambda s, z: seq.detrend_available(s, 4, size=z),
    lambda s, z: seq.autocorr(s, size=z), lambda s, z: seq.permutation_entropy(s, size=z), lambda s, z: seq.transition_entropy(s, size=z),
    lambda s, z: seq.cycle_period(s, size=z), lambda s, z: seq.sign_run_entropy(s, size=z), lambda s, z: seq.islands(s, "series_id", "t", "flag", z),
    lambda s, z: seq.step_stats(s, size=z), lambda s, z: seq.recurrence_density(s, size=z), lambda s, z: seq.return_time_std(s, size=z),
    lambda s, z: seq.event_positions_gaps(s.withColumn("v", F.col("flag") * F.col("v")), size=z), lambda s, z: seq.log_growth(s, size=z),
    lambda s, z: seq.corr_dimension(s, size=z), lambda s, z: pairing.band_baseline(s, "series_id", 5, size=z),
    lambda s, z: resample.block_bootstrap_ci(s, "series_id", "v", 5, 20, 1, size=z)])
def test_chunk_size_does_not_matter(series, op):
    same(op(series, 9), op(series, 100000), 7)


def test_close_pairs_by_brute_force(series):
    s = [(r.t, r.v) for r in series.filter("series_id = 1").collect()]
    want = sum(abs(a[1] - b[1]) < 0.505 for i, a in enumerate(s) for b in s[i + 1:] if abs(a[0] - b[0]) >= 2)
    got = seq.count_close_pairs(series.withColumn("tol", F.lit(0.505)), "series_id", "v", "tol", size=11)
    assert {r.series_id: r.pairs for r in got.collect()}[1] == want


def test_permutation_is_a_bijection(series):
    p = resample.permutation(series, "series_id", "t", F.xxhash64("series_id", "t") / 2.0 ** 64 + 0.5, F.floor(F.col("t") / 16))
    r = p.collect()
    assert len(r) == sum(LENGTHS.values())
    for k, n in LENGTHS.items():
        assert sorted(x.donor for x in r if x.series_id == k) == list(range(1, n + 1))
