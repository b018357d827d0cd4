"""Nulls, surrogates and resampling.  A replicate is a key, so all replicates run in one job."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.digest import digester
from ..functions.hashing import hash_normal, hash_uniform
from ..functions.numeric import dbl, ratio
from .scale import CHUNK, chunked, dense_position, grouper, hash_bucket, join_rows, materialize, names, replicate, running, spread


def permutation(ids: DataFrame, by, id: str, draw: Column, bucket: Column, hash_buckets: int = 64, carry=()) -> DataFrame:
    """A uniformly random bijection id -> donor within each group `by`; `carry` names columns taken from the donor's row.

    The i-th id takes the i-th id in the order of its draw.  Both orders are numbered from bucket
    counts; the draw is uniform, so its buckets are equally full whatever the group size.
    """
    by = names(by)
    a = dense_position(ids.select(*by, id), by, id, bucket, out="_r")
    d = ids.select(*by, F.col(id).alias("donor"), draw.alias("_u"), *carry)
    b = dense_position(d, by, ["_u", "donor"], hash_bucket("_u", hash_buckets), out="_r").drop("_u")
    return join_rows(a, b, by + ["_r"]).drop("_r")


def shuffle_values(df: DataFrame, by, id: str, value: str, seed, bucket: Column | None = None, out: str = "shuffled") -> DataFrame:
    """Permute `value` among the rows of each group."""
    by = names(by)
    bucket = F.floor(F.col(id) / 1024) if bucket is None else bucket
    v = df.select(*by, id, F.col(value).alias(out))
    p = permutation(v, by, id, hash_uniform(seed, *[F.col(b) for b in by], F.col(id)), bucket, carry=[out])
    return join_rows(df, p.drop("donor"), by + [id])


# -- event trains ---------------------------------------------------------------------------------------

def matched_event(series: DataFrame, events: DataFrame, key: str, seed, by: tuple = ()) -> DataFrame:
    """Same amplitudes at distinct random positions of the same series: event k takes the k-th slot
    in hash order.  `by` adds replicate keys carried by `events`."""
    by = list(by)
    k = [key] + by
    reps = events.select(*k).distinct() if by else None
    slots = series.select(key, "t")
    if by:
        slots = slots.join(reps, key)
    u = hash_uniform(seed, *[F.col(b) for b in by], F.col(key), F.col("t"))
    slots = dense_position(slots.withColumn("_u", u), k, ["_u", "t"], hash_bucket("_u", 64), out="k").drop("_u")
    return join_rows(events.select(*k, "k", "amp"), slots, k + ["k"])


def gap_matched(events: DataFrame, lengths: DataFrame, key: str, seed, by: tuple = (), size: int = CHUNK) -> DataFrame:
    """Same count, amplitudes and circular gap multiset; gaps are permuted, the first position kept.

    events: (key, k, pos, amp, gap); lengths: (key, n).
    """
    by = list(by)
    ks = [key] + by
    u = hash_uniform(seed, *[F.col(b) for b in by], F.col(key), F.col("k"))
    donors = dense_position(events.select(*ks, "gap", "k", u.alias("_u")), ks, ["_u", "k"], hash_bucket("_u", 64), out="_r")
    g = donors.select(*ks, F.col("_r").alias("k"), F.col("gap").alias("_g"))
    e = join_rows(events.drop("gap"), g, ks + ["k"])
    first = events.groupBy(*ks).agg(F.min("pos").alias("_first"))
    e = running(e, ks, "k", {"_before": ("_g", "sum")}, size, exclusive=True)
    e = e.join(first, ks).join(lengths, key)
    return e.select(*ks, "k", "amp", ((F.col("_first") + F.col("_before") - 1) % F.col("n") + 1).alias("t"))


def control_family(series: DataFrame, events: DataFrame, lengths: DataFrame, key: str, reps: int, score: Column) -> DataFrame:
    """Family means of `score` (an expression of t and amp) under matched, gap-matched and shifted events."""
    r = replicate(events, reps)
    m = matched_event(series, r, key, "m", ("rep",)).select(key, "rep", "t", "amp", F.lit("matched").alias("family"))
    g = gap_matched(r, lengths, key, "g", ("rep",)).select(key, "rep", "t", "amp", F.lit("gap_matched").alias("family"))
    s = r.join(lengths, key).select(key, "rep", ((F.col("pos") - 1 + (F.col("rep") + 1) * 7) % F.col("n") + 1).alias("t"),
                                    "amp", F.lit("shifted").alias("family"))
    one = m.unionByName(g).unionByName(s).groupBy(key, "family", "rep").agg(F.sum(score).alias("score"))
    return one.groupBy(key, "family").agg(F.count("score").alias("n"), F.avg("score").alias("mean_score"),
                                          F.min("score").alias("min_score"), F.max("score").alias("max_score"))


# -- bootstrap --------------------------------------------------------------------------------------------

def bootstrap_ci(hits: DataFrame, by, id: str, reps: int = 1000, seed=0, hit: str = "hit") -> DataFrame:
    """Percentile interval of the mean of hits in {0, 1/2, 1}.

    A resample of n hits depends only on how many draws land on each of the three values, so a draw
    is compared with cumulative counts: no index join, and only (group, replicate) sums are shuffled.
    """
    by = names(by)
    hits = materialize(hits.select(*by, id, hit))
    c = hits.groupBy(*by).agg(F.count(hit).alias("_n"), F.count(F.when(F.col(hit) == 0, 1)).alias("_c0"),
                              F.count(F.when(F.col(hit) < 1, 1)).alias("_c1"), F.avg(hit).alias("mean"))
    d = replicate(spread(hits.select(*by, id).join(c, by), *by, id), reps)       # groups are few, rows are many
    j = F.floor(hash_uniform(seed, "rep", F.col("rep"), F.col(id)) * F.col("_n"))
    x = F.when(j < F.col("_c0"), 0.0).when(j < F.col("_c1"), 0.5).otherwise(1.0)
    m = d.groupBy(*by, "rep").agg(F.avg(x).alias("m"), F.max("_n").alias("n"), F.max("mean").alias("mean"))
    w = W.partitionBy(*by).orderBy("m", "rep")  # bounded: one row per replicate
    m = m.withColumn("_r", F.row_number().over(w) - 1)
    return m.groupBy(*by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"),
                              F.max(F.when(F.col("_r") == int(0.025 * reps), F.col("m"))).alias("lo"),
                              F.max(F.when(F.col("_r") == int(0.975 * reps), F.col("m"))).alias("hi"))


LEAF = 1024


def _binomial(m: Column, p: Column, *key) -> Column:
    """A keyed binomial of many draws: normal with continuity correction.  Leaves are equally full, so m p (1 - p) is above 100."""
    m = m.cast("double")
    x = F.floor(m * p + F.sqrt(m * p * (1.0 - p)) * hash_normal(*key) + 0.5)
    return F.least(F.greatest(x, F.lit(0)), m.cast("bigint")).cast("bigint")


def leaf_draws(rep: Column, leaf: Column, leaves: Column, n: Column, seed, *key) -> Column:
    """How many of a replicate's n draws fall on rows of `leaf`: the draws are split down a binary tree over the leaves.

    A node's left half gets a binomial share that is a function of (seed, replicate, group, node), the right half the rest, so
    every leaf finds its own number without meeting the others, and a replicate's numbers add up to n.
    """
    def first(at):                          # the first row of a leaf
        return F.ceil(at * n / leaves.cast("double"))

    def step(s, _):
        lo, hi, m = s["lo"], s["hi"], s["m"]
        mid = F.floor((lo + hi) / 2).cast("bigint")
        left = _binomial(m, (first(mid) - first(lo)).cast("double") / (first(hi) - first(lo)).cast("double"), seed, "split", rep, *key, lo, hi)
        went = F.struct(lo.alias("lo"), mid.alias("hi"), left.alias("m"))
        return F.when(hi - lo == 1, s).when(leaf < mid, went).otherwise(F.struct(mid.alias("lo"), hi.alias("hi"), (m - left).alias("m")))
    depth = F.ceil(F.log2(leaves.cast("double")) + 1e-9).cast("int")
    start = F.struct(F.lit(0).cast("bigint").alias("lo"), leaves.cast("bigint").alias("hi"), n.cast("bigint").alias("m"))
    return F.when(leaves == 1, n.cast("bigint")).otherwise(F.aggregate(F.sequence(F.lit(1), depth), start, step)["m"])


def bootstrap_mean_ci(values: DataFrame, by, order, bucket: Column, value: str = "difference", reps: int = 1000, seed=0) -> DataFrame:
    """Percentile interval (interpolated) of the mean of arbitrary values, every replicate drawing exactly n rows.

    Rows are numbered and packed into leaves of at most `LEAF` values.  A leaf finds by `leaf_draws` how many draws of each
    replicate it gets and spreads them over its values; so draws are neither shuffled nor joined, only sums of (group, replicate).
    """
    by = names(by)
    v = dense_position(values.select(*by, *names(order), value), by, order, bucket, out="_i")
    n = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    v = v.join(n, by).withColumn("_k", F.ceil(F.col("_n") / LEAF)).withColumn("_leaf", F.floor((F.col("_i") - 1) * F.col("_k") / F.col("_n")).cast("bigint"))
    leaves = spread(v.select(*by, "_leaf", "_i", value, "_n", "_k"), *by, "_leaf").groupBy(*by, "_leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", value))), lambda s: s[value].cast("double")).alias("_v"),
                                         F.max("_n").alias("_n"), F.max("_k").alias("_k"))
    key = [F.col(b) for b in by]
    rep = F.col("rep")
    digests = digester()
    lots = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: leaf_draws(r, F.col("_leaf"), F.col("_k"), F.col("_n"), seed, *key))
    d = leaves.select(*by, "_n", F.concat_ws(":", *[k.cast("string") for k in key], F.col("_leaf").cast("string")).alias("_at"), lots.alias("_ms"), "_v")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                at, lot, v = (b.column(c)[i] for c in range(len(by) + 1, len(by) + 4))
                nulls, v = v.values.is_null().to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)
                lot = lot.values.to_numpy()
                sums, lost = np.zeros(reps), np.zeros(reps, bool)
                heads, blocks = [f"{seed}:draw:{rep}:{at}:".encode() for rep in range(reps)], [b"%d" % k for k in range((int(lot.max()) + 3) // 4)]
                for r, k, words in digests(heads, blocks):              # one digest gives four draws
                    j = (np.stack(words, axis=-1).astype(np.uint32).byteswap() / 2.0 ** 32 * len(v)).astype(np.int64)
                    drawn = 4 * k[None, :, None] + np.arange(4) < lot[r, None, None]
                    sums[r] += np.where(drawn, v[j], 0.0).sum(axis=(1, 2))
                    lost[r] |= (drawn & nulls[j]).any(axis=(1, 2))
                keys = b.slice(i, 1).take(pa.array(np.zeros(reps, np.int64))).columns[:len(by) + 1]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(reps)), pa.array(sums, mask=lost)], names=[*by, "_n", "rep", "_s"])

    made = StructType([*d.schema.fields[:len(by) + 1], StructField("rep", LongType()), StructField("_s", DoubleType())])
    m = d.mapInArrow(run, made).groupBy(*by, "rep").agg((F.sum("_s") / F.max("_n")).alias("m"))
    return m.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))


#: positions whose values lie in one row of `block_bootstrap_ci`
SPAN = 4096


def block_bootstrap_ci(series: DataFrame, key: str, value: str, block: int = 21, reps: int = 200, seed=0, size: int = SPAN) -> DataFrame:
    """Circular moving-block interval of the mean of a dense series.

    A chunk of positions, with the positions after it that a block may reach, is one row.  A block is one row (replicate, start) sent
    to the chunk of its start, where its values are added up; the last block is cut so that exactly n values are drawn.  Blocks are
    made where their replicate lies, so they are dealt over all tasks however few the series are.
    """
    n = series.groupBy(key).agg(F.max("t").alias("_n"))
    s = series.select(key, "t", F.col(value).cast("double").alias("_v"))
    at = F.col("t") - 1
    ends = F.when(F.col("t") < block, F.col("t") + F.col("_n") - 1)         # the first values once more behind the last
    s = s.join(n, key).select(key, F.explode(F.filter(F.array(at, ends), lambda t: t.isNotNull())).alias("at"), "_v")
    c = chunked(s, key, "at", after=block, size=size)
    size = max(size, block, 1)
    c = c.groupBy(key, "_chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "_v"))), lambda x: F.coalesce(x["_v"], F.lit(0.0))).alias("_vs"))
    blocks = spread(replicate(n, reps), key, "rep").withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block))))
    start = F.floor(hash_uniform(seed, F.col("rep"), F.col(key), F.col("b")) * F.col("_n"))  # 0-based
    length = F.least(F.lit(block), F.col("_n") - F.col("b") * block)
    q = blocks.select(key, "rep", "_n", start.alias("_s"), length.alias("_l")).withColumn("_chunk", F.floor(F.col("_s") / size))
    first = (F.col("_s") - F.col("_chunk") * size + 1).cast("int")
    drawn = F.aggregate(F.slice("_vs", first, F.col("_l").cast("int")), F.lit(0.0), lambda a, x: a + x)
    m = join_rows(q, c, [key, "_chunk"]).groupBy(key, "rep").agg((F.sum(drawn) / F.max("_n")).alias("m"))
    m = m.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("m", "rep")) - 1)
    return m.groupBy(key).agg(F.max(F.when(F.col("_r") == int(0.025 * reps), F.col("m"))).alias("lo"),
                              F.max(F.when(F.col("_r") == min(reps - 1, int(0.975 * reps)), F.col("m"))).alias("hi"))


def sign_flip_test(values: DataFrame, by, id, value: str = "difference", reps: int = 1000, seed=0) -> DataFrame:
    """Two-sided sign-flip p-value.  A task draws the signs of a batch of rows (`hash_sign` of seed, replicate, group and id) and sums up per replicate."""
    by, id = names(by), names(id)
    row = F.concat_ws(":", F.lit(""), *[F.col(c).cast("string") for c in by + id])
    d = spread(values.select(*by, *id, value), *by, *id).select(*by, row.alias("_row"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    digests, grouped = digester(), grouper()
    heads = [f"{seed}:{rep}".encode() for rep in range(reps)]

    def run(batches):
        for b in batches:
            order, starts = grouped(b, len(by)) if b.num_rows else ((), ())
            for at in np.split(order, starts[1:]) if len(starts) else ():
                g = b.take(pa.array(at))
                v, flips = g.column(len(by) + 1).to_numpy(), np.zeros(reps)
                for r, j, words in digests(heads, [x.encode() for x in g.column(len(by)).to_pylist()]):
                    flips[r] += np.where(words[0] & 0x80, v[j], -v[j]).sum(axis=1)       # the first hex digit tells whether the draw is below 1/2
                keys = g.take(pa.array(np.zeros(reps, np.int64))).columns[:len(by)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(reps)), pa.array(flips), pa.array(np.full(reps, v.sum()))], names=[*by, "rep", "_f", "_o"])

    made = StructType([*d.schema.fields[:len(by)], StructField("rep", LongType()), StructField("_f", DoubleType()), StructField("_o", DoubleType())])
    r = d.mapInArrow(run, made).groupBy(*by, "rep").agg(F.sum("_f").alias("flip"), F.sum("_o").alias("obs"))
    # a replicate equal to the observation up to rounding counts as reaching it
    hit = F.abs("flip") >= F.abs("obs") - 1e-9
    return r.groupBy(*by).agg(F.count(F.when(hit, 1)).alias("exceedances"),
                              ((F.count(F.when(hit, 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


# -- summaries of nulls -------------------------------------------------------------------------------------

def empirical_p(null: DataFrame, observed: DataFrame, by, value: str = "stat", obs: str = "observed") -> DataFrame:
    """(1 + #{null >= observed}) / (1 + n), null mean, deviation (ddof 0) and z with a floored deviation."""
    by = names(by)
    j = null.select(*by, F.col(value).alias("_x")).join(observed.select(*by, F.col(obs).alias("_o")), by)
    a = j.groupBy(*by).agg(F.count("_x").alias("n_null"), F.count(F.when(F.col("_x") >= F.col("_o"), 1)).alias("exceed"),
                           F.avg("_x").alias("null_mean"), F.stddev_pop("_x").alias("null_sd"), F.max("_o").alias(obs))
    sd = F.when(F.col("null_sd") == 0, 1e-12).otherwise(F.col("null_sd"))
    return a.select(*by, obs, "n_null", "null_mean", "null_sd", ((F.col("exceed") + 1) / (F.col("n_null") + 1)).alias("p_value"),
                    ((F.col(obs) - F.col("null_mean")) / sd).alias("z"))


def null_statistics(null: DataFrame, observed: DataFrame, by, value: str = "stat", obs: str = "observed") -> DataFrame:
    """Null summary per group; groups without null values are UNRESOLVED.  Percentile is the share
    strictly below the observation."""
    from .scale import rank_quantiles
    by = names(by)
    x, o = F.col("_x"), F.col("_o")
    # the exact median by ranks of distinct values: no task holds a group's values
    median = rank_quantiles(null.filter(F.col(value).isNotNull()), by, value, {"null_median": lambda n: (n - 1) / 2.0})
    j = observed.select(*by, F.col(obs).alias("_o")).join(null.select(*by, F.col(value).alias("_x")), by, "left")
    ge = F.count(F.when(x >= o, 1))
    n = F.count(x)
    a = j.groupBy(*by).agg(
        n.alias("n"), F.max(o).alias(obs), F.avg(x).alias("null_mean"), F.stddev_samp(x).alias("null_std"),
        F.max(x).alias("null_max"), ge.alias("exceedances"))
    a = a.join(median, by, "left")
    some = F.col("n") > 0
    return a.select(
        *by, F.when(some, "OK").otherwise("UNRESOLVED").alias("status"), obs, "n", "null_mean", "null_std", "null_median",
        "null_max", (F.col(obs) - F.col("null_mean")).alias("minus_mean"), (F.col(obs) - F.col("null_median")).alias("minus_median"),
        (F.col(obs) - F.col("null_max")).alias("minus_max"),
        F.when(some, 100.0 * (F.col("n") - F.col("exceedances")) / F.nullif(dbl("n"), F.lit(0.0))).alias("percentile"),
        F.when(some, F.col("exceedances")).alias("exceedances"),
        F.when(some, (F.col("exceedances") + 1) / (F.col("n") + 1)).alias("search_null"),
        F.when(some, 1.0 / (F.col("n") + 1)).alias("minimum_attainable"))


def search_null(candidates: DataFrame, run, score: str = "score", tie: str = "candidate_id") -> DataFrame:
    """Best candidate of every equal-budget null search: an aggregate per run."""
    b = F.max(F.struct(F.col(score), (-F.col(tie)).alias("_t")))
    return candidates.filter(F.col(score).isNotNull()).groupBy(*names(run)).agg(b.alias("_b"), F.count(F.lit(1)).alias("budget")).select(
        *names(run), F.col(f"_b.{score}").alias("stat"), (-F.col("_b._t")).alias(tie), "budget")


def surrogate_summary(null: DataFrame, by, value: str = "stat") -> DataFrame:
    """N, mean, sd, median, index quantiles 0.90 / 0.95, max."""
    from .marginal import quantile_index
    by = names(by)
    a = null.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
                              F.max(value).alias("max"))
    return a.join(quantile_index(null, by, value, {"median": 0.5, "p90": 0.9, "p95": 0.95}), by)


def effect_size(values: DataFrame, by, value: str = "difference", minimum: int = 20, ddof: int = 1) -> DataFrame:
    """mean / sd with INSUFFICIENT (too few) and DEGENERATE (all zero) status."""
    by = names(by)
    sd = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    a = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"),
                                F.max(F.abs(F.col(value))).alias("_top"))
    st = F.when(F.col("n") < minimum, "INSUFFICIENT_DATA").when(F.col("_top") == 0, "DEGENERATE").otherwise("OK")
    return a.select(*by, "n", "mean", "sd", ratio("mean", "sd").alias("effect"), st.alias("status"))


def paired_temporal_test(trace: DataFrame, base: DataFrame, key: str = "series_id", by=("all",), reps: int = 1000,
                         seed=0, minimum: int = 20, size: int = CHUNK) -> DataFrame:
    """Baseline adjustment, detrending, matching, effect size, bootstrap interval, sign-flip p, and the rows left out by reason.

    A group without any matched pair keeps its row: n = 0, status INSUFFICIENT_DATA, no inference.
    """
    from . import pairing
    adj = materialize(pairing.baseline_adjust(trace, base, key))
    resp = materialize(pairing.responses(adj, key, size))
    d = pairing.matched_differences(resp, key, 10, size)
    left_out = pairing.exclusions(adj, key, size)
    by = list(by)
    if by == ["all"]:
        d, left_out = d.withColumn("all", F.lit(1)), left_out.withColumn("all", F.lit(1))
    d = materialize(d)
    counts = [F.sum(c).alias(c) for c in (*pairing.REASONS, "unobservable_predecessor", "usable", "eligible")]
    groups = left_out.groupBy(*by).agg(*counts)
    if by == ["all"]:
        groups = groups.unionByName(trace.sparkSession.range(1).select(F.lit(1).alias("all"), *[F.lit(0).cast("bigint").alias(c) for c in groups.columns if c != "all"])).groupBy("all").agg(
            *[F.sum(c).alias(c) for c in groups.columns if c != "all"])
    e = groups.join(effect_size(d, by, minimum=minimum), by, "left").fillna({"n": 0, "status": "INSUFFICIENT_DATA"})
    ci = bootstrap_mean_ci(d, by, [key, "t"], F.floor(F.col(key) / 64), reps=reps, seed=seed)
    p = sign_flip_test(d, by, [key, "t"], reps=reps, seed=seed)
    return e.join(ci, by, "left").join(p, by, "left")
