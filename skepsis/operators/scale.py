"""Primitives that keep ordered work parallel *inside* one key.

A window over `partitionBy(key)` puts a whole key into one task.  When one series can hold a third
of the data that task is the job.  The operators therefore never partition by the key alone:

* `chunked` cuts a series into fixed runs of positions and copies only the few boundary rows an
  expression has to look back or ahead at, so `lag`, `lead` and bounded frames run per chunk;
* `running` adds chunk totals to chunk-local prefixes (totals are one row per chunk);
* `dense_position` numbers rows from per-bucket counts, so no task sees a whole key;
* `value_ranks` ranks *distinct values with counts*: ties, however many, are one row.
"""
from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import col

CHUNK = 1 << 16


def names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def chunked(df: DataFrame, keys, pos: str, before: int = 0, after: int = 0,
            size: int = CHUNK) -> DataFrame:
    """Add `_chunk` and `_own`; rows within `before`/`after` of a boundary are copied next door."""
    size = max(size, before, after, 1)
    p = F.col(pos).cast("bigint")
    home = F.floor(p / size)
    inside = F.pmod(p, F.lit(size))
    copies = [home]
    if before:
        copies.append(F.when(inside >= size - before, home + 1))
    if after:
        copies.append(F.when(inside < after, home - 1))
    if len(copies) == 1:
        return df.withColumn("_chunk", home).withColumn("_own", F.lit(True))
    out = df.withColumn("_chunk", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
    return out.withColumn("_own", F.col("_chunk") == home)


def chunk_window(keys, pos: str):
    return W.partitionBy(*names(keys), "_chunk").orderBy(pos)


def with_local(df: DataFrame, keys, pos: str, exprs: dict, before: int = 0, after: int = 0,
               size: int = CHUNK) -> DataFrame:
    """Add columns `exprs[name](window)` that look at most `before`/`after` *positions* away."""
    c = chunked(df, keys, pos, before, after, size)
    w = chunk_window(keys, pos)
    return (c.withColumns({n: f(w) for n, f in exprs.items()})
            .filter("_own").drop("_chunk", "_own"))


def ensure_checkpoint_dir(spark) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only in local mode, where driver and tasks share a disk."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark, label: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared checkpoint folder: for results read several times.

    Unlike a cache the table survives the loss of executors, cuts the plan, and gives the readers
    column pruning and file statistics.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys, pos: str, outs: dict, size: int = CHUNK,
            exclusive: bool = False) -> DataFrame:
    """Running aggregates per key in `pos` order.  outs: name -> (column, 'sum'|'max'|'min')."""
    keys = names(keys)
    d = df.withColumn("_chunk", F.floor(F.col(pos).cast("bigint") / size))
    totals = d.groupBy(*keys, "_chunk").agg(
        *[_AGG[how](col(c)).alias(f"_tot_{n}") for n, (c, how) in outs.items()])
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*keys, "_chunk", *[
        _AGG[how](f"_tot_{n}").over(earlier).alias(f"_base_{n}") for n, (_, how) in outs.items()])
    stop = -1 if exclusive else 0
    local = W.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(W.unboundedPreceding, stop)
    d = d.withColumns({f"_loc_{n}": _AGG[how](col(c)).over(local) for n, (c, how) in outs.items()})
    d = join_rows(d, base, keys + ["_chunk"], "left")
    for n, (_, how) in outs.items():
        b, l = F.col(f"_base_{n}"), F.col(f"_loc_{n}")
        if how == "sum":
            d = d.withColumn(n, F.coalesce(b, F.lit(0)) + F.coalesce(l, F.lit(0)))
        else:
            d = d.withColumn(n, (F.greatest if how == "max" else F.least)(b, l))
    return d.drop("_chunk", *[f"_base_{n}" for n in outs], *[f"_loc_{n}" for n in outs])


def join_rows(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the data, by a merge.

    The size the optimizer assumes for a side leaves out what an explode above its last shuffle adds (replicates, draws,
    blocks), so it would send many times the broadcast threshold through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def dense_position(df: DataFrame, keys, order, bucket: Column, out: str = "t") -> DataFrame:
    """1-based row number per key in `order`, without ever holding a key in one task.

    `bucket` must be non-decreasing along `order` (an hour, an id range, the leading bits of a
    hash): rows are numbered inside (key, bucket) and shifted by the counts of earlier buckets.
    """
    keys = names(keys)
    order = [col(o) for o in (order if isinstance(order, (list, tuple)) else [order])]
    d = df.withColumn("_b", bucket)
    counts = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    rn = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order))
    return (join_rows(d.withColumn("_rn", rn), base, keys + ["_b"])
            .withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint"))
            .drop("_b", "_rn", "_off"))


def hash_bucket(u, rows_hint: int = 1024) -> Column:
    """Bucket for `dense_position` when ordering by a uniform draw: equal sized by construction."""
    return F.floor(col(u) * float(rows_hint))


def value_cuts(distinct: DataFrame, keys, value: str, cells: int = 64) -> DataFrame:
    """(keys, _cuts): ascending cut values per key, from a mergeable sketch of the distinct values."""
    at = F.array(*[F.lit(i / cells) for i in range(cells + 1)])
    return distinct.groupBy(*names(keys)).agg(F.percentile_approx(value, at, 20 * cells).alias("_cuts"))


def value_bucket(x, cuts="_cuts", parts: int = 64) -> Column:
    """Monotone bucket of x: the cut cell it falls in, divided into equal-width parts.

    Cells hold about equally many distinct values whatever the distribution, so an outlier or a long
    tail does not push the rest into one bucket.
    """
    x, cuts = col(x), col(cuts)
    cell = F.size(F.filter(cuts, lambda c: c <= x))
    lo, hi = F.get(cuts, cell - 1), F.get(cuts, cell)
    part = F.floor((x - lo) / F.nullif((hi - lo).cast("double"), F.lit(0.0)) * float(parts))
    return cell.cast("bigint") * parts + F.coalesce(F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1)), F.lit(0))


def value_ranks(df: DataFrame, keys, value: str, cells: int = 64) -> DataFrame:
    """(keys, value, n_at, below, total): exact rank information per distinct value.

    Rows are first collapsed to distinct values (map-side combine takes the ties), then values
    are cut into buckets of similar size; only bucket totals are scanned per key.
    """
    keys = names(keys)
    vc = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_at"))
    d = vc.join(value_cuts(vc, keys, value, cells), keys).withColumn("_b", value_bucket(value)).drop("_cuts")
    tot = d.groupBy(*keys, "_b").agg(F.sum("n_at").alias("_n"))
    w = W.partitionBy(*keys)
    earlier = w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = tot.select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
                      F.sum("_n").over(w).alias("total"))
    local = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (d.withColumn("_in", F.coalesce(F.sum("n_at").over(local), F.lit(0)))
            .join(base, keys + ["_b"])
            .withColumn("below", F.col("_off") + F.col("_in"))
            .select(*keys, value, "n_at", "below", "total"))


def rank_quantiles(df: DataFrame, keys, value: str, picks: dict, cells: int = 64) -> DataFrame:
    """Exact order statistics per key.  picks: name -> f(total) giving the 0-based index
    (possibly fractional: then the two neighbours are interpolated linearly)."""
    keys = names(keys)
    r = value_ranks(df, keys, value, cells)
    aggs = []
    for n, f in picks.items():
        at = f(F.col("total")).cast("double")
        lo, hi = F.floor(at), F.ceil(at)

        def holds(i):
            return (F.col("below") <= i) & (i < F.col("below") + F.col("n_at"))
        aggs += [F.max(F.when(holds(lo), F.col(value))).alias(f"_{n}_lo"),
                 F.max(F.when(holds(hi), F.col(value))).alias(f"_{n}_hi"),
                 F.max(at - lo).alias(f"_{n}_w")]
    g = r.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n)
        for n in picks])


def spread(df: DataFrame, *cols, rows: int = 0, most: int = 4096) -> DataFrame:
    """Rows dealt over all shuffle partitions: for little data ahead of much work, which sizes in bytes do not show.

    `rows` says how many there are, if a task's memory grows with them: there are then as many partitions as leave a task about `most`.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)), *cols)


def replicate(df: DataFrame, n: int, name: str = "rep", start: int = 0) -> DataFrame:
    """Attach a replicate key 0..n-1 row-locally (no join, no shuffle)."""
    return df.withColumn(name, F.explode(F.sequence(
        F.lit(start).cast("bigint"), F.lit(start + n - 1).cast("bigint"))))


def grouper():
    """The function `grouped(batch, keys)`, which goes to the workers by value."""
    def grouped(batch, keys: int):
        """In a task: (order, starts) of an Arrow batch, the order that puts rows of equal first `keys` columns together and where each group starts in it."""
        group = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns[:keys]:
            d = c.dictionary_encode(null_encoding="encode")
            group = np.unique(group * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        return order, np.flatnonzero(np.diff(group[order], prepend=-1))
    return grouped


SMALL_ROWS = 100_000


def join_small(df: DataFrame, small: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
    """Join against a side whose row count is known from plan parameters: broadcast it while it is
    small, otherwise leave the choice of strategy to the optimizer."""
    return df.join(F.broadcast(small) if rows <= SMALL_ROWS else small, on, how)
