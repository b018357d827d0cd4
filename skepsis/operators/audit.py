"""Integrity of logs and samples: duplicates, gaps, reconciliation, replays, hashes, ranges."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import col
from .scale import names


def duplicate_groups(df: DataFrame, keys, id: str, rounding: dict | None = None) -> DataFrame:
    """Groups of equal (optionally rounded) keys with more than one row: size and id range.
    The members are available as rows from `duplicate_members`; they are never packed into one row."""
    ks = _rounded(df, keys, rounding)
    g = ks.groupBy(*names(keys)).agg(F.count(F.lit(1)).alias("n"), F.min(id).alias("first_id"), F.max(id).alias("last_id"))
    return g.filter("n > 1")


def duplicate_summary(df: DataFrame, keys, rounding: dict | None = None) -> DataFrame:
    g = _rounded(df, keys, rounding).groupBy(*names(keys)).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("unique_keys"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_groups"),
                 F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"))


def duplicate_members(df: DataFrame, keys, id: str, rounding: dict | None = None) -> DataFrame:
    r = _rounded(df, keys, rounding)
    g = r.groupBy(*names(keys)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return r.join(g, names(keys), "left_semi").select(*names(keys), id)


def _rounded(df, keys, rounding):
    out = df
    for c, places in (rounding or {}).items():
        k = float(10 ** places)
        out = out.withColumn(c, F.floor(F.col(c) * k + 0.5) / k)
    return out


def cross_split_duplicates(grids: DataFrame, split: str = "split", id: str = "sample_id") -> DataFrame:
    """Contents that occur in more than one split."""
    h = grids.select(split, id, array_hash("vals").alias("content"))
    return h.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(split).alias("splits"), F.min(id).alias("first_id")).filter("splits > 1")


def missing_id_ranges(ids: DataFrame, id: str, low: int, high: DataFrame | int, by=(), bucket: int = 1 << 16) -> DataFrame:
    """Absent ids of [low, high] as ranges.  `high` is a number, or a frame of one row whose only column holds it.

    A gap is the distance from one id to the next, so only neighbours are compared.  Ids are cut
    into buckets; each bucket also sees the last id before it, taken from per-bucket maxima.
    """
    by = names(by)
    d = ids.select(*by, id).filter(F.col(id) >= low).distinct()
    hi = high.scalar() if isinstance(high, DataFrame) else F.lit(high)
    d = d.filter(F.col(id) <= hi).withColumn("_b", F.floor(F.col(id) / bucket))
    top = d.groupBy(*by, "_b").agg(F.max(id).alias("_m"))
    prev = top.select(*by, "_b", F.lag("_m").over(W.partitionBy(*(by or [F.lit(0)])).orderBy("_b")).alias("_before"))
    local = F.lag(id).over(W.partitionBy(*by, "_b").orderBy(id))
    d = d.withColumn("_p", local).join(prev, by + ["_b"])
    p = F.coalesce("_p", "_before", F.lit(low - 1))
    inner = d.filter(F.col(id) - p > 1).select(*by, (p + 1).alias("first_missing"), (F.col(id) - 1).alias("last_missing"))
    ends = (d.groupBy(*by) if by else d).agg(F.max(id).alias("_m"))
    tail = ends.filter(F.col("_m") < hi).select(*by, (F.col("_m") + 1).alias("first_missing"), hi.cast("bigint").alias("last_missing"))
    return inner.unionByName(tail)


def reconcile(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, side, cell, left, right): cells that differ, and keys found on one side only.
    NULL equals the empty string."""
    txt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    l = a.select(key, F.lit(True).alias("_l"), *[txt(c).alias(f"l_{c}") for c in columns])
    r = b.select(key, F.lit(True).alias("_r"), *[txt(c).alias(f"r_{c}") for c in columns])
    j = l.join(r, key, "full")
    only = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
    cells = F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"l_{c}").alias("left"), F.col(f"r_{c}").alias("right")) for c in columns])
    whole = F.array(F.struct(F.lit("*").alias("cell"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right")))
    diff = F.when(only.isNotNull(), whole).otherwise(F.filter(cells, lambda s: s["left"] != s["right"]))
    return j.select(key, F.coalesce(only, F.lit("both")).alias("side"), F.explode(diff).alias("d")).select(key, "side", "d.cell", "d.left", "d.right")


def reconcile_summary(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    same = None
    for c in columns:
        e = F.coalesce(F.col(f"l_{c}").cast("string"), F.lit("")) == F.coalesce(F.col(f"r_{c}").cast("string"), F.lit(""))
        same = e if same is None else same & e
    l = a.select(key, F.lit(True).alias("_l"), *[F.col(c).alias(f"l_{c}") for c in columns])
    r = b.select(key, F.lit(True).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return l.join(r, key, "full").agg(
        F.count(F.when(both & same, 1)).alias("exact_rows"), F.count(F.when(both & ~same, 1)).alias("different_rows"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("_l").isNull(), 1)).alias("right_only"))


def replay_compare(stored: DataFrame, recomputed: DataFrame, key, metrics: list[str]) -> DataFrame:
    """Per metric: compared rows, exact matches, largest absolute difference."""
    k = names(key)
    j = stored.select(*k, *[F.col(m).alias(f"_s_{m}") for m in metrics]).join(
        recomputed.select(*k, *[F.col(m).alias(f"_r_{m}") for m in metrics]), k)
    arms = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_s_{m}").alias("s"), F.col(f"_r_{m}").alias("r")) for m in metrics])
    d = j.select(F.explode(arms).alias("_a")).select("_a.*")
    return d.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("s").eqNullSafe(F.col("r")), 1)).alias("exact"),
                                   F.max(F.abs(F.col("s") - F.col("r"))).alias("max_abs"))


def score_identity(scored: DataFrame, weights: dict, score: str = "score") -> DataFrame:
    total = None
    for c, w in weights.items():
        t = F.col(c) * w
        total = t if total is None else total + t
    return scored.agg(F.max(F.abs(F.col(score) - total)).alias("max_abs"), F.count(score).alias("n"))


def null_block_audit(candidates: DataFrame, blocks: DataFrame, block: str, score: str = "score", id: str = "candidate_id") -> DataFrame:
    """Stored block maximum against the recomputed one, and how many candidates attain it."""
    m = candidates.groupBy(block, score).agg(F.count(F.lit(1)).alias("_n"), F.min(id).alias("_id"))
    best = m.groupBy(block).agg(F.max(F.struct(F.col(score), F.col("_n"), F.col("_id"))).alias("_b"), F.sum("_n").alias("candidates"))
    return best.join(blocks.select(block, F.col("stat").alias("stored_max")), block).select(
        block, "candidates", F.col(f"_b.{score}").alias("computed_max"), "stored_max", F.col("_b._n").alias("ties"),
        F.col("_b._id").alias("candidate_id"), F.col(f"_b.{score}").eqNullSafe(F.col("stored_max")).alias("matches"))


def classify_role(log: DataFrame, rules: list[tuple[str, Column]], default: str, out: str = "audit_role") -> DataFrame:
    """First matching rule names the role of a row."""
    e = None
    for role, cond in rules:
        e = F.when(cond, role) if e is None else e.when(cond, role)
    return log.withColumn(out, e.otherwise(default))


def quality_counts(log: DataFrame, score: str = "score", seed: str | None = None, status: str | None = None) -> DataFrame:
    s = col(score)
    bad = F.isnan(s) | (F.abs(s) == float("inf"))
    aggs = [F.count(F.lit(1)).alias("n"), F.count(F.when(s == 0, 1)).alias("zero"), F.count(F.when(s.isNull(), 1)).alias("missing"),
            F.count(F.when(bad, 1)).alias("non_finite")]
    if seed:
        aggs.append(F.count(F.when(F.col(seed).isNull(), 1)).alias("missing_seed"))
    if status:
        aggs.append(F.count(F.when(F.col(status) != "OK", 1)).alias("failed"))
    return log.agg(*aggs)


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, relation: str) -> DataFrame:
    p = parent.select(F.col(pk).alias(fk)).distinct()
    return child.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti").select(F.lit(relation).alias("relation"), F.col(fk).cast("string").alias("key"))


def array_hash(vals) -> Column:
    return F.sha2(F.concat_ws(",", F.transform(col(vals), lambda x: x.cast("string"))), 256)


def content_hash(series: DataFrame, key, v: str = "v", chunk: int = 4096, places: int = 6, levels: int = 2) -> DataFrame:
    """SHA-256 of a series in position order as a hash tree: chunks of `chunk` values, then chunks of
    `chunk` hashes, so no group holds more than `chunk` entries below the root."""
    k = names(key)
    val = F.floor(F.col(v) * float(10 ** places) + 0.5).cast("string")
    d = series.select(*k, F.col("t").alias("_c"), val.alias("_h"))
    joined = F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_c", "_h"))), lambda s: s["_h"])), 256)
    for _ in range(levels):
        d = d.groupBy(*k, F.floor(F.col("_c") / chunk).alias("_up")).agg(joined.alias("_h")).withColumnRenamed("_up", "_c")
    return d.groupBy(*k).agg(joined.alias("content"))


def set_hash(table: DataFrame, columns: list[str], by=()) -> DataFrame:
    """(by, rows, hash_a, hash_b): order-free hash of a multiset of rows, summed modulo 2^60 from two parts of each row's MD5.

    Sums of two tables add up to that of their union, and a deleted row's is subtracted, so it is kept up to date
    without reading the table again.  NULL differs from the empty text.  One map-side combined aggregation.
    """
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    digest = F.md5(F.concat_ws("|", *[cell(c) for c in columns]))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(25,0)")
    sums = lambda at: F.pmod(F.sum(part(at)), F.lit(2 ** 60).cast("decimal(35,0)")).cast("bigint")
    return table.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("rows"), sums(1).alias("hash_a"), sums(17).alias("hash_b"))


def collisions(hashes: DataFrame, name: str = "name") -> DataFrame:
    """Names that share their content with another name."""
    g = hashes.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first_name")).filter("n > 1")
    return hashes.join(g, "content").select(name, "first_name", "n")


def determinism_check(a: DataFrame, b: DataFrame, key, metrics: list[str], places: int = 12) -> DataFrame:
    """Rows whose rounded metrics differ between two runs, or that occur in one run only; multiset exact."""
    k = names(key)
    f = float(10 ** places)

    def tagged(df, s):
        return df.select(*k, *[F.floor(F.col(m) * f + 0.5).alias(m) for m in metrics], F.lit(s).alias("_s"))
    u = tagged(a, 1).unionByName(tagged(b, -1)).groupBy(*k, *metrics).agg(F.sum("_s").alias("balance"))
    return u.agg(F.count(F.when(F.col("balance") != 0, 1)).alias("differences"), F.count(F.lit(1)).alias("states"),
                 (F.count(F.when(F.col("balance") != 0, 1)) == 0).alias("deterministic"))


def feature_ranges(features: DataFrame, unit_bounded: list[str], non_negative: list[str], name: str = "name", value: str = "value") -> DataFrame:
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    a = features.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~finite, 1)).alias("non_finite"),
                                   F.count(F.when(v < 0, 1)).alias("negative"), F.count(F.when(v > 1 + 1e-9, 1)).alias("above_one"))
    ok = (F.col("non_finite") == 0) & (~F.col(name).isin(non_negative) | (F.col("negative") == 0)) & (
        ~F.col(name).isin(unit_bounded) | ((F.col("negative") == 0) & (F.col("above_one") == 0)))
    return a.withColumn("ok", ok)


def config_guard(stored: DataFrame, offered: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """Rows of the same id whose configuration differs from the stored one."""
    l = stored.select(id, *[F.col(c).cast("string").alias(f"l_{c}") for c in columns])
    r = offered.select(id, *[F.col(c).cast("string").alias(f"r_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"l_{c}").alias("stored"), F.col(f"r_{c}").alias("offered")) for c in columns])
    return l.join(r, id).select(id, F.explode(F.filter(cells, lambda s: ~s["stored"].eqNullSafe(s["offered"]))).alias("d")).select(
        id, "d.cell", "d.stored", "d.offered")
