"""Joins and pairings: reference against alternative, event against baseline, rank against rank."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import col
from .scale import CHUNK, dense_position, materialize, names, with_local


def pair_join(features: DataFrame, ref: Column, alt: Column, on=("grp", "seed", "name"),
              unit: str = "unit", value: str = "value") -> DataFrame:
    """Alternatives with the reference of the same key; keys without a reference drop out."""
    on = list(on)
    r = features.filter(ref).select(*on, F.col(value).alias("ref"))
    a = features.filter(alt).select(*on, unit, F.col(value).alias("alt"))
    return a.join(r, on)


def feature_diff(features: DataFrame, ref: Column, alt: Column, pair=("grp", "seed"), unit: str = "unit",
                 name: str = "name", value: str = "value") -> DataFrame:
    """alternative - reference per feature; a feature missing on one side counts as 0.

    A pair exists when both members do.  One shuffle by pair and feature: both members of a
    feature meet in one aggregate, not in an outer join.
    """
    pair = list(pair)
    members = features.groupBy(*pair, unit).agg(F.count(F.lit(1)).alias("_n"))
    alts = members.filter(alt).select(*pair, unit).join(members.filter(ref).select(*pair), pair, "left_semi")
    r = features.filter(ref).select(*pair, name, F.col(value).alias("_r"))
    # reference features fan out to the alternatives of their pair, then meet them by name
    left = alts.join(r, pair).select(*pair, unit, name, (-F.col("_r")).alias("_d"))
    right = features.filter(alt).join(alts, pair + [unit], "left_semi").select(
        *pair, unit, name, F.col(value).alias("_d"))
    return left.unionByName(right).groupBy(*pair, unit, name).agg(F.sum("_d").alias("d"))


def mirror_augment(diffs: DataFrame, d: str = "d") -> DataFrame:
    """(d, 'A') and (-d, 'B'), row-locally."""
    arms = F.array(F.struct(F.lit("A").alias("label"), F.col(d).alias("value")),
                   F.struct(F.lit("B").alias("label"), (-F.col(d)).alias("value")))
    return diffs.withColumn("_m", F.explode(arms)).select(*[c for c in diffs.columns if c != d], "_m.label", "_m.value")


def band_mean(series: DataFrame, key: str, radius: int, where: Column, value: str = "v",
              size: int = CHUNK, out: str = "base") -> DataFrame:
    """Mean of the rows matching `where` within +-radius of each position (NULL when there are none)."""
    s = series.withColumn("_w", F.when(where, F.col(value)))
    d = with_local(s, key, "t", {out: lambda w: F.avg("_w").over(w.rangeBetween(-radius, radius))},
                   before=radius, after=radius, size=size)
    return d.drop("_w")


def band_baseline(series: DataFrame, key: str, radius: int = 10, value: str = "v", flag: str = "flag",
                  active: Column | None = None, size: int = CHUNK) -> DataFrame:
    """Event rows minus the mean of active non-event rows around them; events without any drop out."""
    live = F.lit(True) if active is None else active
    d = band_mean(series, key, radius, (F.col(flag) == 0) & live, value, size)
    return d.filter((F.col(flag) == 1) & live & F.col("base").isNotNull()).withColumn(
        "difference", F.col(value) - F.col("base"))


def event_response(series: DataFrame, key: str, radius: int = 10, value: str = "v", flag: str = "flag",
                   size: int = CHUNK) -> DataFrame:
    """Mean response of event and non-event rows to their local baseline, and the difference."""
    d = band_mean(series, key, radius, F.col(flag) == 0, value, size).filter("base is not null")
    r = F.col(value) - F.col("base")
    e, n = F.when(F.col(flag) == 1, r), F.when(F.col(flag) == 0, r)
    return d.groupBy(key).agg(F.count(e).alias("n_event"), F.count(n).alias("n_other"), F.avg(e).alias("event_mean"),
                              F.avg(n).alias("other_mean"), (F.avg(e) - F.avg(n)).alias("delta"))


# -- matched temporal controls ----------------------------------------------------------------------

REASONS = ("missing_baseline", "extinct", "zero_magnitude")


def baseline_adjust(trace: DataFrame, base: DataFrame, key: str = "series_id") -> DataFrame:
    """Forced minus baseline at the same position with the exclusion reason (NULL when usable)."""
    b = base.select(key, "t", F.col("active").alias("_ba"), F.col("mean").alias("_bm"), F.col("std").alias("_bs"),
                    F.lit(True).alias("_has"))
    j = trace.join(b, [key, "t"], "left")
    zero = ((F.col("mean") == 0) & (F.col("std") == 0)) | ((F.col("_bm") == 0) & (F.col("_bs") == 0))
    why = (F.when(F.col("_has").isNull(), "missing_baseline")
           .when((F.col("active") == 0) | (F.col("_ba") == 0), "extinct").when(zero, "zero_magnitude"))
    return j.withColumn("reason", why).withColumn(
        "adjusted", F.when(why.isNull(), F.col("mean") - F.col("_bm"))).drop("_ba", "_bm", "_bs", "_has")


def responses(adjusted: DataFrame, key: str = "series_id", size: int = CHUNK) -> DataFrame:
    """Usable rows whose predecessor is usable too: previous flag, activity bin, detrended value."""
    ok = F.col("adjusted").isNotNull()
    d = with_local(adjusted, key, "t", {
        "_pf": lambda w: F.max(F.when(ok, F.col("flag"))).over(w.rangeBetween(-1, -1)),
        "_m": lambda w: F.avg("adjusted").over(w.rangeBetween(-10, 10))}, before=10, after=10, size=size)
    d = d.filter(ok)
    return d.select(key, "t", F.col("_pf").alias("after_event"), F.floor(F.col("active") * 10).alias("bin"),
                    (F.col("adjusted") - F.col("_m")).alias("detrended"))


def match_chunks(resp: DataFrame, key: str = "series_id", radius: int = 10, size: int = CHUNK) -> DataFrame:
    """(key, bin, chunk, ts, cs): the events of a run of `size` positions and the controls they can reach, both ascending.

    A control near a border is copied next door.  A row holds at most size + 2 * radius positions, whatever a series holds.
    """
    chunk = F.floor(F.col("t") / size).cast("bigint")
    inside = F.pmod(F.col("t"), F.lit(size))
    homes = F.when(F.col("after_event") == 1, F.array(chunk)).otherwise(F.array_compact(F.array(
        chunk, F.when(inside < radius, chunk - 1), F.when(inside >= size - radius, chunk + 1))))
    d = resp.filter("after_event in (0, 1)").select(key, "bin", "t", "after_event", F.explode(homes).alias("chunk"))
    return d.groupBy(key, "bin", "chunk").agg(
        F.array_sort(F.collect_list(F.when(F.col("after_event") == 1, F.col("t")))).alias("ts"),
        F.array_sort(F.collect_list(F.when(F.col("after_event") == 0, F.col("t")))).alias("cs")).filter((F.size("ts") > 0) & (F.size("cs") > 0))


def _match(radius: int, size: int):
    """The sequential rule inside one chunk, from the controls that earlier chunks have used."""
    @F.pandas_udf("struct<ts:array<bigint>,cs:array<bigint>,used:array<bigint>>")
    def match(chunk: pd.Series, ts: pd.Series, cs: pd.Series, entry: pd.Series) -> pd.DataFrame:
        out = []
        for k, events, controls, taken in zip(chunk.tolist(), ts, cs, entry):
            base, end = k * size - radius, (k + 1) * size
            free = bytearray(size + 4 * radius + 1)
            for c in controls.tolist():
                free[c - base + radius] = 1
            for c in taken.tolist():
                free[c - base + radius] = 0
            got, used = [], []
            for t in events.tolist():
                at = t - base + radius
                lo, hi = free.rfind(1, at - radius, at), free.find(1, at + 1, at + radius + 1)
                if lo < 0 and hi < 0:
                    continue
                pick = lo if hi < 0 or (lo >= 0 and at - lo <= hi - at) else hi
                free[pick] = 0
                got.append(t)
                used.append(pick + base - radius)
            out.append((got, used, sorted(c for c in used if c >= end - radius)))
        return pd.DataFrame(out, columns=["ts", "cs", "used"])
    return match


def greedy_match(resp: DataFrame, key: str = "series_id", radius: int = 10, size: int = CHUNK) -> DataFrame:
    """Chronological one-to-one matching: every event takes the nearest unused control of its bin within +-radius, the earlier
    control on ties.  (key, bin, t, control_t), the same as one pass over each series gives.

    Every chunk of positions is matched as if nothing before it had used a control.  What a chunk does to the next one is only
    which controls within `radius` of their border it has used; chunks for which that was assumed wrongly are matched again,
    until nothing changes.  Each round settles at least one more chunk of every series, and greedy choices forget a
    border within a few gaps, so a few rounds are enough however dense the events are.
    """
    size = max(size, 2 * radius)            # a chunk's used controls reach no further than the next chunk
    match = _match(radius, size)
    keys = [key, "bin", "chunk"]
    none = F.array().cast("array<bigint>")

    def matched(c: DataFrame) -> DataFrame:
        return c.withColumn("_m", match("chunk", "ts", "cs", "entry")).select(*keys, "ts", "cs", "entry", "_m")
    state = materialize(matched(match_chunks(resp, key, radius, size).withColumn("entry", none)))
    while True:
        before = state.filter(F.size("_m.used") > 0).select(key, "bin", (F.col("chunk") + 1).alias("chunk"), F.col("_m.used").alias("_in"))
        seen = state.select(*keys, "entry").join(before, keys, "left").withColumn("_in", F.coalesce("_in", none))
        stale = seen.filter(F.col("_in") != F.col("entry")).select(*keys, "_in")
        if stale.isEmpty():
            break
        stale = materialize(stale)
        again = matched(state.join(stale, keys).withColumn("entry", F.col("_in")))
        state = materialize(state.join(stale, keys, "left_anti").unionByName(again))
    p = F.explode(F.arrays_zip(F.col("_m.ts").alias("t"), F.col("_m.cs").alias("c"))).alias("p")
    return state.select(key, "bin", p).select(key, "bin", F.col("p.t").alias("t"), F.col("p.c").alias("control_t"))


def exclusions(adjusted: DataFrame, key: str = "series_id", size: int = CHUNK) -> DataFrame:
    """(key, missing_baseline, extinct, zero_magnitude, unobservable_predecessor, usable, eligible): why rows take no part.

    `usable` rows have a usable predecessor; `eligible` ones follow an event.
    """
    ok = F.col("adjusted").isNotNull()
    d = with_local(adjusted, key, "t", {"_pf": lambda w: F.max(F.when(ok, F.col("flag"))).over(w.rangeBetween(-1, -1))}, before=1, size=size)
    why = [F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in REASONS]
    return d.groupBy(key).agg(*why, F.count(F.when(ok & F.col("_pf").isNull(), 1)).alias("unobservable_predecessor"),
                              F.count(F.when(ok & F.col("_pf").isNotNull(), 1)).alias("usable"), F.count(F.when(ok & (F.col("_pf") == 1), 1)).alias("eligible"))


def matched_differences(resp: DataFrame, key: str = "series_id", radius: int = 10, size: int = CHUNK) -> DataFrame:
    m = greedy_match(resp, key, radius, size)
    d = resp.select(key, "t", "detrended")
    c = d.select(key, F.col("t").alias("control_t"), F.col("detrended").alias("_c"))
    return m.join(d, [key, "t"]).join(c, [key, "control_t"]).select(
        key, "bin", "t", "control_t", (F.col("detrended") - F.col("_c")).alias("difference"))


def rank_join(pairs: DataFrame, key="pair_id", source: str = "f", target: str = "t", pos: str = "idx",
              value_bucket=None) -> DataFrame:
    """Source rank i receives the i-th smallest target value, ties by position.

    Fields are bounded groups, so the default ranks with one window.  For long groups pass
    `value_bucket(column)`, a coarse monotone bucket, and ranks come from per-bucket counts.
    """
    from pyspark.sql import Window as W
    keys = names(key)

    def ranked(v):
        d = pairs.select(*keys, pos, F.col(v).alias("_v"))
        if value_bucket is None:
            return d.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_v", pos)))
        return dense_position(d, keys, ["_v", pos], value_bucket(F.col("_v")), out="_r")
    a = ranked(source).select(*keys, "_r", pos, F.col("_v").alias("source"))
    b = ranked(target).select(*keys, "_r", F.col("_v").alias("matched"))
    return a.join(b, keys + ["_r"]).select(*keys, pos, "source", "matched")


# -- joins of logs ------------------------------------------------------------------------------------

def result_join(candidates: DataFrame, results: DataFrame) -> DataFrame:
    return candidates.join(results, "candidate_id")


def unseen_candidates(candidates: DataFrame, seen: DataFrame, x: str = "cr", y: str = "ci", decimals: int = 6) -> DataFrame:
    """Candidates whose rounded point is not in the log."""
    k = float(10 ** decimals)
    key = lambda c: F.floor(F.col(c) * k + 0.5)
    s = seen.select(key(x).alias("_x"), key(y).alias("_y")).distinct()
    return candidates.withColumns({"_x": key(x), "_y": key(y)}).join(s, ["_x", "_y"], "left_anti").drop("_x", "_y")


def allowlist_train(samples: DataFrame, allow: DataFrame, keys=("grp", "split"), expected: str = "label") -> DataFrame:
    """Rows on the allow list only.  A label that contradicts the list, or a list key given twice,
    stops the job instead of reaching a fit."""
    keys = list(keys)
    a = allow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(expected).alias("_e"))
    j = samples.join(a, keys)
    bad = F.when(F.col("_n") > 1, F.lit("allow list key occurs twice")).when(
        F.col("_e").isNotNull() & (F.col("_e") != F.col(expected)), F.lit("label contradicts the allow list"))
    return j.withColumn(expected, F.when(bad.isNull(), F.col(expected)).otherwise(F.raise_error(bad).cast("string"))).drop("_n", "_e")


def evals_with_run(evals: DataFrame, runs: DataFrame, on: str = "run_id") -> DataFrame:
    return evals.join(runs, on)


def flat_json(rows: DataFrame, layers: list[str], columns: dict) -> DataFrame:
    """Overlay JSON objects of scalars and then plain columns into one map, later entries winning."""
    spark = rows.sparkSession
    out = None
    for c in layers:
        m = F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
        out = m if out is None else _overlay(out, m)
    plain = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), col(v).cast("string"))])
    return rows.withColumn("flat", plain if out is None else _overlay(out, plain))


def _overlay(a: Column, b: Column) -> Column:
    """Union of two maps, b winning, independent of the session's duplicate-key policy."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def cross_params(df: DataFrame, values: list, name: str = "param") -> DataFrame:
    """Every row under every parameter value: a literal array is exploded in place."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
