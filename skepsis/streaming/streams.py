"""Streaming twins of the log and feature operators.

Each function maps a streaming DataFrame to a streaming DataFrame; state is keyed, bounded by a
watermark or by one row per key, and late rows go to a reject stream instead of vanishing.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scale import join_small
from ..sources.files import parse_catalogue


def running_best(log: DataFrame, key: str = "run_id", id: str = "candidate_id", score: str = "score") -> DataFrame:
    """A NEW_BEST row whenever a key's best score improves in id order, batch after batch.

    State is the best score of the key.  A row that does not top the rows of its chunk with smaller ids can't be a new best,
    so only each chunk's running maxima are held until the batch's last chunk, and then put in order.
    """
    schema = f"{key} string, {id} bigint, {score} double, previous double"

    def update(k, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        tops = []
        for pdf in chunks:
            pdf = pdf.dropna(subset=[score]).sort_values(id, kind="stable")
            tops.append(pdf[pdf[score] > pdf[score].cummax().shift(fill_value=float("-inf") if best is None else best)])
        out = []
        if tops:
            pdf = pd.concat(tops).sort_values(id, kind="stable")
            for i, s in zip(pdf[id], pdf[score]):
                if best is None or s > best:
                    out.append((k[0], int(i), float(s), best))
                    best = float(s)
        if out:
            yield pd.DataFrame(out, columns=[key, id, score, "previous"])
        if best is not None:
            state.update((best,))
    return log.select(key, id, score).groupBy(key).applyInPandasWithState(
        update, schema, "best double", "append", GroupStateTimeout.NoTimeout)


def ordered_commit(log: DataFrame, ts: str = "ts", delay: str = "1 day", keys=("run_id", "step", "candidate_id")) -> DataFrame:
    """First occurrence of every (run, step, candidate) within the watermark."""
    return log.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def split_late(log: DataFrame, key: str = "run_id", step: str = "step", id: str = "candidate_id") -> DataFrame:
    """Rows with verdict 'accepted' or 'late': a step below the last step of an earlier batch is late.

    State is one number per key; within a batch all steps above it are accepted.
    """
    schema = f"{key} string, {step} bigint, {id} bigint, verdict string"

    def update(k, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        top = last
        for pdf in chunks:
            late = pdf[step] <= last if last is not None else pd.Series(False, index=pdf.index)
            hi = int(pdf[step].max())
            top = hi if top is None else max(top, hi)
            yield pd.DataFrame({key: k[0], step: pdf[step], id: pdf[id], "verdict": late.map({True: "late", False: "accepted"})})
        state.update((top,))
    return log.select(key, step, id).groupBy(key).applyInPandasWithState(
        update, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def window_features(events: DataFrame, key: str, ts: str = "ts", v: str = "v", size: str = "1 day", slide: str | None = None,
                    delay: str = "1 day") -> DataFrame:
    """Count, mean and variance per key and window, emitted when the watermark passes."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withWatermark(ts, delay).groupBy(w.alias("w"), key).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.min(v).alias("min"), F.max(v).alias("max"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "var", "min", "max")


def score(features: DataFrame, model: DataFrame, names: list[str], labels: list[str], sample: str = "sample_id") -> DataFrame:
    """Mean-difference label of wide feature rows against a frozen model table.

    The model is packed into one static row per label, so no state is kept.
    """
    keep = F.col("name").isin(names)
    packed = model.filter(keep).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("mu", "sd", "w", "b")))).alias("_m"))
    # every row meets each label by an equi-join; the model side has one row per label
    s = features.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    s = join_small(s, packed, "label", len(labels))
    total = None
    for n in names:
        m = F.col("_m")[n]
        t = (F.col(n) - m["mu"]) / m["sd"] * m["w"] + m["b"]
        total = t if total is None else total + t
    return s.select(sample, "label", total.alias("score"))


def catalogue(lines: DataFrame, delimiter: str, header: list[str] | None, energy_cut: float | None = None) -> DataFrame:
    """Catalogue rules on arriving text lines; column positions come from the agreed header."""
    out = parse_catalogue(lines, delimiter, header)
    return out if energy_cut is None else out.filter(F.col("energy").isNull() | (F.col("energy") >= energy_cut))


def runs(values: DataFrame, key: str, t: str = "t", q: str = "q", ts: str = "ts", max_idle_s: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """Runs of equal consecutive values, each emitted once: when the next value differs, or when the watermark passes
    the run's last `ts` by `max_idle_s` seconds.

    The open run is the state.  Positions must arrive in order across batches; a batch's own rows are put in order first.
    """
    schema = f"{key} string, {q} bigint, start bigint, length bigint"

    def update(k, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cur = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((k[0], *cur[:3]))
            state.remove()
        else:
            # arrays: a frame's own grouping costs milliseconds a key, and keys are many
            at, v, ms = (np.concatenate(x) for x in zip(*[[c[x].to_numpy() for x in (t, q, "_ms")] for c in chunks]))
            order = np.argsort(at, kind="stable")
            at, v, ms = at[order], v[order], ms[order]
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            for v, st, n, ms in zip(v[first], at[first], np.diff(first, append=len(at)), np.maximum.reduceat(ms, first)):
                if cur is not None and cur[0] == v:
                    cur = (cur[0], cur[1], cur[2] + int(n), int(ms))
                else:
                    if cur is not None:
                        out.append((k[0], *cur[:3]))
                    cur = (int(v), int(st), int(n), int(ms))
            state.update(cur)
            state.setTimeoutTimestamp(max(cur[3] + 1000 * max_idle_s, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, q, "start", "length"])
    rows = values.withWatermark(ts, delay).select(F.col(key).cast("string").alias(key), t, q, ts, F.unix_millis(ts).alias("_ms"))
    return rows.groupBy(key).applyInPandasWithState(
        update, schema, "q bigint, start bigint, length bigint, ms bigint", "append", GroupStateTimeout.EventTimeTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over everything available into a Parquet table (exactly once per batch)."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
