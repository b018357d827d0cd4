"""Input views over the given tables, as DataFrames and as SQL text of the same meaning."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import degrade, fields, scale

W, H = 8, 8
UNITS = ("none", "float32", "q255", "q15", "lut16", "block4", "noise", "xor")


class Views:
    """Lazily built DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def grids(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("vals"))

    @cached_property
    def cells(self) -> DataFrame:
        return fields.explode_arrays(self.grids, W, H)

    @cached_property
    def pair_grids(self) -> DataFrame:
        """Each sample with its successor by id: an equi-join.  Every pair becomes many cells, so tasks get a bounded number of pairs."""
        n = self.table("embeddings").count()
        a = scale.spread(self.grids.select(F.col("sample_id").alias("pair_id"), F.col("vals").alias("f")), "pair_id", rows=n)
        b = scale.spread(self.grids.select((F.col("sample_id") - 1).alias("pair_id"), F.col("vals").alias("t")), "pair_id", rows=n)
        return a.join(b, "pair_id")

    @cached_property
    def pairs_cells(self) -> DataFrame:
        return fields.explode_pairs(self.pair_grids, W, H)

    @cached_property
    def frame_grids(self) -> DataFrame:
        e = self.table("embeddings").select(
            F.col("label").cast("bigint").alias("series_id"), "vec_id",
            F.col("embedding").cast("array<double>").alias("vals"))
        pos = scale.dense_position(e.select("series_id", "vec_id"), "series_id", "vec_id",
                                   F.floor(F.col("vec_id") / 256))
        return e.join(pos, ["series_id", "vec_id"]).select("series_id", "t", "vals")

    @cached_property
    def frames(self) -> DataFrame:
        return self.frame_grids.select("series_id", "t", F.posexplode("vals").alias("idx", "v"))

    def _positions(self, series: str) -> DataFrame:
        ev = self.table("events")
        hour = F.date_trunc("hour", F.col("ts"))
        return scale.dense_position(
            ev.select(F.col(series).alias("series_id"), "ts", "event_id", "value", "event_type"),
            "series_id", ["ts", "event_id"], hour)

    @cached_property
    def series(self) -> DataFrame:
        return self._positions("user_id").select(
            "series_id", "t", "ts", F.col("value").alias("v"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).cast("bigint").alias("flag"))

    @cached_property
    def type_series(self) -> DataFrame:
        return self._positions("event_type").select(
            "series_id", "t", "ts", F.col("value").alias("v"),
            F.when(F.col("value") > 100, 1).otherwise(0).cast("bigint").alias("flag"))

    @cached_property
    def sample_grids(self) -> DataFrame:
        """Arrays with their metadata, from one scan."""
        vid, lab = F.col("vec_id"), F.col("label")
        g = vid % 8
        return self.table("embeddings").select(
            vid.alias("sample_id"), F.concat(F.lit("g"), g.cast("string")).alias("grp"),
            F.concat(F.lit("u"), (lab % 5).cast("string")).alias("unit"),
            F.floor(vid / 8).alias("seed"),
            F.when(lab < 5, "low").otherwise("high").alias("label"),
            F.when(g <= 4, "train").when(g == 5, "validation").otherwise("holdout").alias("split"),
            F.col("embedding").cast("array<double>").alias("vals"))

    @cached_property
    def samples(self) -> DataFrame:
        return self.sample_grids.drop("vals")

    @cached_property
    def features(self) -> DataFrame:
        """Raw dimensions as features: the negative control."""
        return self.grids.select("sample_id", F.posexplode("vals").alias("d", "value")).select(
            "sample_id", F.concat(F.lit("d"), F.col("d").cast("string")).alias("name"), "value",
            F.concat(F.lit("f"), F.floor(F.col("d") / 16).cast("string")).alias("family"))

    @cached_property
    def unit_grids(self) -> DataFrame:
        """Every sample observed through every unit: the positive control.  Samples are few bytes for much work, so they are dealt over all tasks."""
        g = scale.spread(self.sample_grids, "sample_id")
        arms = F.array(*[F.struct(F.lit(u).alias("unit"), degrade.array_unit(
            u, F.col("vals"), F.col("sample_id"), W, H).alias("vals")) for u in UNITS])
        out = g.select("sample_id", "grp", "seed", "split", F.explode(arms).alias("arm")).select(
            "sample_id", "grp", "seed", "split", "arm.unit", "arm.vals")
        return out.withColumn("label", F.when(F.col("unit") == "none", "continuous")
                              .otherwise("computational"))

    @cached_property
    def unit_features(self) -> DataFrame:
        """Discreteness features of `unit_grids`, long, row-local (one array is one sample)."""
        return scale.materialize(degrade.discreteness_features(
            self.unit_grids, ["sample_id", "grp", "seed", "split", "unit", "label"]))

    @cached_property
    def doc_features(self) -> DataFrame:
        d = self.table("documents").join(self.table("labels"), "doc_id")
        n = F.length("text").cast("double")
        words = F.size(F.split("text", " ")).cast("double")
        digits = n - F.length(F.regexp_replace("text", "[0-9]", "")).cast("double")
        lines = (n - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).cast("double") + 1.0
        wide = d.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("grp"),
                        F.col("lang").alias("unit"),
                        F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"),
                        n.alias("length"), words.alias("words"),
                        (digits / F.greatest(n, F.lit(1.0))).alias("digit_share"), lines.alias("lines"))
        return wide.unpivot(["sample_id", "grp", "unit", "label"],
                            ["length", "words", "digit_share", "lines"], "name", "value")

    @cached_property
    def unit_pairs(self) -> DataFrame:
        """Supplier-year averages per return flag, alternatives A and R against reference N."""
        li = self.table("lineitem")
        g = (li.groupBy(F.col("l_suppkey").alias("grp"), F.year("l_shipdate").cast("bigint").alias("seed"),
                        F.col("l_returnflag").alias("unit"))
             .agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"),
                  F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")))
        return g.unpivot(["grp", "seed", "unit"], ["quantity", "price", "discount", "tax"],
                         "name", "value")

    @cached_property
    def unit_diffs(self) -> DataFrame:
        """Discreteness features of every unit minus the undegraded reference of the same sample."""
        from ..operators import pairing
        return pairing.feature_diff(self.unit_features, F.col("unit") == "none", F.col("unit") != "none")

    @cached_property
    def pair_diffs(self) -> DataFrame:
        """Supplier-year differences of return flags A and R against N: no signal is expected."""
        from ..operators import pairing
        return pairing.feature_diff(self.unit_pairs, F.col("unit") == "N", F.col("unit") != "N")

    @cached_property
    def trace(self) -> DataFrame:
        s = self.series.withColumn("hour", F.date_trunc("hour", F.col("ts")))
        n = s.groupBy("series_id", "hour").agg(F.count(F.lit(1)).alias("n"))
        top = n.groupBy("series_id").agg(F.max("n").alias("top"))
        return s.join(n.join(top, "series_id"), ["series_id", "hour"]).select(
            "series_id", "t", (F.col("n") / F.col("top")).alias("active"), F.col("v").alias("mean"),
            F.lit(0.0).alias("std"), "flag")

    @cached_property
    def trace_base(self) -> DataFrame:
        s = self.series.withColumn("hod", F.hour("ts"))
        h = s.groupBy("hod").agg((F.floor(F.avg("v") * 100.0 + 0.50013) / 100.0).alias("mean"))
        return s.join(h, "hod").select("series_id", "t", F.lit(1.0).alias("active"), "mean", F.lit(0.0).alias("std"))

    @cached_property
    def catalogue(self) -> DataFrame:
        e = self.table("embeddings")
        x = [F.col("embedding")[i].cast("double") for i in range(4)]
        n = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
        n = F.coalesce(F.nullif(n, F.lit(0.0)), F.lit(1.0))
        base = e.select(F.col("label").cast("bigint").alias("sky"), F.col("vec_id").alias("event_id"),
                        (x[0] / n).alias("ux"), (x[1] / n).alias("uy"), (x[2] / n).alias("uz"),
                        F.when(F.col("vec_id") % 17 != 0, F.abs(x[3]) * 1e20).alias("energy"))
        # sky -1 holds every event
        return base.withColumn("sky_id", F.explode(F.array(F.col("sky"), F.lit(-1).cast("bigint")))).drop("sky")

    @cached_property
    def responses(self) -> DataFrame:
        """Discounted revenue per supplier, year and line: flags A, R and N as three interventions A, B and C.

        mech 'additive' keeps the sums, 'snapped' rounds every response to 100.  ABC applies all at once, ABthenC adds C
        to the response of AB, and AB_again measures AB once more from the joint sum of its lines.
        """
        li = self.table("lineitem")
        rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        flag = F.col("l_returnflag")
        part = lambda *flags: F.sum(F.when(flag.isin(*flags), rev).otherwise(0.0))
        # rounding at cents removes the summation order from the data itself
        cents = lambda c: F.floor(c * 100.0 + 0.50013) / 100.0
        g = (li.filter(flag.isin("A", "R", "N"))
             .groupBy(F.col("l_suppkey").alias("world_id"), (F.year("l_shipdate") - 1995).cast("bigint").alias("t"),
                      F.col("l_linenumber").cast("bigint").alias("idx"))
             .agg(cents(part("A")).alias("A"), cents(part("R")).alias("B"), cents(part("N")).alias("C"), cents(part("A", "R")).alias("AB_again")))
        g = g.withColumns({"AB": F.col("A") + F.col("B"), "opposite": -F.col("A"), "ABC": F.col("A") + F.col("B") + F.col("C")})
        snap = lambda c: F.floor(c / 100.0 + 0.5) * 100.0
        arm = lambda mech, f: F.struct(F.lit(mech).alias("mech"), F.array(*[F.struct(F.lit(x).alias("role"), f(F.col(x)).alias("v")) for x in (
            "A", "B", "C", "AB", "AB_again", "opposite", "ABC")], F.struct(F.lit("ABthenC").alias("role"), f(f(F.col("AB")) + F.col("C")).alias("v"))).alias("r"))
        long = g.select("world_id", "t", "idx", F.inline(F.array(arm("additive", lambda c: c), arm("snapped", snap))))
        return long.select("world_id", "t", "idx", "mech", F.inline("r")).select("world_id", "t", "idx", "role", "mech", "v")

    @cached_property
    def evals(self) -> DataFrame:
        o = self.table("orders")
        day = F.col("o_orderdate")
        return o.select(
            F.col("o_orderpriority").alias("run_id"),
            (F.year(day) * 12 + F.month(day)).cast("bigint").alias("step"),
            F.col("o_orderkey").alias("candidate_id"), F.col("o_orderstatus").alias("role"),
            F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"),
            (F.col("o_totalprice") / 100000.0).alias("cr"),
            ((F.col("o_custkey") % 100) / 100.0).alias("ci"),
            (F.col("o_totalprice") / 1000000.0).alias("score"),
            F.when(F.col("o_orderkey") % 97 == 0, "FAILED").otherwise("OK").alias("status"),
            day.alias("ts"))

    @cached_property
    def evals_b(self) -> DataFrame:
        """Perturbed copy: 1% changed scores, 1% missing, 1% extra, some NULL."""
        e, k = self.evals, F.col("candidate_id")
        kept = e.filter(k % 100 != 1).withColumn(
            "score", F.when(k % 100 == 2, F.col("score") + 0.25)
            .when(k % 100 == 3, F.lit(None).cast("double")).otherwise(F.col("score")))
        extra = e.filter(k % 100 == 4).withColumn("candidate_id", -k - 1)
        return kept.unionByName(extra)

    @cached_property
    def messy(self) -> DataFrame:
        c = self.table("customer")
        k, seg = F.col("c_custkey"), F.col("c_mktsegment")
        return c.select(
            k.alias("id"), F.when(k % 2 == 0, F.upper(seg)).otherwise(F.lower(seg)).alias("name"),
            F.lower(F.substring(seg, 1, 3)).alias("alias"), F.col("c_acctbal").alias("amount"),
            F.when(k % 29 == 0, F.lit(None).cast("double")).when(k % 31 == 0, F.lit(float("nan")))
            .when(k % 37 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal") / 10000.0).alias("score"))

    @cached_property
    def named_series(self) -> DataFrame:
        s = self.type_series.select(F.col("series_id").alias("name"), "t", "v")
        copy = s.filter(F.col("name") == "click").withColumn("name", F.lit("click_copy"))
        return s.unionByName(copy)


_CELL = "FROM embeddings, range(1, 65) r(i)"

SQL_VIEWS = {
    "v_cells": f"""
SELECT vec_id AS sample_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, i - 1 AS idx,
       embedding[i]::DOUBLE AS v {_CELL}""",
    "v_pairs_cells": """
SELECT a.sample_id AS pair_id, a.y, a.x, a.idx, a.v AS f, b.v AS t
FROM v_cells a JOIN v_cells b ON b.sample_id = a.sample_id + 1 AND b.idx = a.idx""",
    "v_frame_ids": """
SELECT label::BIGINT AS series_id, vec_id,
       row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t FROM embeddings""",
    "v_frames": """
SELECT f.series_id, f.t, c.idx, c.v FROM v_frame_ids f JOIN v_cells c ON c.sample_id = f.vec_id""",
    "v_series": """
SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
       ts, value AS v, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag FROM events""",
    "v_type_series": """
SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t,
       ts, value AS v, CASE WHEN value > 100 THEN 1 ELSE 0 END AS flag FROM events""",
    "v_samples": """
SELECT vec_id AS sample_id, 'g' || (vec_id % 8) AS grp, 'u' || (label % 5) AS unit, vec_id // 8 AS seed,
       CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS label,
       CASE WHEN vec_id % 8 <= 4 THEN 'train' WHEN vec_id % 8 = 5 THEN 'validation' ELSE 'holdout' END AS split
FROM embeddings""",
    "v_features": """
SELECT sample_id, 'd' || idx AS name, v AS value, 'f' || (idx // 16) AS family FROM v_cells""",
    "v_unit_base": """
SELECT c.sample_id, c.y, c.x, c.idx, c.v, min(c.v) OVER w AS lo, max(c.v) OVER w AS hi,
       s.grp, s.seed, s.split
FROM v_cells c JOIN v_samples s USING (sample_id) WINDOW w AS (PARTITION BY c.sample_id)""",
    "v_unit_cells": """
SELECT *, CASE WHEN unit = 'none' THEN 'continuous' ELSE 'computational' END AS label FROM (
SELECT sample_id, grp, seed, split, 'none' AS unit, idx, v FROM v_unit_base
UNION ALL SELECT sample_id, grp, seed, split, 'float32', idx, v::FLOAT::DOUBLE FROM v_unit_base
UNION ALL SELECT sample_id, grp, seed, split, 'q255', idx, trunc((v - lo) / (hi - lo) * 255.0::DOUBLE) / 255.0::DOUBLE FROM v_unit_base
UNION ALL SELECT sample_id, grp, seed, split, 'q15', idx, trunc((v - lo) / (hi - lo) * 15.0::DOUBLE) / 15.0::DOUBLE FROM v_unit_base
UNION ALL SELECT sample_id, grp, seed, split, 'lut16', idx, lo + round_even((v - lo) / (hi - lo) * 15.0::DOUBLE, 0) * (hi - lo) / 15.0::DOUBLE FROM v_unit_base
UNION ALL SELECT a.sample_id, a.grp, a.seed, a.split, 'block4', a.idx, b.v
  FROM v_unit_base a JOIN v_cells b ON b.sample_id = a.sample_id
   AND b.y = (a.y // 4) * 4 + 2 AND b.x = (a.x // 4) * 4 + 2
UNION ALL SELECT sample_id, grp, seed, split, 'noise', idx,
  v + (('0x' || substr(md5('11:' || sample_id || ':' || idx), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5::DOUBLE) * 0.1::DOUBLE FROM v_unit_base
UNION ALL SELECT sample_id, grp, seed, split, 'xor', idx,
  xor(trunc(v * 1023.0::DOUBLE)::BIGINT & 1023, (idx * 7) & 1023) / 1023.0::DOUBLE FROM v_unit_base)""",
    "v_unit_hist": """
SELECT sample_id, grp, seed, split, unit, label, v, count(*) AS n FROM v_unit_cells GROUP BY ALL""",
    "v_unit_features": """
WITH agg AS (
  SELECT sample_id, grp, seed, split, unit, label, count(*)::DOUBLE AS distinct_values,
         1.0::DOUBLE - count(*) / sum(n)::DOUBLE AS repeated, max(n) / sum(n)::DOUBLE AS dominant,
         ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n) AS value_entropy
  FROM v_unit_hist GROUP BY ALL)
UNPIVOT agg ON distinct_values, repeated, dominant, value_entropy INTO NAME name VALUE value""",
    "v_doc_features": """
WITH wide AS (
  SELECT doc_id AS sample_id, source AS grp, lang AS unit,
         CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label,
         length(text)::DOUBLE AS length, len(string_split(text, ' '))::DOUBLE AS words,
         (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::DOUBLE / greatest(length(text), 1)::DOUBLE AS digit_share,
         (length(text) - length(replace(text, chr(10), '')))::DOUBLE + 1.0::DOUBLE AS lines
  FROM documents JOIN labels USING (doc_id))
UNPIVOT wide ON length, words, digit_share, lines INTO NAME name VALUE value""",
    "v_unit_pairs": """
WITH g AS (
  SELECT l_suppkey AS grp, year(l_shipdate) AS seed, l_returnflag AS unit, avg(l_quantity) AS quantity,
         avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax
  FROM lineitem GROUP BY ALL)
UNPIVOT g ON quantity, price, discount, tax INTO NAME name VALUE value""",
    "v_unit_diffs": """
SELECT a.grp, a.seed, a.unit, a.name, a.value - r.value AS d FROM v_unit_features a
JOIN v_unit_features r ON r.sample_id = a.sample_id AND r.name = a.name AND r.unit = 'none' WHERE a.unit <> 'none'""",
    "v_pair_diffs": """
SELECT a.grp, a.seed, a.unit, a.name, a.value - r.value AS d FROM v_unit_pairs a
JOIN v_unit_pairs r ON r.grp = a.grp AND r.seed = a.seed AND r.name = a.name AND r.unit = 'N' WHERE a.unit <> 'N'""",
    "v_trace": """
WITH h AS (SELECT *, date_trunc('hour', ts) AS hour FROM v_series),
n AS (SELECT series_id, hour, count(*) AS n FROM h GROUP BY ALL),
m AS (SELECT *, max(n) OVER (PARTITION BY series_id) AS top FROM n)
SELECT series_id, t, n / top::DOUBLE AS active, v AS mean, 0.0::DOUBLE AS std, flag FROM h JOIN m USING (series_id, hour)""",
    "v_trace_base": """
WITH b AS (SELECT hour(ts) AS hod, floor(avg(v) * 100.0::DOUBLE + 0.50013::DOUBLE) / 100.0::DOUBLE AS mean FROM v_series GROUP BY 1)
SELECT series_id, t, 1.0::DOUBLE AS active, mean, 0.0::DOUBLE AS std FROM v_series JOIN b ON b.hod = hour(ts)""",
    "v_catalogue": """
WITH b AS (
  SELECT label::BIGINT AS sky, vec_id AS event_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b,
         embedding[3]::DOUBLE AS c,
         CASE WHEN vec_id % 17 <> 0 THEN abs(embedding[4]::DOUBLE) * 1e20 END AS energy FROM embeddings),
n AS (SELECT *, coalesce(nullif(sqrt(a * a + b * b + c * c), 0), 1) AS n FROM b)
SELECT unnest([sky, -1]) AS sky_id, event_id, a / n AS ux, b / n AS uy, c / n AS uz, energy FROM n""",
    "v_responses": """
WITH g AS (
  SELECT l_suppkey AS world_id, year(l_shipdate) - 1995 AS t, l_linenumber::BIGINT AS idx,
    floor(sum(CASE WHEN l_returnflag IN ('A') THEN l_extendedprice * (1 - l_discount) ELSE 0 END) * 100.0::DOUBLE + 0.50013::DOUBLE) / 100.0::DOUBLE AS A,
    floor(sum(CASE WHEN l_returnflag IN ('R') THEN l_extendedprice * (1 - l_discount) ELSE 0 END) * 100.0::DOUBLE + 0.50013::DOUBLE) / 100.0::DOUBLE AS B,
    floor(sum(CASE WHEN l_returnflag IN ('N') THEN l_extendedprice * (1 - l_discount) ELSE 0 END) * 100.0::DOUBLE + 0.50013::DOUBLE) / 100.0::DOUBLE AS C,
    floor(sum(CASE WHEN l_returnflag IN ('A', 'R') THEN l_extendedprice * (1 - l_discount) ELSE 0 END) * 100.0::DOUBLE + 0.50013::DOUBLE) / 100.0::DOUBLE AS AB_again
  FROM lineitem WHERE l_returnflag IN ('A', 'R', 'N') GROUP BY ALL),
wide AS (SELECT *, A + B AS AB, -A AS opposite, A + B + C AS ABC FROM g),
long AS (UNPIVOT wide ON A, B, C, AB, AB_again, opposite, ABC INTO NAME role VALUE v)
SELECT world_id, t, idx, role, 'additive' AS mech, v FROM long
UNION ALL SELECT world_id, t, idx, role, 'snapped', floor(v / 100.0::DOUBLE + 0.5::DOUBLE) * 100.0::DOUBLE FROM long
UNION ALL SELECT world_id, t, idx, 'ABthenC', 'additive', AB + C FROM wide
UNION ALL SELECT world_id, t, idx, 'ABthenC', 'snapped', floor((floor(AB / 100.0::DOUBLE + 0.5::DOUBLE) * 100.0::DOUBLE + C) / 100.0::DOUBLE + 0.5::DOUBLE) * 100.0::DOUBLE FROM wide""",
    "v_evals": """
SELECT o_orderpriority AS run_id, year(o_orderdate) * 12 + month(o_orderdate) AS step,
       o_orderkey AS candidate_id, o_orderstatus AS role, 'm' || (o_custkey % 3) AS model,
       o_totalprice / 100000.0::DOUBLE AS cr, (o_custkey % 100) / 100.0::DOUBLE AS ci,
       o_totalprice / 1000000.0::DOUBLE AS score,
       CASE WHEN o_orderkey % 97 = 0 THEN 'FAILED' ELSE 'OK' END AS status, o_orderdate AS ts FROM orders""",
    "v_evals_b": """
SELECT run_id, step, candidate_id, role, model, cr, ci,
       CASE WHEN candidate_id % 100 = 2 THEN score + 0.25::DOUBLE WHEN candidate_id % 100 = 3 THEN NULL
            ELSE score END AS score, status, ts
FROM v_evals WHERE candidate_id % 100 <> 1
UNION ALL SELECT run_id, step, -candidate_id - 1, role, model, cr, ci, score, status, ts
FROM v_evals WHERE candidate_id % 100 = 4""",
    "v_messy": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS name,
       lower(substr(c_mktsegment, 1, 3)) AS alias, c_acctbal AS amount,
       CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 'nan'::DOUBLE
            WHEN c_custkey % 37 = 0 THEN 'inf'::DOUBLE ELSE c_acctbal / 10000.0::DOUBLE END AS score FROM customer""",
    "v_named_series": """
SELECT series_id AS name, t, v FROM v_type_series
UNION ALL SELECT 'click_copy', t, v FROM v_type_series WHERE series_id = 'click'""",
}
