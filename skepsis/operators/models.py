"""Transparent classifiers over long features, fitted and scored per group of keys `by`.

`by` carries folds, replicates, ablation sets or disjoint-matrix cells, so a whole experiment is one
job.  A fit is a table of per-feature class sums; everything else is arithmetic on that small table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import dbl, let, ratio
from .scale import materialize, names


def zscore_fit(train: DataFrame, by=(), name: str = "name", value: str = "value") -> DataFrame:
    """(by, name, mu, sd) with ddof 0; a deviation of at most 1e-10 counts as 1."""
    sd = F.stddev_pop(value)
    return train.groupBy(*names(by), name).agg(F.avg(value).alias("mu"), F.when(sd > 1e-10, sd).otherwise(1.0).alias("sd"))


def zscore_transform(df: DataFrame, fit: DataFrame, by=(), name: str = "name", value: str = "value") -> DataFrame:
    """Features the fit does not know become 0."""
    j = df.join(materialize(fit), names(by) + [name], "left")
    return j.withColumn("z", F.when(F.col("mu").isNull(), 0.0).otherwise((F.col(value) - F.col("mu")) / F.col("sd"))).drop("mu", "sd")


def fit(train: DataFrame, by=(), label: str = "label", name: str = "name", value: str = "value") -> DataFrame:
    """Model table (by, name, label, mu, sd, c, w, b): z-score, class centroid, mean-difference
    weight and bias share, all from one aggregation by (by, name, label)."""
    by = names(by)
    s = train.groupBy(*by, name, label).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    w = W.partitionBy(*by, name)  # one row per class
    n, tot = F.col("_n"), F.sum("_n").over(w)
    mu = F.sum(n * F.col("_m")).over(w) / tot
    s = s.withColumns({"_tot": tot, "mu": mu})
    gap = F.col("_m") - F.col("mu")
    s = s.withColumn("_var", F.sum(n * (F.col("_v") + gap * gap)).over(w) / F.col("_tot"))
    sd = F.sqrt("_var")
    s = s.withColumn("sd", F.when(sd > 1e-10, sd).otherwise(1.0))
    rest = F.coalesce((F.col("_tot") * F.col("mu") - n * F.col("_m")) / F.nullif(dbl(F.col("_tot") - n), F.lit(0.0)), F.col("mu"))
    c, r = (F.col("_m") - F.col("mu")) / F.col("sd"), (rest - F.col("mu")) / F.col("sd")
    return s.select(*by, name, label, "mu", "sd", c.alias("c"), (c - r).alias("w"), (-0.5 * (c - r) * (c + r)).alias("b"))


def packed_model(model: DataFrame, by=(), label: str = "label", name: str = "name") -> DataFrame:
    """One row per `by` (a single row without keys): per feature its model rows, and per class its totals over all features."""
    by = names(by)
    rows = model.groupBy(*by, name).agg(F.collect_list(F.struct(F.col(label).alias("k"), "mu", "sd", "c", "w", "b")).alias("_k"))
    m = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(name, "_k"))).alias("f"))
    flat = F.flatten(F.map_values("f"))
    add = lambda rows_, value: F.aggregate(rows_, F.lit(0.0), lambda s, r: s + value(r))
    classes = let(flat, lambda a: F.transform(F.array_sort(F.array_distinct(F.transform(a, lambda r: r["k"]))), lambda k: let(
        F.filter(a, lambda r: r["k"] == k), lambda own: F.struct(k.alias("k"), add(own, lambda r: r["c"] * r["c"]).alias("c2"), add(own, lambda r: r["b"]).alias("b")))))
    return m.select(*by, F.struct("f", classes.alias("classes")).alias("_model"))


def class_scores(df: DataFrame, model: DataFrame, by=(), sample: str = "sample_id", label: str = "label",
                 name: str = "name", value: str = "value") -> DataFrame:
    """(by, sample, label, dist2, score) of every sample.

    The model is one row per `by`, or a scalar where there are no keys: features look their rows up in its map, fan out to the
    classes and are summed before the only shuffle.  A known feature that a sample lacks, or whose value is NULL, has z = 0, one that
    the model does not know counts for nothing: each class starts from its totals over all known features, and the features present correct them.
    """
    by = names(by)
    # a written model has a known size, so the planner broadcasts it exactly when it is small
    m = materialize(packed_model(model, by, label, name))
    d = df.select(*by, *names(sample), name, value)
    j = d.join(m, by) if by else d.withColumn("_model", m.scalar())
    j = j.select(*by, *names(sample), value, F.try_element_at("_model.f", F.col(name)).alias("_own"), F.explode("_model.classes").alias("_c"))
    own = F.get(F.filter("_own", lambda r: r["k"] == F.col("_c.k")), 0)
    j = j.select(*by, *names(sample), value, "_c", own.alias("_m"))
    z = (F.col(value) - F.col("_m.mu")) / F.nullif(F.col("_m.sd"), F.lit(0.0))
    z = F.coalesce(z, F.lit(0.0))
    gap = z - F.col("_m.c")
    s = j.groupBy(*by, *names(sample), F.col("_c.k").alias(label)).agg(
        F.max("_c.c2").alias("_c2"), F.max("_c.b").alias("_b"),
        F.sum(F.coalesce(gap * gap - F.col("_m.c") * F.col("_m.c"), F.lit(0.0))).alias("_d"), F.sum(F.coalesce(z * F.col("_m.w"), F.lit(0.0))).alias("_s"))
    return s.select(*by, *names(sample), label, (F.col("_d") + F.col("_c2")).alias("dist2"), (F.col("_s") + F.col("_b")).alias("score"))


def predict(scores: DataFrame, by=(), sample: str = "sample_id", label: str = "label") -> DataFrame:
    """Centroid and mean-difference labels, ties to the first label.  The combined rule equals the
    mean-difference label (agreement keeps it, disagreement prefers it)."""
    g = scores.groupBy(*names(by), *names(sample)).agg(
        F.min(F.struct("dist2", label)).alias("_c"), F.min(F.struct((-F.col("score")).alias("s"), F.col(label))).alias("_w"))
    return g.select(*names(by), *names(sample), F.col(f"_c.{label}").alias("pred_centroid"),
                    F.col(f"_w.{label}").alias("pred_meandiff"), F.col(f"_w.{label}").alias("pred"))


def probabilities(scores: DataFrame, by=(), sample: str = "sample_id", label: str = "label") -> DataFrame:
    """Inverse-distance, softmax and averaged class probabilities (groups hold one row per class)."""
    w = W.partitionBy(*names(by), *names(sample))
    inv = 1.0 / (F.sqrt("dist2") + 1e-10)
    s = scores.withColumns({"_i": inv, "_t": F.max("score").over(w)})
    s = s.withColumn("_e", F.exp(F.col("score") - F.col("_t")))
    s = s.withColumns({"p_centroid": F.col("_i") / F.sum("_i").over(w), "p_meandiff": F.col("_e") / F.sum("_e").over(w)})
    return s.withColumn("p", (F.col("p_centroid") + F.col("p_meandiff")) / 2.0).drop("_i", "_t", "_e")


def standardized_centroid(train: DataFrame, test: DataFrame, features: list[str], sample: str = "sample_id",
                          label: str = "label") -> DataFrame:
    """Frozen feature list, squared standardised distance per class, tie to the first class.
    A sample that does not carry exactly the listed features is an error."""
    keep = F.col("name").isin(features)
    model = fit(train.filter(keep), label=label)
    t = test.groupBy(sample).agg(F.count_distinct("name").alias("_k"), F.count(F.when(keep, 1)).alias("_h"))
    ok = (F.col("_k") == len(features)) & (F.col("_h") == len(features))
    s = class_scores(test.filter(keep), model, (), sample, label)
    d = s.groupBy(sample).agg(F.min(F.struct("dist2", label)).alias("_b"), F.map_from_entries(F.collect_list(F.struct(label, "dist2"))).alias("dists"))
    d = d.join(t, sample)
    return d.select(sample, F.when(ok, F.col(f"_b.{label}")).otherwise(
        F.raise_error(F.lit("sample does not carry exactly the frozen features")).cast("string")).alias("pred"), "dists")


def accuracies(pred: DataFrame, by=(), true: str = "label", guess: str = "pred") -> DataFrame:
    """(by, n, accuracy, balanced): share of hits, and the mean over true classes of the share of hits in each."""
    hit = F.when(F.col(true) == F.col(guess), 1.0).otherwise(0.0)
    c = pred.groupBy(*names(by), true).agg(F.count(F.lit(1)).alias("_n"), F.sum(hit).alias("_h"))
    return c.groupBy(*names(by)).agg(F.sum("_n").alias("n"), (F.sum("_h") / F.sum("_n")).alias("accuracy"), F.avg(F.col("_h") / F.col("_n")).alias("balanced"))


def label_permutation_null(train: DataFrame, test: DataFrame, reps: int, seed, order: Column, per_bucket: int = 512, sample="sample_id",
                           label: str = "label", name: str = "name", value: str = "value") -> DataFrame:
    """(rep, n, accuracy, balanced): the mean-difference classifier fitted on training labels that are permuted among all
    training samples, tested on the true labels.

    Class counts stay as they are, so no class or unit has to be left out to balance them; `balanced` doesn't see their
    sizes.  order: a dense integer id of a training sample, which keys the draws.  Empty training or test data give no row.
    """
    from .resample import shuffle_values
    from .scale import replicate
    k = names(sample)
    ids = train.groupBy(*k, label).agg(F.collect_list(F.struct(name, value)).alias("_f")).withColumn("_id", order)
    drawn = shuffle_values(replicate(ids, reps), "rep", "_id", label, seed, F.floor(F.col("_id") / per_bucket), out="_label")
    tr = drawn.select("rep", *k, F.col("_label").alias(label), F.inline("_f"))
    te = k + ["_true"]          # the true label rides along as a part of the sample's key
    scores = class_scores(replicate(test.withColumnRenamed(label, "_true"), reps), fit(tr, ["rep"], label, name, value), ["rep"], te, label, name, value)
    return accuracies(predict(scores, ["rep"], te, label), ["rep"], "_true")


def permutation_summary(real: DataFrame, null: DataFrame, metric: str = "balanced") -> DataFrame:
    """One row: the real figure, mean, least and largest of the null, and the share of draws, the real one
    included, that reach it."""
    n = null.agg(F.count(metric).alias("reps"), F.avg(metric).alias("mean"), F.min(metric).alias("min"), F.max(metric).alias("max"),
                 F.collect_list(metric).alias("_all"))       # as long as the number of replicates, a parameter
    j = real.select(F.lit(1).alias("_one"), F.col(metric).alias("real")).join(n.withColumn("_one", F.lit(1)), "_one")
    reach = F.size(F.filter("_all", lambda x: x >= F.col("real") - 1e-12))
    return j.select("real", "reps", "mean", "min", "max", ((reach + 1.0) / (F.col("reps") + 1.0)).alias("p"))


# -- evaluation ---------------------------------------------------------------------------------------------

def confusion(pred: DataFrame, by=(), true: str = "label", guess: str = "pred") -> DataFrame:
    return pred.groupBy(*names(by), true, guess).agg(F.count(F.lit(1)).alias("n"))


def classification_report(pred: DataFrame, positive: str, negative: str, by=(), true: str = "label", guess: str = "pred") -> DataFrame:
    """Counts, rates and baselines; undefined rates are NULL; labels outside the two are only counted."""
    t, g = F.col(true), F.col(guess)
    known = t.isin(positive, negative)
    cnt = lambda c: F.count(F.when(known & c, 1))
    a = pred.groupBy(*names(by)).agg(
        cnt((t == positive) & (g == positive)).alias("tp"), cnt((t == negative) & (g == negative)).alias("tn"),
        cnt((t == negative) & (g == positive)).alias("fp"), cnt((t == positive) & (g != positive)).alias("fn"),
        F.count(F.when(~known, 1)).alias("excluded"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    rec, spec, prec = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    return a.select(*names(by), "tp", "tn", "fp", "fn", "excluded", n.alias("n"), ratio(tp + tn, n).alias("accuracy"),
                    ((rec + spec) / 2.0).alias("balanced_accuracy"), rec.alias("recall"), spec.alias("specificity"),
                    prec.alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    ratio(tp + fn, n).alias("always_positive"), ratio(F.greatest(tp + fn, tn + fp), n).alias("majority"))


def report_by(pred: DataFrame, keys, true: str = "label", guess: str = "pred") -> DataFrame:
    """Accuracy and class counts per key, per pair of keys and overall (cube, one pass)."""
    keys = names(keys)
    g = pred.cube(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(true) == F.col(guess), 1.0).otherwise(0.0)).alias("accuracy"),
                             F.count_distinct(true).alias("classes"), F.grouping_id(*keys).alias("set_id"))
    return g


def balance_per_group(samples: DataFrame, by, label: str = "label", order: str = "sample_id", bucket: Column | None = None) -> DataFrame:
    """The first n of every class per group, n = size of the group's smallest class (every class of
    the table must be present in the group).  by=() balances without strata."""
    from .scale import dense_position
    by = names(by)
    s = samples if by else samples.withColumn("_all", F.lit(1))
    ks = by or ["_all"]
    cnt = s.groupBy(*ks, label).agg(F.count(F.lit(1)).alias("_n"))
    # the number of classes is a one-row aggregate over the small count table
    total = cnt.select(label).distinct().agg(F.count(F.lit(1)).alias("_c")).scalar()
    n = cnt.groupBy(*ks).agg(F.min("_n").alias("_min"), F.count(F.lit(1)).alias("_have")).filter(F.col("_have") == total)
    pos = dense_position(s, ks + [label], order, F.floor(F.col(order) / 1024) if bucket is None else bucket, out="_i")
    return pos.join(n, ks).filter(F.col("_i") <= F.col("_min")).drop("_i", "_min", "_have", "_all")


def group_split(samples: DataFrame, rules: dict, key: str = "grp", default: str = "holdout") -> DataFrame:
    """Split by group family: `rules` maps split name -> list of groups."""
    e = None
    for split, groups in rules.items():
        cond = F.col(key).isin(list(groups))
        e = F.when(cond, split) if e is None else e.when(cond, split)
    return samples.withColumn("split", e.otherwise(default))


def leave_one_out(df: DataFrame, key: str, folds: list) -> tuple[DataFrame, DataFrame]:
    """(train, test) with a fold column: fold f tests key = f and trains on the rest, in one job."""
    fs = F.array(*[F.lit(f) for f in folds])
    train = df.withColumn("fold", F.explode(F.filter(fs, lambda f: f != F.col(key))))
    return train, df.filter(F.col(key).isin(folds)).withColumn("fold", F.col(key))


# -- pairwise discrimination ----------------------------------------------------------------------------------

def pairwise_fit(diffs: DataFrame, by=(), name: str = "name", d: str = "d") -> DataFrame:
    """Mean-difference model of mirrored differences.

    Mirroring makes the mean 0, the deviation sqrt(mean d^2) and the class centroids +-mean, so
    the mirrored rows need not exist: weight = 2 * mean(d) / sd.
    """
    m, sd = F.avg(d), F.sqrt(F.avg(F.col(d) * F.col(d)))
    a = diffs.groupBy(*names(by), name).agg(m.alias("_m"), sd.alias("_s"))
    s = F.when(F.col("_s") > 1e-10, F.col("_s")).otherwise(1.0)
    return a.select(*names(by), name, s.alias("sd"), (2.0 * F.col("_m") / s).alias("w"))


def pairwise_hits(diffs: DataFrame, model: DataFrame, by=(), pair=("grp", "seed", "unit"), name: str = "name",
                  d: str = "d", eps: float = 1e-9, keep=()) -> DataFrame:
    """1 if the pair is oriented as (alternative, reference), 0 if not, 1/2 for indistinguishable pairs, also
    for pairs of which the model knows no feature."""
    by, pair = names(by), names(pair)
    j = diffs.join(materialize(model), by + [name], "left")
    top = F.max(F.when(F.col("sd").isNotNull(), F.abs(F.col(d))))
    a = j.groupBy(*by, *pair, *keep).agg(F.sum(F.col(d) / F.col("sd") * F.col("w")).alias("margin"), F.coalesce(top, F.lit(0.0)).alias("_top"))
    # rounding residue of a zero margin is a zero margin: the first class wins as for exact zero
    hit = F.when(F.col("_top") < eps, 0.5).when(F.col("margin") >= -1e-12, 1.0).otherwise(0.0)
    return a.withColumn("hit", hit).drop("_top")


def pairwise_discriminate(diffs: DataFrame, train: Column, test: Column, by=(), pair=("grp", "seed", "unit")) -> DataFrame:
    """Fit on `train` pairs, orient `test` pairs; accuracy over hits has null value 1/2."""
    return pairwise_hits(diffs.filter(test), pairwise_fit(diffs.filter(train), by), by, pair)


def accuracy(hits: DataFrame, by) -> DataFrame:
    return hits.groupBy(*names(by)).agg(F.count("hit").alias("n"), F.avg("hit").alias("accuracy"),
                                        F.avg(F.when(F.col("hit") == 0.5, 1.0).otherwise(0.0)).alias("tie_rate"))


def disjoint_matrix(diffs: DataFrame, train_grps, test_grps, train_units, test_units) -> DataFrame:
    """Hits for seen/unseen group x seen/unseen unit, keyed by cell; the fit is shared."""
    model = pairwise_fit(diffs.filter(F.col("grp").isin(train_grps) & F.col("unit").isin(train_units)))
    g = F.when(F.col("grp").isin(train_grps), "seen_grp").when(F.col("grp").isin(test_grps), "unseen_grp")
    u = F.when(F.col("unit").isin(train_units), "seen_unit").when(F.col("unit").isin(test_units), "unseen_unit")
    t = diffs.withColumn("cell", F.concat_ws("/", g, u)).filter(g.isNotNull() & u.isNotNull())
    return pairwise_hits(t, model, (), ("grp", "seed", "unit", "cell"))


def ablation_sets(features: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(set, feature) rows: families, every single feature, every drop-one, everything."""
    allf = sorted({f for fs in features.values() for f in fs})
    rows = [(f"family:{k}", f) for k, fs in features.items() for f in fs]
    rows += [(f"single:{f}", f) for f in allf] + [("all", f) for f in allf]
    rows += [(f"drop:{f}", g) for f in allf for g in allf if g != f]
    return rows


def ablation(diffs: DataFrame, sets: list[tuple[str, str]], train: Column, test: Column) -> DataFrame:
    """Hits keyed by feature set.  The set list is a plan parameter: it rides along as a literal map."""
    by_name: dict[str, list[str]] = {}
    for s, f in sets:
        by_name.setdefault(f, []).append(s)
    m = F.create_map(*[x for f, ss in by_name.items() for x in (F.lit(f), F.array(*[F.lit(s) for s in ss]))])
    d = diffs.withColumn("set", F.explode(F.try_element_at(m, F.col("name"))))
    return pairwise_discriminate(d, train, test, ["set"])


def ablation_summary(acc: DataFrame, chance: float = 0.55) -> DataFrame:
    one = F.col("set").startswith("single:")
    drop = F.col("set").startswith("drop:")
    return acc.agg(F.count(F.when(one & (F.col("accuracy") > chance), 1)).alias("singles_above_chance"),
                   F.min(F.when(drop, F.col("accuracy"))).alias("min_drop_one"),
                   (F.min(F.when(drop, F.col("accuracy"))) > chance).alias("redundant"))


def score_separation(probs: DataFrame, positive: str, true: str = "true_label", label: str = "label", by=()) -> DataFrame:
    """Mean positive-class probability per true class and the gap between them."""
    p = probs.filter(F.col(label) == positive)
    pos, neg = F.avg(F.when(F.col(true) == positive, F.col("p"))), F.avg(F.when(F.col(true) != positive, F.col("p")))
    return p.groupBy(*names(by)).agg(pos.alias("positive_mean"), neg.alias("negative_mean"), F.abs(pos - neg).alias("separation"))


def probe_table(hits: DataFrame, features: DataFrame, unit: str = "unit") -> DataFrame:
    """Per held-out unit: classified rate, tie rate and mean features."""
    r = accuracy(hits, unit)
    f = features.groupBy(unit).pivot("name").agg(F.avg("value"))
    return r.join(f, unit)


def cohort_audit(grids: DataFrame, cohort: str, features: DataFrame, feature_names: list[str]) -> DataFrame:
    """n, distinct contents and feature means per cohort."""
    n = grids.groupBy(cohort).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2(F.concat_ws(",", F.transform(
        "vals", lambda x: x.cast("string"))), 256)).alias("distinct_content"))
    return n.join(features.groupBy(cohort).pivot("name", feature_names).agg(F.avg("value")), cohort)


def detection_rate(pred: DataFrame, cohort, positive: str, guess: str = "pred", id: str = "sample_id") -> DataFrame:
    """Detected and missed counts per cohort; `detections` lists the ids as rows instead."""
    hit = F.col(guess) == positive
    return pred.groupBy(*names(cohort)).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("detected"),
                                            F.count(F.when(~hit, 1)).alias("missed"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("rate"))


def detections(pred: DataFrame, cohort, positive: str, guess: str = "pred", id: str = "sample_id") -> DataFrame:
    return pred.select(*names(cohort), id, F.when(F.col(guess) == positive, "detected").otherwise("missed").alias("outcome"))


class FrozenModel:
    """Fitted parameters kept as a table; a frozen model cannot be refitted or altered unnoticed."""

    def __init__(self, path: str):
        self.path = path

    def save(self, model: DataFrame) -> "FrozenModel":
        model.write.mode("errorifexists").parquet(self.path)
        return self

    def load(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)

    @staticmethod
    def digest(model: DataFrame) -> DataFrame:
        """Order-free content hash: hashes of rows are combined by addition, not by collecting."""
        h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in sorted(model.columns)]), 256), 1, 12), 16, 10)
        return model.agg(F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"), F.count(F.lit(1)).alias("rows"))
