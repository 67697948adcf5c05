"""Folds, out-of-fold contracts, discrimination, calibration and stability, paired comparisons and gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ranking import cumulated, places_by_hash


def stratified_folds(df: DataFrame, key: str, target: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """key, target, fold from 1: within a class rows are dealt in turn, in the order of a seeded hash of the key."""
    placed = places_by_hash(df.select(key, target), key, target, seed, "_place")
    return placed.select(key, target, (F.col("_place") % folds + 1).cast("int").alias("fold"))


def fold_fingerprint(folds: DataFrame, key: str = "key") -> str:
    """A hash of key:fold in order of the key, made of per-range hashes so that no task holds all."""
    part = F.pmod(F.xxhash64(key), F.lit(4096))
    lines = folds.groupBy(part.alias("part")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", F.col(key).cast("string"), F.col("fold").cast("string"))))), 256).alias("h"))
    return lines.agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])), 256)).first()[0]


def check_folds(folds: DataFrame, key: str, k: int) -> None:
    """Each key once, folds 1..k, none empty."""
    row = folds.groupBy(key).agg(F.count("*").alias("n"), F.min("fold").alias("low"), F.max("fold").alias("high")).agg(F.max("n"), F.min("low"), F.max("high")).first()
    if row[0] != 1 or row[1] != 1 or row[2] != k or folds.select("fold").distinct().count() != k:
        raise ValueError(f"folds don't cover each key once in 1..{k}")


def check_coverage(predictions: DataFrame, expected: DataFrame, key: str, score: str) -> DataFrame:
    """One row of counts: expected, covered once, repeated, missing, extra, invalid (NULL, NaN or outside 0..1)."""
    x = F.col(score)
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    given = predictions.groupBy(key).agg(F.count("*").alias("_n"), F.sum(F.when(bad, 1).otherwise(0)).alias("_bad"))
    both = expected.select(key, F.lit(1).alias("_e")).distinct().join(given, key, "full")
    count = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    return both.agg(
        count(F.col("_e").isNotNull(), "expected"),
        count(F.col("_e").isNotNull() & (F.col("_n") == 1), "covered_once"),
        count(F.col("_n") > 1, "repeated"),
        count(F.col("_n").isNull(), "missing"),
        count(F.col("_e").isNull(), "extra"),
        F.coalesce(F.sum("_bad"), F.lit(0)).cast("long").alias("invalid"),
    )


def _by_score(df: DataFrame, target: str, score: str) -> DataFrame:
    """pos, neg, their running sums up to and with each distinct score, and their totals P and N."""
    g = df.where(F.col(score).isNotNull() & F.col(target).isin(0, 1)).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(target).cast("long")).alias("pos"), F.sum(1 - F.col(target).cast("long")).alias("neg"))
    c = cumulated(g, "score", ["pos", "neg"])
    return c.select("score", "pos", "neg", (F.col("pos_before") + F.col("pos")).alias("pos_upto"), (F.col("neg_before") + F.col("neg")).alias("neg_upto"), F.col("pos_all").alias("P"), F.col("neg_all").alias("N"))


def discrimination(df: DataFrame, target: str, score: str) -> DataFrame:
    """One row: n, positives, roc_auc (ties count half), gini, ks. NULL without both classes."""
    g = _by_score(df, target, score)
    auc = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2)) / F.first(F.nullif(F.col("P") * F.col("N"), F.lit(0)))
    ks = F.max(F.abs(F.try_divide("pos_upto", "P") - F.try_divide("neg_upto", "N")))
    out = g.agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("positives"), auc.alias("roc_auc"), ks.alias("ks"))
    return out.select("n", "positives", "roc_auc", (2 * F.col("roc_auc") - 1).alias("gini"), F.when(F.col("roc_auc").isNotNull(), F.col("ks")).alias("ks"))


def average_precision(df: DataFrame, target: str, score: str) -> DataFrame:
    """One row: pr_auc, precision summed over the gain in recall from the highest score down."""
    g = _by_score(df, target, score)
    above_p, above_n = F.col("P") - F.col("pos_upto") + F.col("pos"), F.col("N") - F.col("neg_upto") + F.col("neg")
    return g.agg(F.sum(F.col("pos") / F.col("P") * above_p / (above_p + above_n)).alias("pr_auc"))


def calibration(df: DataFrame, target: str, score: str) -> DataFrame:
    """One row: brier score, log loss (scores kept off 0 and 1 by 1e-15), bad_rate."""
    y, p = F.col(target).cast("double"), F.col(score)
    q = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
    return df.agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), F.avg(y).alias("bad_rate"))


def calibration_bins(df: DataFrame, target: str, score: str, bins: int = 10) -> DataFrame:
    """Per bin of about equal size: bin from 1, n, mean_score, bad_rate, low, high, and ``gap``, the mean absolute
    difference of the two over all bins, weighted by n. Equal scores stay together: a score belongs to the bin that the
    first row of its own falls in, so a bin may be empty and then has no row. Rows without score or class don't count.
    """
    fine = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(target).isin(0, 1))
    g = fine.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("rows"), F.sum(F.col(target).cast("long")).alias("bads"))
    placed = cumulated(g, "score", ["rows"]).withColumn("bin", F.expr(f"cast(rows_before * {bins} div rows_all + 1 as int)"))
    x = placed.groupBy("bin").agg(F.sum("rows").alias("n"), (F.sum(F.col("score") * F.col("rows")) / F.sum("rows")).alias("mean_score"), (F.sum("bads") / F.sum("rows")).alias("bad_rate"), F.min("score").alias("low"), F.max("score").alias("high"))
    every = Window.partitionBy()  # a row per bin
    gap = F.sum(F.abs(F.col("mean_score") - F.col("bad_rate")) * F.col("n")).over(every) / F.sum("n").over(every)
    return x.withColumn("gap", gap)


def decisions(df: DataFrame, target: str, score: str, cutoff: float) -> DataFrame:
    """One row for a rule that declines from ``cutoff`` on: approval_rate, approved_bad_rate, capture_rate."""
    y, ok = F.col(target).cast("double"), F.col(score) < cutoff
    return df.agg(F.avg(ok.cast("double")).alias("approval_rate"), F.avg(F.when(ok, y)).alias("approved_bad_rate"), (F.sum(F.when(~ok, y).otherwise(0.0)) / F.sum(y)).alias("capture_rate"))


def binned(x: Column, edges: list[float]) -> Column:
    """The number of edges at or below x; -1 for missing."""
    return F.when(x.isNull(), F.lit(-1)).otherwise(sum(((x >= e).cast("int") for e in edges), F.lit(0)))


def stability(reference: DataFrame, actual: DataFrame, column: str, edges: list[float], floor: float = 1e-4) -> DataFrame:
    """One row: psi of ``column`` over the bins of ``edges``; shares are at least ``floor``."""
    share = lambda df, name: df.select(binned(F.col(column), edges).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))
    both = share(reference, "r").join(share(actual, "a"), "bin", "full")
    r, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)) for c in ("r", "a"))
    return both.agg(F.sum((a - r) * F.log(a / r)).alias("psi"))


def weight_of_evidence(df: DataFrame, bin_column: str, target: str, smooth: float = 0.5) -> DataFrame:
    """Per bin: n, bads, woe, and its part of the information value; every count is raised by ``smooth``."""
    y = F.col(target).cast("long")
    g = df.groupBy(F.col(bin_column).alias("bin")).agg(F.count("*").alias("n"), F.sum(y).alias("bads"))
    every = Window.partitionBy()
    good, bad = F.col("n") - F.col("bads") + smooth, F.col("bads") + smooth
    pg, pb = good / F.sum(good).over(every), bad / F.sum(bad).over(every)
    return g.select("bin", "n", "bads", F.log(pg / pb).alias("woe"), ((pg - pb) * F.log(pg / pb)).alias("iv"))


def scorecard_points(probability: Column, base_score: float = 600, base_odds: float = 50, double_odds: float = 20) -> Column:
    """Points that rise by ``double_odds`` as the odds of good double."""
    factor = double_odds / math.log(2)
    return F.lit(base_score - factor * math.log(base_odds)) + factor * F.log((1 - probability) / probability)


def paired_deltas(folds: DataFrame, baseline: str) -> DataFrame:
    """experiment, fold, score, delta to the baseline's score on the same fold."""
    base = folds.where(F.col("experiment") == baseline).select("fold", F.col("score").alias("_base"))
    return folds.join(base, "fold").select("experiment", "fold", "score", (F.col("score") - F.col("_base")).alias("delta"))


def ablation_summary(folds: DataFrame, baseline: str) -> DataFrame:
    """Per experiment: mean_score, std_score (0 for one fold), mean_delta, positive_folds."""
    d = paired_deltas(folds, baseline)
    return d.groupBy("experiment").agg(F.avg("score").alias("mean_score"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std_score"), F.avg("delta").alias("mean_delta"), F.sum((F.col("delta") > 0).cast("long")).alias("positive_folds"))


def importance_summary(importances: DataFrame) -> DataFrame:
    """feature, mean, deviation (0 for one fold) of a feature's importance over the folds, the most important first."""
    x = F.col("importance")
    return importances.groupBy("feature").agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("deviation")).orderBy(F.desc("mean"), "feature")


def select_final(summary: DataFrame, baseline: str, folds: int, tie: float = 1e-5, more_std: float = 5e-4) -> DataFrame:
    """The winner: better than the baseline, positive in at least 80 % of the folds, hardly less even; among those
    within ``tie`` of the best the smallest. No row if none passes."""
    base = summary.where(F.col("experiment") == baseline).select(F.col("oof_auc").alias("_auc"), F.col("std_fold_auc").alias("_std"))
    ok = summary.join(F.broadcast(base.limit(1))).where((F.col("experiment") != baseline) & (F.col("oof_auc") > F.col("_auc")) & (F.col("positive_folds") >= math.ceil(0.8 * folds)) & (F.col("std_fold_auc") <= F.col("_std") + more_std))
    best = ok.withColumn("_best", F.max("oof_auc").over(Window.partitionBy())).where(F.col("oof_auc") >= F.col("_best") - tie)
    return best.orderBy("n_features", "n_overwritten", F.desc("oof_auc"), "experiment").limit(1).drop("_auc", "_std", "_best")


def frame_difference(reference: DataFrame, candidate: DataFrame, key: str, overwritten: set[str] = frozenset()) -> DataFrame:
    """One row per column of the candidate: state, changed (null-safe inequalities), max_abs_difference, type_changed.

    A removed column raises, and so does one that changed without being declared ``overwritten``.
    """
    gone = set(reference.columns) - set(candidate.columns)
    if gone:
        raise ValueError(f"removed columns: {sorted(gone)}")
    kinds, both = dict(reference.dtypes), [c for c in reference.columns if c != key]
    joined = reference.select(key, *[F.col(c).alias(f"_r_{c}") for c in both]).join(candidate, key, "full")
    exprs = []
    for c in both:
        exprs.append(F.sum((~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).cast("long")).alias(f"n_{c}"))
        number = kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")
        exprs.append((F.max(F.abs(F.col(c).cast("double") - F.col(f"_r_{c}").cast("double"))) if number else F.lit(None).cast("double")).alias(f"d_{c}"))
    row = joined.agg(*exprs).first()
    new = dict(candidate.dtypes)
    undeclared = [c for c in both if (row[f"n_{c}"] or 0) and c not in overwritten]
    if undeclared:
        raise ValueError(f"undeclared changes: {undeclared}")
    out = [(c, "added", None, None, False) if c not in kinds else (c, "overwritten" if c in overwritten else "same", row[f"n_{c}"] or 0, row[f"d_{c}"], kinds[c] != new[c]) for c in candidate.columns if c != key]
    return candidate.sparkSession.createDataFrame(out, "column string, state string, changed long, max_abs_difference double, type_changed boolean")
