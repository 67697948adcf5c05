"""Decision gates over measured runs: screening, robustness over seeds and folds, replay, and equality of two matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.aggregation import trimmed_mean
from riskloom.operators.evaluation import frame_difference
from riskloom.operators.prepared import fingerprint

# The decision rules.
LEAST_DELTA, LEAST_FOLDS = 0.0005, 4
LEAST_SEEDS, LEAST_CROSSED_FOLDS = 2, 10
TOLERANCE = 0.0005


def screening(summary: DataFrame, baseline: str, delta: str = "mean_delta", least_delta: float = LEAST_DELTA, least_folds: int = LEAST_FOLDS) -> DataFrame:
    """experiment, verdict: CONTROL for the baseline, PASS for enough gain in enough folds, else FAIL."""
    enough = F.coalesce((F.col(delta) >= least_delta) & (F.col("positive_folds") >= least_folds), F.lit(False))
    return summary.select("experiment", F.when(F.col("experiment") == baseline, "CONTROL").when(enough, "PASS").otherwise("FAIL").alias("verdict"))


def crossed_deltas(runs: DataFrame, baseline: str) -> DataFrame:
    """experiment, seed, fold, delta: each run's score less the baseline's of the same seed and fold (fold NULL: the
    score over all folds of a seed). A run without its counterpart has a NULL delta, which no rule counts."""
    base = runs.where(F.col("experiment") == baseline).select(F.col("seed").alias("_seed"), F.col("fold").alias("_fold"), F.col("score").alias("_base"))
    paired = runs.where(F.col("experiment") != baseline).join(base, (F.col("seed") == F.col("_seed")) & F.col("fold").eqNullSafe(F.col("_fold")), "left")
    return paired.select("experiment", "seed", "fold", (F.col("score") - F.col("_base")).alias("delta"))


def robustness(runs: DataFrame, baseline: str, least_seeds: int = LEAST_SEEDS, least_folds: int = LEAST_CROSSED_FOLDS) -> DataFrame:
    """A row per experiment: the four rules' figures and whether all hold.

    ``runs``: experiment, seed, fold, score, where fold NULL is a seed's score over all its folds. Enough seeds gain,
    enough folds of all seeds gain, the seeds gain on average, and so do the folds without their best and worst.
    """
    d = crossed_deltas(runs, baseline)
    seed, fold = (F.when(c, F.col("delta")) for c in (F.col("fold").isNull(), F.col("fold").isNotNull()))
    g = d.groupBy("experiment").agg(F.count_if(seed > 0).alias("positive_seeds"), F.count_if(fold > 0).alias("positive_folds"), F.avg(seed).alias("mean_seed_delta"), trimmed_mean(fold).alias("trimmed_fold_delta"), F.min(fold).alias("low"), F.max(fold).alias("high"))
    rules = (F.col("positive_seeds") >= least_seeds) & (F.col("positive_folds") >= least_folds) & (F.col("mean_seed_delta") > 0) & (F.col("trimmed_fold_delta") > 0)
    return g.withColumn("accepted", F.coalesce(rules, F.lit(False)))


def check_replay(measured: float, reference: float, tolerance: float = TOLERANCE) -> float:
    """The gap of a repeated run to its reference; more than ``tolerance`` raises."""
    gap = abs(measured - reference)
    if not gap <= tolerance:
        raise RuntimeError(f"the run is off by {gap:.6f}, more than {tolerance}")
    return gap


def same_matrix(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two feature matrices agree: columns in order, types, keys, and every value, missing as missing.

    Fingerprints decide most unequal pairs in a pass over each; what they can't tell apart is compared value by value.
    """
    if a.columns != b.columns or a.dtypes != b.dtypes or fingerprint(a) != fingerprint(b):
        return False
    rows = frame_difference(a, b, key, set(a.columns)).agg(F.sum("changed").alias("n")).first()
    return not rows.n
