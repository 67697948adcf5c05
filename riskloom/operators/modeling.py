"""Models by name, cross-validation with out-of-fold scores, and a seeded random search, on Spark ML."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.evaluation import check_coverage, check_folds, discrimination, fold_fingerprint
from riskloom.operators.prepared import Prepared, check_same_rows
from riskloom.sources.staging import staged

MODELS = {
    "gbt": (GBTClassifier, {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8}),
    "logistic": (LogisticRegression, {"maxIter": 50, "regParam": 0.01}),
    "forest": (RandomForestClassifier, {"numTrees": 30, "maxDepth": 6}),
}


def build_model(name: str, config: dict | None = None, seed: int = 42):
    """An estimator by name (in any case); ``config`` overrides the defaults."""
    try:
        kind, defaults = MODELS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}") from None
    params = defaults | (config or {})
    if "seed" in {p.name for p in kind().params}:
        params = {"seed": seed} | params
    return kind(featuresCol="features", labelCol="label", **params)


def feature_pipeline(df: DataFrame, features: list[str]) -> Pipeline:
    """Text by vocabulary (unknown words are a value of their own), numbers by mean where missing."""
    kinds = dict(df.dtypes)
    words, numbers = [c for c in features if kinds[c] == "string"], [c for c in features if kinds[c] != "string"]
    empty = [c for c, n in df.agg(*[F.count(c).alias(c) for c in features]).first().asDict().items() if not n]
    if empty:
        raise ValueError(f"nothing observed in {empty}")
    stages: list = []
    if words:
        stages.append(StringIndexer(inputCols=words, outputCols=[f"{c}_index" for c in words], handleInvalid="keep"))
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"{c}_filled" for c in numbers]))
    stages.append(VectorAssembler(inputCols=[f"{c}_index" for c in words] + [f"{c}_filled" for c in numbers], outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


@dataclass
class Validation:
    """``oof``: key, target, fold, score. ``test``: key, a score by fold, and their mean ``score`` (None without test
    rows). ``importances``: feature, fold, importance. Scores, iterations and models are in order of the folds."""

    oof: DataFrame
    fold_scores: list[tuple[int, float]]
    oof_auc: float
    mean_auc: float
    std_auc: float
    test: DataFrame | None
    importances: DataFrame
    best_iterations: list[int]
    fingerprint: str
    models: list
    runtime: float


def _importances(fitted, names: list[str]) -> list[tuple[str, float]]:
    """Of each feature: a tree ensemble's importance, or the size of a linear model's coefficient."""
    values = fitted.featureImportances if hasattr(fitted, "featureImportances") else fitted.coefficients
    return [(n, abs(float(v))) for n, v in zip(names, values.toArray(), strict=True)]


def cross_validate(df: DataFrame, folds: DataFrame, key: str, target: str, features: list[str], model: str = "gbt", config: dict | None = None, seed: int = 42, test: DataFrame | None = None, inner: float = 0.1) -> Validation:
    """Fit on all folds but one, score that one: every key gets one out-of-fold score.

    Boosted trees stop early by a part (``inner``, chosen by a seeded hash of the key) of the rows they are fitted on,
    so no row has a say in the model that scores it. The rows of ``test`` get the mean score of all models, in one pass
    over them. Features that are missing from a table, or from all rows of it, raise; so do folds that don't hold
    exactly the keys of ``df``. Rows are joined with their folds, and scores made, once: both are written to the shared folder.
    """
    began = time.perf_counter()
    lacking = [c for c in features if c not in df.columns or (test is not None and c not in test.columns)]
    if lacking:
        raise ValueError(f"missing features: {lacking}")
    k = folds.agg(F.max("fold")).first()[0] or 0
    check_folds(folds, key, k)
    numbers = {c: F.col(c).cast("double") for c, t in df.dtypes if c in features and t != "string"}
    held_in = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000)) < int(1000 * inner)
    data = df.select(key, target, *features).join(folds.select(key, "fold"), key, "full").withColumns(numbers | {"label": F.col(target).cast("double"), "_inner": held_in})
    data = staged(data, "folds")
    sizes = {r.fold: r for r in data.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("_inner").cast("int")).alias("inner"), F.sum(F.col("label").isNull().cast("int")).alias("unknown")).collect()}
    if set(sizes) != set(range(1, k + 1)) or any(r.unknown for r in sizes.values()):
        raise ValueError("folds and rows differ in their keys, or rows lack the target")
    names = [c for c in features if c not in numbers] + [c for c in features if c in numbers]
    asked = None if test is None else test.select(key, *[numbers.get(c, F.col(c)).alias(c) for c in features])
    score = vector_to_array("probability")[1]
    parts, importances, iterations, models = None, [], [], []
    for fold in range(1, k + 1):
        train, held = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        ready = feature_pipeline(train, features).fit(train)
        estimator = build_model(model, config, seed)
        if estimator.hasParam("validationIndicatorCol") and 0 < sum(r.inner for f, r in sizes.items() if f != fold) < sum(r.n for f, r in sizes.items() if f != fold):
            estimator.setValidationIndicatorCol("_inner")
        fitted = estimator.fit(ready.transform(train))
        scored = fitted.transform(ready.transform(held)).select(key, F.col(target), "fold", score.alias("score"))
        parts = scored if parts is None else parts.unionByName(scored)
        if asked is not None:
            asked = fitted.transform(ready.transform(asked)).select(*asked.columns, score.alias(f"score_{fold}"))
        importances += [(name, fold, value) for name, value in _importances(fitted, names)]
        iterations.append(fitted.getNumTrees if hasattr(fitted, "trees") else int(fitted.summary.totalIterations))
        models.append((ready, fitted))
    parts = staged(parts, "scores")
    scores = [(fold, float(discrimination(parts.where(F.col("fold") == fold), target, "score").first()["roc_auc"])) for fold in range(1, k + 1)]
    if asked is not None:
        each = [f"score_{fold}" for fold in range(1, k + 1)]
        asked = asked.select(key, *each, (sum(map(F.col, each), F.lit(0.0)) / k).alias("score"))
    values = [s for _, s in scores]
    mean = sum(values) / len(values)
    std = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5 if len(values) > 1 else 0.0
    rows = df.sparkSession.createDataFrame(importances, "feature string, fold int, importance double")
    whole = float(discrimination(parts, target, "score").first()["roc_auc"])
    return Validation(parts, scores, whole, mean, std, asked, rows, iterations, fold_fingerprint(folds, key), models, time.perf_counter() - began)


def random_search(space: dict[str, tuple], rounds: int, evaluate, seed: int = 42) -> tuple[dict, float]:
    """The best of ``rounds`` seeded draws: ("int", low, high), ("float", low, high), ("log_float", low, high)."""
    draw = random.Random(seed)
    pick = {"int": draw.randint, "float": draw.uniform, "log_float": lambda a, b: 10 ** draw.uniform(a, b)}
    best: tuple[dict, float] | None = None
    for _ in range(rounds):
        config = {name: pick[kind](low, high) for name, (kind, low, high) in space.items()}
        score = evaluate(config)
        if best is None or score > best[1]:
            best = (config, score)
    if best is None:
        raise ValueError("no rounds")
    return best


def run_ablation(configs: dict[str, dict], folds: DataFrame, baseline: str, runner) -> list[tuple[str, int, float]]:
    """(experiment, fold, score) of every config on the same folds, the baseline first; ``runner(config, folds)`` gives
    (fold, score) pairs. Unknown baselines and runs on other folds raise."""
    if baseline not in configs:
        raise ValueError(f"no baseline {baseline!r}")
    expected = sorted(r[0] for r in folds.select("fold").distinct().collect())
    out = []
    for name in [baseline, *[c for c in configs if c != baseline]]:
        scores = list(runner(configs[name], folds))
        if sorted(f for f, _ in scores) != expected:
            raise ValueError(f"{name} ran on other folds")
        out += [(name, f, s) for f, s in scores]
    return out


@dataclass
class Ablation:
    """``summary``: a row per experiment; ``fold_metrics``: a row per experiment and fold; the runs by name."""

    summary: DataFrame
    fold_metrics: DataFrame
    results: dict[str, Validation]
    fingerprint: str


def run_prepared_ablation(configs: dict[str, Prepared], folds: DataFrame, baseline: str, runner: Callable[[Prepared, DataFrame], Validation] | None = None, model: str = "gbt", config: dict | None = None, seed: int = 42) -> Ablation:
    """Every experiment on the same folds, the baseline first, and its differences to the baseline fold by fold.

    Raises before anything is fitted if targets, ids or columns of an experiment differ from the baseline's, and after a
    run if it used other folds or didn't score every row of the baseline exactly once.
    """
    if not configs:
        raise ValueError("no experiments")
    if baseline not in configs:
        raise ValueError(f"unknown baseline {baseline!r}")
    if not folds.limit(1).count():
        raise ValueError("no folds")
    check_same_rows(configs, baseline)
    run = runner or (lambda p, f: cross_validate(p.train, f, p.key, p.target, p.features, model, config, seed, p.test))
    base, results, print_of = configs[baseline], {}, fold_fingerprint(folds, configs[baseline].key)
    for name in [baseline, *[c for c in configs if c != baseline]]:
        result = run(configs[name], folds)
        if result.fingerprint != print_of:
            raise RuntimeError(f"{name} ran on other folds")
        met = check_coverage(result.oof, base.train, base.key, "score").first()
        if met.covered_once != met.expected or met.repeated or met.extra or met.invalid:
            raise RuntimeError(f"{name}: not every row was scored exactly once: {met.asDict()}")
        results[name] = result
    first, lines, summary = results[baseline], [], []
    for name, r in results.items():
        if [f for f, _ in r.fold_scores] != [f for f, _ in first.fold_scores]:
            raise RuntimeError(f"{name}: other folds are scored than the baseline's")
        deltas = [s - b for (_, s), (_, b) in zip(r.fold_scores, first.fold_scores, strict=True)]
        summary.append((name, len(configs[name].features), r.mean_auc, r.std_auc, r.oof_auc, r.oof_auc - first.oof_auc, sum(d > 0 for d in deltas), r.runtime, print_of))
        lines += [(name, f, s, d, n, print_of) for (f, s), d, n in zip(r.fold_scores, deltas, r.best_iterations, strict=True)]
    make = base.train.sparkSession.createDataFrame
    return Ablation(
        make(summary, "experiment string, n_features int, mean_fold_auc double, std_fold_auc double, oof_auc double, delta_oof_auc double, positive_folds int, runtime_seconds double, fold_fingerprint string"),
        make(lines, "experiment string, fold int, auc double, delta double, best_iteration int, fold_fingerprint string"),
        results,
        print_of,
    )
