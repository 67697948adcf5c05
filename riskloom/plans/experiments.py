"""Registered experiments over the application features, prepared and compared on one set of folds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from riskloom.operators.evaluation import stratified_folds
from riskloom.operators.modeling import Ablation, Validation, run_prepared_ablation
from riskloom.operators.prepared import Prepared, prepare
from riskloom.plans.application import FAMILIES, factorial, first_set, second_set

# Experiments by name, in their order, with their families or factors.
FAMILY_EXPERIMENTS = {
    "E01_locked": (),
    "E02-A_credit_amount": ("ratios",),
    "E02-B_age_employment": ("age_employment",),
    "E02-C_external_sources": ("external_sources",),
    "E02-D_application_contact": ("application_contact",),
    "E02-E_housing": ("housing",),
    "E02-ALL": tuple(FAMILIES),
}
FACTOR_EXPERIMENTS = {"E01_LOCKED": "", "E02-N": "N", "E02-R": "R", "E02-D": "D", "E02-RD": "RD", "E02-NR": "NR", "E02-ND": "ND", "E02-NRD": "NRD"}


def resolve(registry: Mapping[str, Sequence[str]], selected: Sequence[str] | None = None) -> dict[str, Sequence[str]]:
    """The chosen experiments in the registry's order; unknown or repeated names, or no baseline (the first), raise."""
    asked = list(registry if selected is None else selected)
    unknown = sorted(set(asked) - set(registry))
    if unknown:
        raise ValueError(f"unknown experiments: {unknown}")
    if len(asked) != len(set(asked)):
        raise ValueError("experiment names must be unique")
    baseline = next(iter(registry))
    if baseline not in asked:
        raise ValueError(f"the baseline {baseline} must be among them")
    return {name: what for name, what in registry.items() if name in asked}


def builder(registry: Mapping[str, Sequence[str]], name: str) -> Callable[[DataFrame], DataFrame]:
    """What makes the features of a registered experiment."""
    chosen = registry[name]
    if registry is FACTOR_EXPERIMENTS:
        return lambda df: factorial(df, chosen)
    return (lambda df: second_set(df, list(chosen))) if chosen else first_set


def run(train: DataFrame, test: DataFrame, registry: Mapping[str, Sequence[str]] = FAMILY_EXPERIMENTS, selected: Sequence[str] | None = None, folds: int = 5, seed: int = 42, runner: Callable[[Prepared, DataFrame], Validation] | None = None, **model) -> Ablation:
    """The chosen experiments of a registry on the same folds, compared with its baseline."""
    chosen = resolve(registry, selected)
    prepared = {name: prepare(train, test, builder(registry, name)) for name in chosen}
    dealt = stratified_folds(train, "SK_ID_CURR", "TARGET", folds, seed).select("SK_ID_CURR", "fold")
    return run_prepared_ablation(prepared, dealt, next(iter(chosen)), runner, seed=seed, **model)


def compare_sets(train: DataFrame, test: DataFrame, families: Sequence[str] | None = None, folds: int = 5, seed: int = 42, runner: Callable[[Prepared, DataFrame], Validation] | None = None, **model) -> dict:
    """The first feature set against the second (all families, or those named): both arms' metrics and what was added."""
    chosen = list(FAMILIES if families is None else families)
    arms = {"first": prepare(train, test, first_set), "second": prepare(train, test, lambda df: second_set(df, chosen))}
    dealt = stratified_folds(train, "SK_ID_CURR", "TARGET", folds, seed).select("SK_ID_CURR", "fold")
    out = run_prepared_ablation(arms, dealt, "first", runner, seed=seed, **model)
    a, b = (out.results[name] for name in arms)
    of = lambda v: {"fold_scores": [s for _, s in v.fold_scores], "mean_auc": v.mean_auc, "std_auc": v.std_auc, "oof_auc": v.oof_auc, "runtime_seconds": v.runtime, "fold_fingerprint": v.fingerprint}
    return {
        "first": of(a),
        "second": of(b),
        "delta_mean_auc": b.mean_auc - a.mean_auc,
        "delta_oof_auc": b.oof_auc - a.oof_auc,
        "feature_counts": {name: len(p.features) for name, p in arms.items()},
        "features_added": [c for c in arms["second"].features if c not in arms["first"].features],
        "families": chosen,
    }
