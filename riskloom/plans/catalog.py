"""What the features and metrics are, as data; ``python -m riskloom.plans.catalog`` writes it as Markdown."""

from __future__ import annotations

import re
from dataclasses import dataclass

from riskloom.plans import marts as M

# Metrics and their direction (1: more is better).
METRICS = {
    "roc_auc": ("chance that a bad case scores above a good one, ties half", 1),
    "pr_auc": ("precision summed over the gain in recall", 1),
    "gini": ("2 roc_auc - 1", 1),
    "ks": ("greatest gap between the score distributions of good and bad", 1),
    "log_loss": ("mean negative log likelihood", -1),
    "brier": ("mean squared difference of score and outcome", -1),
    "psi": ("shift of a distribution over bins", -1),
    "approval_rate": ("share below the cutoff", 0),
    "bad_rate": ("share of bad cases", 0),
    "capture_rate": ("share of bad cases at or above the cutoff", 1),
}


@dataclass(frozen=True)
class Feature:
    block: str
    name: str
    family: str
    formula: str
    missing: str


# Features that no spec declares, by pattern: family, formula, what missing means.
DERIVED = {
    "bureau": [
        (r"BUREAU_CTYPE_.*_COUNT", "counts", "loans of the type", "0"),
        (r"BUREAU_LOANS_WITH_DPD_COUNT", "counts", "loans with a month past due", "0"),
        (r"BUREAU_ACTIVE_LOAN_RATIO", "counts", "ACTIVE_LOAN_COUNT / LOAN_COUNT", "NULL"),
        (r"BUREAU_(ACTIVE_UTILIZATION|.*_RATIO_TOTAL)", "amounts", "ratio of sums", "NULL"),
    ],
    "previous_application": [
        (r"PREV_(CONTRACT|YIELD)_.*_COUNT", "counts", "applications of the kind", "0"),
        (r"PREV_RECENT_REFUSAL_COUNT", "counts", "refusals within 365 days", "0"),
        (r"PREV_HAS_RECENT_REFUSAL", "counts", "PREV_RECENT_REFUSAL_COUNT > 0", "never"),
        (r"PREV_AMT_APPLICATION_TREND", "amounts", "slope over the last 5 applications", "NULL under 2"),
    ],
    "installments": [
        (r"INST_LOANS_WITH_LATE_COUNT", "counts", "loans with a late payment", "0"),
        (r"INST_\d+D_COUNT", "counts", "instalments in the window", "NULL"),
        (r"INST_(UNDERPAYMENT|PAYMENT_RATIO)_\d+D_(SUM|MEAN)|INST_LAST\d_PAYMENT_RATIO_MEAN|INST_PAYMENT_RATIO_TREND_SLOPE", "amounts", "over the window, the last payments, or their trend", "NULL"),
        (r"INST_(DPD|LATE|LATE_RATE)_(\d+D.*|LIFETIME|RECENT_MINUS_LIFE_\d+D|TREND_SLOPE)|INST_LAST\d_.*", "delinquency", "over the window, against the lifetime, over the last payments, or their trend", "NULL"),
        (r"INST_DAYS_SINCE_LAST_LATE", "recency", "- latest late due day", "NULL"),
    ],
    "credit_card": [(r"CC_PORTFOLIO_.*", "amounts", "last observed balance and limit of each card, summed; their ratio", "NULL")],
    "pos_cash": [
        (r"POS_CONTRACTS_WITH_DPD_COUNT", "counts", "contracts with a month past due", "0"),
        (r"POS_COMPLETION_RATE", "counts", "completed / contracts", "NULL"),
        (r"POS_DPD_CONTRACT_RATIO", "delinquency", "contracts past due / contracts", "NULL"),
    ],
}
SPECS = {"bureau": M.BUREAU + M.ACTIVE, "previous_application": M.PREVIOUS + M.APPROVED, "installments": M.INSTALMENT_CLIENT + M.LIFETIME, "credit_card": M.CARD_CLIENT + M.CARD_RECENT, "pos_cash": M.POS_CLIENT + M.POS_RECENT}


def describe(block: str, columns: list[str]) -> list[Feature]:
    """An entry per output column of a block; a column that nothing describes raises."""
    declared = {a.name: Feature(block, a.name, a.family, f"{a.stat}({a.column})", "0" if a.stat in ("sum", "count") else "NULL") for a in SPECS[block]}
    out, unknown = [], []
    for name in columns:
        if name == M.CLIENT:
            continue
        rule = next((r for r in DERIVED[block] if re.fullmatch(r[0], name)), None)
        if name in declared:
            out.append(declared[name])
        elif rule:
            out.append(Feature(block, name, *rule[1:]))
        else:
            unknown.append(name)
    if unknown:
        raise ValueError(f"{block}: nothing describes {unknown}")
    return out


def family_map(block: str, columns: list[str]) -> dict[str, str]:
    return {f.name: f.family for f in describe(block, columns)}


def markdown(blocks: dict[str, list[str]]) -> str:
    lines = []
    for block, columns in blocks.items():
        lines += [f"## {block} ({M.VERSIONS[block]})", "", "| Feature | Family | Formula | Missing |", "|-|-|-|-|"]
        lines += [f"| {f.name} | {f.family} | {f.formula} | {f.missing} |" for f in describe(block, columns)] + [""]
    lines += ["## Metrics", "", "| Metric | Meaning |", "|-|-|", *[f"| {k} | {v[0]} |" for k, v in METRICS.items()]]
    return "\n".join(lines)


if __name__ == "__main__":
    print(markdown({b: [a.name for a in s] for b, s in SPECS.items()}))
