"""Declared aggregates: which column, which statistics, which family, under which name.

A spec is text, one line per column: ``family  NAME=COLUMN  stat stat ...`` (``NAME=`` only where it differs). Outputs
are prefix + NAME + _ + statistic. Sums come in two kinds: ``sum`` gives 0 where nothing was observed, ``sum_observed``
NULL; both end in SUM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

STATS = ("count", "sum", "sum_observed", "mean", "min", "max", "last", "nunique", "std", "var")
# The marks.
UNSAFE = '"\\[]{}:,'


def safe_name(name):
    """Marks that model and file formats don't take become underscores: in one name, or in a column of names."""
    if isinstance(name, Column):
        return F.translate(name, UNSAFE, "_" * len(UNSAFE))
    return name.translate(str.maketrans(UNSAFE, "_" * len(UNSAFE)))


@dataclass(frozen=True)
class Agg:
    name: str
    column: str
    stat: str
    family: str

    def over(self, order: Column | None = None, where: Column | None = None) -> Column:
        """The aggregate, over the rows that meet ``where``; ``last`` is the last observed in ``order``."""
        x = F.col(self.column)
        x = x if where is None else F.when(where, x)
        if self.stat == "last":
            if order is None:
                raise ValueError(f"{self.name}: last needs an order")
            return F.max_by(x, F.when(x.isNotNull(), order)).alias(self.name)
        made = {
            "count": lambda: F.count(x),
            "sum": lambda: F.coalesce(F.sum(x), F.lit(0)),
            "sum_observed": lambda: F.sum(x),
            "mean": lambda: F.avg(x),
            "min": lambda: F.min(x),
            "max": lambda: F.max(x),
            "nunique": lambda: F.count_distinct(x),
            "std": lambda: F.stddev_samp(x),
            "var": lambda: F.var_samp(x),
        }[self.stat]()
        return made.alias(self.name)

    def sql(self) -> str:
        """The same in SQL (without last)."""
        x = self.column
        text = {"count": f"count({x})", "sum": f"coalesce(sum({x}), 0)", "sum_observed": f"sum({x})", "mean": f"avg({x})", "nunique": f"count(DISTINCT {x})", "std": f"stddev_samp({x})", "var": f"var_samp({x})"}
        return f"{text.get(self.stat, f'{self.stat}({x})')} AS {self.name}"


def specs(text: str, prefix: str = "") -> list[Agg]:
    """The aggregates of a spec; unknown statistics and repeated outputs raise."""
    out = []
    for line in filter(str.strip, text.splitlines()):
        family, column, *stats = line.split()
        name, _, column = column.rpartition("=") if "=" in column else (column, "", column)
        for stat in stats:
            if stat not in STATS:
                raise ValueError(f"unknown statistic {stat!r}")
            out.append(Agg(safe_name(f"{prefix}{name}_{stat.removesuffix('_observed').upper()}"), column, stat, family))
    names = [a.name for a in out]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated outputs: {sorted({n for n in names if names.count(n) > 1})}")
    return out


def families(aggs: list[Agg]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a in aggs:
        out.setdefault(a.family, []).append(a.name)
    return out


def aggregate(df: DataFrame, keys: list[str], aggs: list[Agg], order: Column | None = None, more: list[Column] | None = None) -> DataFrame:
    """One group-by for all ``aggs``; NULL keys are a group. Columns that are not there raise."""
    missing = [c for c in [*keys, *dict.fromkeys(a.column for a in aggs)] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.groupBy(*keys).agg(*[a.over(order) for a in aggs], *(more or []))


def one_hot(column: str, categories: list[str], prefix: str) -> list[Column]:
    """Counts of the declared categories and of OTHER (undeclared and NULL), as aggregates with fixed names."""
    x = F.col(column)
    out = [F.sum(F.when(x == c, 1).otherwise(0)).cast("int").alias(safe_name(f"{prefix}_{c}_COUNT")) for c in categories]
    return [*out, F.sum(F.when(F.coalesce(x.isin(categories), F.lit(False)), 0).otherwise(1)).cast("int").alias(f"{prefix}_OTHER_COUNT")]


def one_hot_counts(df: DataFrame, key: str, column: str, categories: list[str], prefix: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*one_hot(column, categories, prefix))


def fill_counts(df: DataFrame, names: list[str], kind: str = "int") -> DataFrame:
    """NULL becomes 0 in the named columns only."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(kind) for c in names})


def assert_unique_key(df: DataFrame, key: list[str] | str, context: str) -> None:
    keys = [key] if isinstance(key, str) else key
    repeated = df.groupBy(*keys).count().agg(F.sum(F.col("count") - 1)).first()[0] or 0
    if repeated:
        raise ValueError(f"{context}: {repeated} repeated keys in {keys}")


def merge_features(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """An equi join on one key; other columns in common raise."""
    shared = (set(left.columns) & set(right.columns)) - {on}
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    return left.join(right, on, how)


def merge_blocks(base: DataFrame, blocks: dict[str, DataFrame], key: str, keep: dict[str, list[str]] | None = None) -> DataFrame:
    """``base`` left-joined with each block, each cut to the columns ``keep`` names for it."""
    out = base
    for name, block in blocks.items():
        if key not in block.columns:
            raise ValueError(f"block {name} has no {key}")
        out = merge_features(out, block.select(key, *keep[name]) if keep and name in keep else block, key)
    return out


def joined_one_to_one(left: DataFrame, right: DataFrame, key: list[str] | str) -> DataFrame:
    """A left join that can't add rows: both keys must be unique."""
    assert_unique_key(left, key, "left")
    assert_unique_key(right, key, "right")
    return left.join(right, key, "left")


def trimmed_mean(x: Column) -> Column:
    """Without one least and one greatest value; NULL for fewer than three."""
    return F.when(F.count(x) > 2, (F.sum(x) - F.min(x) - F.max(x)) / (F.count(x) - 2))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that its next run measures on the way, without a job of their own, and where to get them.

    In Spark 4.1 a session that has observed something can't send a model with a training summary (a logistic one) to
    its tasks any more; observe frames of a ``newSession()`` where such models are used too.
    """
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen
