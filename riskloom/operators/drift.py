"""Drift of many features between two tables: stability index, missing rates and new categories, one row a feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import finite
from riskloom.operators.ranking import quantiles

FLOOR = 1e-4


def feature_drift(reference: DataFrame, actual: DataFrame, columns: list[str], bins: int = 10, floor: float = FLOOR) -> DataFrame:
    """feature, csi, missing_reference, missing_actual, missing_delta, new_share, of each column.

    A number's bins end at exact quantiles of ``reference`` (equal ones are one edge; a value lies above the edges at or
    below it), a text's are its words; missing, NaN and infinite values are a bin of their own. Shares are at least
    ``floor``. new_share: rows of ``actual`` with a bin that ``reference`` has not. Both tables are read once for all
    histograms, after the passes for the quantiles; an empty table has no shares, so its figures are NULL.
    """
    kinds = dict(reference.dtypes)
    lacking = [c for c in columns if c not in kinds or c not in actual.columns]
    if lacking or not columns:
        raise ValueError(f"missing columns: {lacking}" if lacking else "no columns")
    numbers = [c for c in columns if kinds[c] != "string"]
    edges = {c: sorted({q for q in o["quantiles"] if q is not None}) for c, o in quantiles(reference, numbers, [k / bins for k in range(1, bins)]).items()}

    def bin_of(c: str):
        if c not in edges:
            return F.col(c)
        v = finite(F.col(c).cast("double"))
        return F.when(v.isNotNull(), sum(((v >= e).cast("int") for e in edges[c]), F.lit(0)).cast("string"))

    histogram = None
    for side, df in (("r", reference), ("a", actual)):
        at = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in columns])).alias("x"))
        counts = at.groupBy("x.feature", "x.bin").agg(F.count("*").alias(side))
        histogram = counts if histogram is None else histogram.join(counts, (histogram["feature"] == counts["feature"]) & histogram["bin"].eqNullSafe(counts["bin"]), "full").select(F.coalesce(histogram["feature"], counts["feature"]).alias("feature"), F.coalesce(histogram["bin"], counts["bin"]).alias("bin"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("a", F.lit(0)).alias("a"))
    totals = histogram.groupBy("feature").agg(F.sum("r").alias("all_r"), F.sum("a").alias("all_a"))
    both = histogram.join(F.broadcast(totals), "feature")  # a row per feature
    r, a = (F.try_divide(F.col(x), F.col(f"all_{x}")) for x in ("r", "a"))
    low, high = F.greatest(r, F.lit(floor)), F.greatest(a, F.lit(floor))
    missing = lambda x: F.coalesce(F.sum(F.when(F.col("bin").isNull(), x)), F.lit(0.0))
    known = (F.first("all_r") > 0) & (F.first("all_a") > 0)
    made = {"csi": F.sum((high - low) * F.log(high / low)), "missing_reference": missing(r), "missing_actual": missing(a), "missing_delta": missing(a) - missing(r), "new_share": F.coalesce(F.sum(F.when(F.col("r") == 0, a)), F.lit(0.0))}
    return both.groupBy("feature").agg(*[F.when(known, v).alias(k) for k, v in made.items()])
