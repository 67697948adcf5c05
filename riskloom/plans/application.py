"""Row-wise application features: the first set, the second set with its families, and three single changes (N, R, D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import clean, flag, float32, pair_features, plain_divide, require, row_count, row_max, row_mean, row_median, row_min, row_product, row_std, row_sum, safe_divide, starting_with, without_sentinel
from riskloom.operators.prepared import aligned  # noqa: F401

# Source columns.
EXTERNAL = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
CONTACTS = ["FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL"]
HOUSING_MEAN = ["APARTMENTS_AVG", "BASEMENTAREA_AVG", "YEARS_BEGINEXPLUATATION_AVG", "ELEVATORS_AVG", "WALLSMATERIAL_MODE"]
HOUSING_BASES = ["APARTMENTS", "BASEMENTAREA", "YEARS_BEGINEXPLUATATION", "YEARS_BUILD", "COMMONAREA", "ELEVATORS", "ENTRANCES", "FLOORSMAX", "FLOORSMIN", "LANDAREA", "LIVINGAPARTMENTS", "LIVINGAREA", "NONLIVINGAPARTMENTS", "NONLIVINGAREA"]
RATIOS = {
    "CREDIT_INCOME_RATIO": ("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "ANNUITY_INCOME_RATIO": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "ANNUITY_CREDIT_RATIO": ("AMT_ANNUITY", "AMT_CREDIT"),
    "GOODS_CREDIT_RATIO": ("AMT_GOODS_PRICE", "AMT_CREDIT"),
    "EMPLOYED_BIRTH_RATIO": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "CHILDREN_RATIO": ("CNT_CHILDREN", "CNT_FAM_MEMBERS"),
}
FOUR = ["CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "GOODS_CREDIT_RATIO", "INCOME_PER_PERSON"]
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def _ratio(name: str) -> Column:
    return safe_divide(*map(F.col, RATIOS[name]))


def first_set(df: DataFrame) -> DataFrame:
    """The sentinel's flag, eight ratios, statistics and pairs of the external scores, three summaries."""
    require(df, [*{c for pair in RATIOS.values() for c in pair}, "OWN_CAR_AGE", *EXTERNAL])
    out = clean(df.withColumn("DAYS_EMPLOYED_ANOMALOUS", flag(F.col("DAYS_EMPLOYED") == 365243)).withColumn("DAYS_EMPLOYED", without_sentinel(F.col("DAYS_EMPLOYED"))))
    out = out.withColumns({name: plain_divide(F.col(a), F.col(b)) for name, (a, b) in RATIOS.items()} | {"CAR_BIRTH_RATIO": plain_divide(F.col("OWN_CAR_AGE"), F.abs("DAYS_BIRTH"))})
    x = [F.col(c) for c in EXTERNAL]
    # Fixed values here and in the families below: the features' names.
    made = {"MEAN": row_mean(*x), "MEDIAN": row_median(*x), "MIN": row_min(*x), "MAX": row_max(*x), "STD": row_std(*x), "MISSING_COUNT": F.lit(len(x)) - row_count(*x), "PRODUCT": row_product(*x), "RANGE": row_max(*x) - row_min(*x)}
    out = out.withColumns({f"EXT_SOURCE_{k}": v for k, v in made.items()} | pair_features(EXTERNAL))
    contacts = [F.col(c) for c in CONTACTS if c in df.columns]
    if not contacts:
        raise ValueError("no known contact flag")
    out = out.withColumns({"DOCUMENT_FLAG_COUNT": row_sum(*map(F.col, starting_with(df, "FLAG_DOCUMENT_"))), "CONTACT_FLAG_COUNT": row_sum(*contacts)})
    kinds = dict(df.dtypes)
    housing = [F.col(c) for c in HOUSING_MEAN if kinds.get(c) in NUMBERS]
    return out.withColumn("HOUSING_AVG_MEAN", row_mean(*housing)) if housing else out


def _ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({name: _ratio(name) for name in FOUR} | {"CREDIT_ANNUITY_RATIO": safe_divide(F.col("AMT_CREDIT"), F.col("AMT_ANNUITY")), "CREDIT_GOODS_DIFF": float32(F.col("AMT_CREDIT") - F.col("AMT_GOODS_PRICE"))})


def _ages(df: DataFrame) -> DataFrame:
    df = df.withColumn("DAYS_EMPLOYED", without_sentinel(F.col("DAYS_EMPLOYED")))
    years = lambda c: float32(-F.col(c) / 365.25)
    return df.withColumns({"AGE_YEARS": years("DAYS_BIRTH"), "EMPLOYED_YEARS": years("DAYS_EMPLOYED"), "EMPLOYED_AGE_RATIO": safe_divide(F.col("DAYS_EMPLOYED"), F.col("DAYS_BIRTH"))})


def _external(df: DataFrame) -> DataFrame:
    x = [float32(F.col(c)) for c in EXTERNAL]
    made = {"MEAN": row_mean(*x), "MIN": row_min(*x), "MAX": row_max(*x), "STD": row_std(*x)}
    return df.withColumns({f"EXT_SOURCE_{k}": float32(v) for k, v in made.items()} | {"EXT_SOURCE_COUNT": row_count(*x).cast("tinyint")})


def _contact(df: DataFrame) -> DataFrame:
    documents, contacts = [F.col(c) for c in starting_with(df, "FLAG_DOCUMENT_")], [F.col(c) for c in CONTACTS if c in df.columns]
    if not contacts:
        raise ValueError("no known contact flag")
    return df.withColumns({"DOCUMENT_COUNT": row_sum(*documents, least=1).cast("float"), "CONTACT_COUNT": row_sum(*contacts, least=1).cast("float"), "PHONE_CHANGE_YEARS": float32(-F.col("DAYS_LAST_PHONE_CHANGE") / 365.25), "CHILDREN_RATIO": _ratio("CHILDREN_RATIO")})


def _housing(df: DataFrame) -> DataFrame:
    whole = [b for b in HOUSING_BASES if all(f"{b}_{s}" in df.columns for s in ("AVG", "MODE", "MEDI"))]
    made = {}
    for s in ("AVG", "MODE", "MEDI") if whole else ():
        x = [float32(F.col(f"{b}_{s}")) for b in whole]
        made |= {f"HOUSING_NUMERIC_{s}_{k}": float32(f(*x)) for k, f in (("MEAN", row_mean), ("MIN", row_min), ("MAX", row_max))}
    return df.withColumns(made) if made else df


FAMILIES = {"ratios": _ratios, "age_employment": _ages, "external_sources": _external, "application_contact": _contact, "housing": _housing}


def second_set(df: DataFrame, families: list[str] | None = None) -> DataFrame:
    """The first set and the chosen families, in the registry's order; unknown names raise."""
    chosen = list(FAMILIES) if families is None else list(dict.fromkeys(families))
    unknown = [f for f in chosen if f not in FAMILIES]
    if unknown:
        raise ValueError(f"unknown families: {unknown}")
    out = first_set(df)
    for name, build in FAMILIES.items():
        out = build(out) if name in chosen else out
    return out


def factorial(df: DataFrame, factors: str) -> DataFrame:
    """The first set with any of N (the four ratios in float32), R (credit by annuity), D (credit less goods price)."""
    if set(factors) - set("NRD"):
        raise ValueError(f"unknown factors: {factors}")
    out, added = first_set(df), {}
    if "N" in factors:
        added |= {name: _ratio(name) for name in FOUR}
    new = {}
    if "R" in factors:
        new["CREDIT_ANNUITY_RATIO"] = safe_divide(F.col("AMT_CREDIT"), F.col("AMT_ANNUITY"))
    if "D" in factors:
        new["CREDIT_GOODS_DIFF"] = float32(F.col("AMT_CREDIT") - F.col("AMT_GOODS_PRICE"))
    clash = set(new) & set(out.columns)
    if clash:
        raise ValueError(f"would overwrite {sorted(clash)}")
    return out.withColumns(added | new) if added | new else out
