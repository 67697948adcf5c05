"""Train and test tables made ready together: the same predictors, one vocabulary for both, no infinities, checked keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import assert_finite
from riskloom.operators.ranking import cumulated
from riskloom.sources.staging import staged

#: A vocabulary column of at most so many words, counted, is broadcast; a larger one is joined by a shuffle.
SMALL = 20_000
UNSEEN = -1


class PreparationError(ValueError):
    """Tables that can't be prepared together."""


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    key: str
    target: str
    features: list[str]
    categorical: list[str]
    vocabulary: DataFrame


def vocabulary(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """column, word, code: of each text column the distinct words of all ``parts``, numbered from 0 in code-point order.

    Missing is no word. Words are made distinct before they are shuffled to their ranges; no task sorts a column.
    """
    if not columns:
        return parts[0].sparkSession.createDataFrame([], "column string, word string, code long")
    words = None
    for df in parts:
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("word")) for c in columns])).alias("at"))
        words = pairs if words is None else words.unionByName(pairs)
    distinct = words.where(F.col("at.word").isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    placed = cumulated(distinct, "at", ["_one"]).select("at.column", "at.word", F.col("_one_before").alias("place"))
    # a row per column
    first = placed.groupBy("column").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "column").select("column", "word", (F.col("place") - F.col("first")).alias("code"))


def encode(df: DataFrame, words: DataFrame, columns: list[str], sizes: dict[str, int]) -> DataFrame:
    """``df`` with each text column as its code: NULL where missing, ``UNSEEN`` where the vocabulary lacks the word.

    ``sizes``: words by column; a join of at most ``SMALL`` words is a broadcast, a larger one is shuffled (and split
    by Spark where one word is very common).
    """
    out = df
    for c in columns:
        own = words.where(F.col("column") == c).select(F.col("word").alias(f"_w_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.join(F.broadcast(own) if sizes.get(c, 0) <= SMALL else own, F.col(c) == F.col(f"_w_{c}"), "left")
    code = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.col(f"_c_{c}"), F.lit(UNSEEN))).cast("long").alias(c)
    return out.select(*[code(c) if c in columns else F.col(c) for c in df.columns])


def require_rows(df: DataFrame, name: str, key: str, target: str | None) -> None:
    """The columns must be there, keys neither missing nor repeated, and the target 0 or 1 in every row: one job."""
    missing = [c for c in (key, target) if c and c not in df.columns]
    if missing:
        raise PreparationError(f"{name} is missing columns: {missing}")
    wrong = F.sum(F.when(F.coalesce(F.col(target).isin(0, 1), F.lit(False)), 0).otherwise(1)) if target else F.lit(0)
    row = df.groupBy(key).agg(F.count("*").alias("n"), wrong.alias("wrong")).agg(F.sum(F.col("n") - 1).alias("repeated"), F.max(F.col(key).isNull()).alias("null"), F.sum("wrong").alias("wrong")).first()
    if row.wrong:
        raise PreparationError(f"{name}: {target} must be 0 or 1 in every row; {row.wrong} are not")
    if row.repeated or row.null:
        raise PreparationError(f"{name}: {key} must be there and unique; {row.repeated} repeated")


def aligned(train: DataFrame, test: DataFrame, build: Callable[[DataFrame], DataFrame], target: str = "TARGET") -> tuple[DataFrame, DataFrame]:
    """Both tables built from the same predictors in the train table's order; different predictors or outputs raise."""
    predictors = [c for c in train.columns if c != target]
    if set(predictors) != set(test.columns) - {target}:
        raise PreparationError(f"predictors differ: {sorted(set(predictors) ^ (set(test.columns) - {target}))}")
    a, b = build(train), build(test.select(*predictors))
    if [c for c in a.columns if c != target] != b.columns:
        raise PreparationError("outputs differ in order")
    kinds = dict(b.dtypes)
    differ = [c for c, t in a.dtypes if c != target and kinds[c] != t]
    if differ:
        raise PreparationError(f"types differ: {differ}")
    return a, b


def prepare(train: DataFrame, test: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "SK_ID_CURR", target: str = "TARGET") -> Prepared:
    """Features of both tables, text coded by their shared vocabulary. The target is used by nothing but its check.

    Empty tables, a missing target, repeated or missing keys, predictors of one table alone and infinite features raise.
    """
    require_rows(train, "train", key, target)
    require_rows(test, "test", key, None)
    made, held = aligned(train, test, build, target)
    features = [c for c in held.columns if c != key]
    text = [c for c, t in held.dtypes if t == "string" and c != key]
    for df in (made, held):
        assert_finite(df)
    words = staged(vocabulary([made, held], text), "vocabulary")  # joined once a column and table
    sizes = {r.column: r.n for r in words.groupBy("column").agg(F.count("*").alias("n")).collect()}
    order = [key, *features]
    return Prepared(encode(made, words, text, sizes).select(*order, F.col(target).cast("int").alias(target)), encode(held, words, text, sizes).select(*order), key, target, features, text, words)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> tuple:
    """Rows, columns, types and three order-free sums of row hashes: equal for equal tables whatever their row order.

    One pass. NULL and NaN count by their place; 0.0 and -0.0 are one value. Two unlike tables agree by chance alone.
    """
    kinds, names = dict(df.dtypes), sorted(columns or df.columns)
    x = [F.struct(F.lit(k).alias("k"), F.coalesce((F.col(f"`{c}`") + F.lit(0)) if kinds[c] in ("double", "float") else F.col(f"`{c}`")).alias("v")) for k, c in enumerate(names)]
    whole = lambda h: F.sum(h.cast("decimal(38,0)"))
    row = df.agg(F.count("*").alias("n"), whole(F.xxhash64(*x)).alias("a"), whole(F.xxhash64(F.lit(1), *x)).alias("b"), F.bit_xor(F.xxhash64(F.lit(2), *x)).alias("c")).first()
    return (row.n, tuple((c, kinds[c]) for c in names), int(row.a or 0), int(row.b or 0), int(row.c or 0))


def check_same_rows(prepared: dict[str, Prepared], baseline: str) -> None:
    """All experiments must hold the baseline's train ids with their targets, its test ids, and the same feature columns
    in both of their tables; names of categorical features must be features."""
    base = prepared[baseline]
    of = lambda p: (fingerprint(p.train, [p.key, p.target]), fingerprint(p.train, [p.key]), fingerprint(p.test, [p.key]))
    want = of(base)
    for name, p in prepared.items():
        own = [c for c in p.train.columns if c not in (p.key, p.target)]
        if own != [c for c in p.test.columns if c != p.key]:
            raise PreparationError(f"{name}: train and test columns must match in order")
        unknown = sorted(set(p.categorical) - set(own))
        if unknown:
            raise PreparationError(f"{name}: unknown categorical columns: {unknown}")
        got = want if p is base else of(p)
        for what, a, b in zip(("targets", "train ids", "test ids"), (got[0], got[1], got[2]), (want[0], want[1], want[2]), strict=True):
            if what == "targets" and got[1] != want[1]:
                continue  # said of the ids
            if a != b:
                raise PreparationError(f"{name}: {what} differ from the baseline's")
