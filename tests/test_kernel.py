"""Numbers, declared aggregates and ordered aggregates on hand-checked frames."""

import pytest
from pyspark.sql import functions as F

from riskloom.functions import numeric as N
from riskloom.operators import aggregation as A
from riskloom.operators import ordered as O


def one(spark, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} double" for n in names))
    return lambda c: df.select(c.alias("x")).first()[0]


def test_division_never_raises(spark):
    get = one(spark, a=1.0, zero=0.0, none=None, nan=float("nan"), inf=float("inf"))
    col = F.col
    assert get(N.safe_divide(col("a"), col("zero"))) is None
    assert get(N.safe_divide(col("a"), col("none"))) is None
    assert get(N.safe_divide(col("nan"), col("a"))) is None
    assert get(N.plain_divide(col("inf"), col("a"))) is None
    assert get(N.safe_divide(col("a"), F.lit(3.0))) == pytest.approx(1 / 3, rel=1e-7)
    assert get(N.float32(F.lit("abc"))) is None


def test_row_statistics_skip_missing(spark):
    get = one(spark, a=1.0, b=None, c=4.0)
    x = [F.col("a"), F.col("b"), F.col("c")]
    assert get(N.row_mean(*x)) == 2.5 and get(N.row_median(*x)) == 2.5 and get(N.row_min(*x)) == 1 and get(N.row_max(*x)) == 4
    assert get(N.row_std(*x)) == pytest.approx(2.1213203) and get(N.row_product(*x)) == 4 and get(N.row_count(*x)) == 2
    assert get(N.row_std(F.col("a"), F.col("b"))) is None and get(N.row_product(F.col("a"), F.col("b"))) is None
    assert get(N.row_sum(F.col("b"))) == 0 and get(N.row_sum(F.col("b"), least=1)) is None and get(N.row_mean(F.col("b"))) is None


def test_flags_and_clamps(spark):
    get = one(spark, a=-3.0, none=None, sentinel=365243.0)
    assert get(N.flag(F.col("none") > 0)) == 0 and get(N.at_least_zero(F.col("a"))) == 0 and get(N.at_least_zero(F.col("none"))) is None
    assert get(N.without_sentinel(F.col("sentinel"))) is None


def test_infinities_are_found(spark):
    with pytest.raises(ValueError, match="infinite"):
        N.assert_finite(spark.createDataFrame([(float("inf"),)], "x double"))
    N.assert_finite(N.clean(spark.createDataFrame([(float("inf"),), (float("nan"),)], "x double")))


AMOUNTS = [(1, None, 0), (1, None, 0), (2, 10.0, 1), (2, None, 1)]


def test_missing_is_not_zero(spark):
    df = spark.createDataFrame(AMOUNTS, "k int, AMOUNT double, FLAG int")
    got = {r.k: r for r in A.aggregate(df, ["k"], A.specs("a AMOUNT sum_observed\na PLAIN=AMOUNT sum\na FLAG sum")).collect()}
    assert got[1].AMOUNT_SUM is None and got[1].PLAIN_SUM == 0 and got[1].FLAG_SUM == 0 and got[2].AMOUNT_SUM == 10


def test_specs_refuse_nonsense(spark):
    for bad in ("a x mode", "a x sum sum_observed", "a x=y sum\na x=z sum"):
        with pytest.raises(ValueError):
            A.specs(bad)
    df = spark.createDataFrame(AMOUNTS, "k int, AMOUNT double, FLAG int")
    with pytest.raises(ValueError, match="missing"):
        A.aggregate(df, ["k"], A.specs("a NOPE sum"))
    with pytest.raises(ValueError, match="order"):
        A.aggregate(df, ["k"], A.specs("a AMOUNT last"))


def test_schema_does_not_depend_on_data(spark):
    df = spark.createDataFrame(AMOUNTS, "k int, AMOUNT double, FLAG int")
    spec = A.specs("a AMOUNT count sum mean std nunique")
    assert A.aggregate(df, ["k"], spec).schema == A.aggregate(df.limit(0), ["k"], spec).schema


def test_one_hot_counts_unknown_and_missing_as_other(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "z"), (2, "a:b")], "k int, c string")
    got = {r.k: r.asDict() for r in A.one_hot_counts(df, "k", "c", ["a", "a:b"], "C").collect()}
    assert got[1] == {"k": 1, "C_a_COUNT": 1, "C_a_b_COUNT": 0, "C_OTHER_COUNT": 2} and got[2]["C_a_b_COUNT"] == 1


def test_joins_are_checked(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 3), (1, 4)], "k int, y int")
    with pytest.raises(ValueError, match="repeated"):
        A.joined_one_to_one(a, b, "k")
    with pytest.raises(ValueError, match="both sides"):
        A.merge_features(a, a.withColumn("y", F.lit(1)), "k")
    with pytest.raises(ValueError, match="has no"):
        A.merge_blocks(a, {"b": b.drop("k")}, "k")


@pytest.mark.parametrize("parts", [1, 5])
def test_streaks_in_any_partitioning(spark, parts):
    flags = [0, 1, 1, 0, 1, 0, 1, 1, 1]
    rows = [(1, t, f) for t, f in enumerate(flags)] + [(2, 0, 0), (3, 0, 1), (4, 0, None)]
    df = spark.createDataFrame(rows, "k int, t int, f int").repartition(parts)
    got = {r.k: (r.longest, r.episodes) for r in O.streaks(df, ["k"], ["t"], "f", "longest", "episodes").collect()}
    assert got == {1: (3, 3), 2: (0, 0), 3: (1, 1), 4: (0, 0)}


def test_slopes(spark):
    series = {1: [1, 2, 3, 4], 2: [4, 3, 2, 1], 3: [5, 5, 5], 4: [7], 5: [1, None, 2, None, 3], 6: [None, None]}
    rows = [(k, t, None if v is None else float(v)) for k, vs in series.items() for t, v in enumerate(vs)]
    got = {r.k: r.s for r in O.slopes(spark.createDataFrame(rows, "k int, t int, v double"), ["k"], [F.col("t")], {"v": "s"}).collect()}
    assert got == {1: 1, 2: -1, 3: 0, 4: None, 5: 1, 6: None}


def test_newest(spark):
    df = spark.createDataFrame([(1, t) for t in range(5)], "k int, t int")
    assert sorted((r.t, r["_rank"]) for r in O.newest(df, ["k"], [F.desc("t")], 2).collect()) == [(3, 2), (4, 1)]
