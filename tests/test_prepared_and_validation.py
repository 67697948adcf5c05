"""Prepared tables, full cross-validation and ablations on small frames."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluation as E
from riskloom.operators import modeling as L
from riskloom.operators import prepared as R

WORDS = ["b", "a", "Z", "ä", "", None, "a b"]


def tables(spark, n=60, seed=0):
    r = random.Random(seed)
    rows = [(k, k % 2, r.choice(WORDS), r.random() if k % 7 else None) for k in range(n)]
    train = spark.createDataFrame(rows, "id long, y int, w string, x double")
    test = spark.createDataFrame([(1000 + k, r.random(), r.choice([*WORDS, "only here"])) for k in range(20)], "id long, x double, w string")
    return train, test


def same(df):
    return df


def test_prepared_tables_share_order_and_codes(spark):
    train, test = tables(spark)
    p = R.prepare(train, test, same, "id", "y")
    assert p.train.columns == ["id", "w", "x", "y"] and p.test.columns == ["id", "w", "x"] and p.categorical == ["w"]
    words = sorted({x.w for df in (train, test) for x in df.collect()} - {None}, key=lambda w: w.encode())
    code = {w: k for k, w in enumerate(words)}
    assert {(x.word, x.code) for x in p.vocabulary.collect()} == set(code.items())
    for raw, made in ((train, p.train), (test, p.test)):
        want = {x.id: code.get(x.w) for x in raw.collect()}
        assert {x.id: x.w for x in made.collect()} == want
    later = spark.createDataFrame([(1, "never met"), (2, None), (3, "a")], "id long, w string")
    assert {x.id: x.w for x in R.encode(later, p.vocabulary, ["w"], {"w": 10**9}).collect()} == {1: R.UNSEEN, 2: None, 3: code["a"]}


def test_two_text_columns_are_numbered_apart(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y")], "p string, q string")
    got = {(x.column, x.word): x.code for x in R.vocabulary([df, df], ["p", "q"]).collect()}
    assert got == {("p", "a"): 0, ("p", "b"): 1, ("q", "x"): 0, ("q", "y"): 1}


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda a, b: (a.withColumn("more", F.lit(1)), b), "predictors differ"),
        (lambda a, b: (a.withColumn("y", F.when(F.col("id") != 3, F.col("y"))), b), "must be 0 or 1"),
        (lambda a, b: (a.unionByName(a.limit(1)), b), "unique"),
        (lambda a, b: (a, b.withColumn("id", F.lit(None).cast("long"))), "unique"),
        (lambda a, b: (a.drop("y"), b), "missing columns"),
        (lambda a, b: (a, b.withColumn("x", F.lit(float("inf")))), "infinite"),
        (lambda a, b: (a, b.withColumn("x", F.col("x").cast("string"))), "types differ"),
    ],
)
def test_tables_that_cannot_be_prepared_together(spark, change, said):
    with pytest.raises(ValueError, match=said):
        R.prepare(*change(*tables(spark)), same, "id", "y")


def test_fingerprints_see_rows_types_and_places_but_no_order(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, None, "b"), (2, None, "b"), (3, float("nan"), None)], "k long, v double, s string")
    base = R.fingerprint(df)
    assert R.fingerprint(df.orderBy(F.desc("k")).repartition(3)) == base == R.fingerprint(df.select("s", "k", "v"))
    assert R.fingerprint(df.withColumn("v", -F.col("v"))) == base  # 0.0 and -0.0
    for other in (df.distinct(), df.withColumn("s", F.coalesce("s", F.lit(""))), df.withColumn("k", F.col("k").cast("int")), df.toDF("v", "k", "s"), df.limit(0)):
        assert R.fingerprint(other) != base


def prepared(spark, **changes):
    train, test = tables(spark)
    return R.prepare(changes.get("train", lambda d: d)(train), changes.get("test", lambda d: d)(test), changes.get("build", same), "id", "y")


def result(oof, folds, scores=(0.6, 0.7, 0.8)):
    return L.Validation(oof, list(enumerate(scores, 1)), 0.7, 0.7, 0.1, None, None, [5, 5, 5], E.fold_fingerprint(folds, "id"), [], 0.1)


def test_ablation_refuses_drift_before_fitting(spark):
    base, run = prepared(spark), []
    folds = E.stratified_folds(base.train, "id", "y", 3)
    for other, said in (
        (prepared(spark, train=lambda d: d.withColumn("y", F.when(F.col("id") == 5, 0).otherwise(F.col("y")))), "targets"),
        (prepared(spark, train=lambda d: d.where("id <> 5")), "train ids"),
        (prepared(spark, test=lambda d: d.where("id <> 1005")), "test ids"),
        (R.Prepared(base.train, base.test.drop("x"), "id", "y", ["w"], ["w"], base.vocabulary), "match in order"),
        (R.Prepared(base.train, base.test, "id", "y", ["w", "x"], ["nowhere"], base.vocabulary), "unknown categorical"),
    ):
        with pytest.raises(ValueError, match=said):
            L.run_prepared_ablation({"base": base, "other": other}, folds, "base", lambda p, f: run.append(1))
    with pytest.raises(ValueError, match="unknown baseline"):
        L.run_prepared_ablation({"base": base}, folds, "none")
    with pytest.raises(ValueError, match="no folds"):
        L.run_prepared_ablation({"base": base}, folds.limit(0), "base")
    assert not run


def test_ablation_checks_each_run_and_pairs_its_folds(spark):
    base, more = prepared(spark), prepared(spark, build=lambda d: d.withColumn("x2", F.col("x") * 2))
    folds = E.stratified_folds(base.train, "id", "y", 3)
    full = folds.withColumn("score", F.lit(0.5))
    order = []

    def run(p, f):
        order.append(len(p.features))
        return result(full, f, (0.65, 0.7, 0.75) if "x2" in p.features else (0.6, 0.7, 0.8))

    out = L.run_prepared_ablation({"more": more, "base": base}, folds, "base", run)
    assert order == [2, 3]
    rows = {x.experiment: x for x in out.summary.collect()}
    assert rows["base"].positive_folds == 0 and rows["more"].positive_folds == 1 and rows["more"].n_features == 3
    assert [round(x.delta, 6) for x in out.fold_metrics.where("experiment = 'more'").orderBy("fold").collect()] == [0.05, 0.0, -0.05]
    for oof in (full.where("id <> 4"), full.unionByName(full.limit(1)), full.withColumn("score", F.lit(1.5))):
        with pytest.raises(RuntimeError, match="exactly once"):
            L.run_prepared_ablation({"base": base}, folds, "base", lambda p, f, oof=oof: result(oof, f))
    other = E.stratified_folds(base.train, "id", "y", 3, seed=1)
    with pytest.raises(RuntimeError, match="other folds"):
        L.run_prepared_ablation({"base": base}, folds, "base", lambda p, f: result(full, other))


def test_boosting_stops_early_scores_test_rows_and_tells_importances(spark):
    r = random.Random(4)
    rows = [(k, int(r.random() < 0.5), r.random(), r.choice("ab")) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, x double, w string")
    folds = E.stratified_folds(df, "id", "y", 3)
    test = df.limit(40).select((F.col("id") + 5000).alias("id"), "w", "x")
    v = L.cross_validate(df, folds.drop("y"), "id", "y", ["x", "w"], "gbt", {"maxIter": 25, "maxDepth": 3, "validationTol": 0.0}, test=test)
    assert len(v.best_iterations) == 3 and min(v.best_iterations) < 25  # noise: trees stop helping
    assert E.check_coverage(v.oof, df, "id", "score").first().covered_once == 600
    got = v.test.collect()
    assert len(got) == 40 and all(abs(x.score - (x.score_1 + x.score_2 + x.score_3) / 3) < 1e-12 for x in got)
    rows = [tuple(x) for x in v.importances.collect()]
    con = duckdb.connect()
    con.execute("create table i (feature varchar, fold int, importance double)")
    con.executemany("insert into i values (?, ?, ?)", rows)
    want = con.execute("select feature, avg(importance), coalesce(stddev_samp(importance), 0) from i group by 1 order by 2 desc, 1").fetchall()
    have = [tuple(x) for x in E.importance_summary(v.importances).collect()]
    assert [x[0] for x in have] == [x[0] for x in want] and all(abs(a - b) < 1e-12 for x, y in zip(have, want, strict=True) for a, b in zip(x[1:], y[1:], strict=True))
    with pytest.raises(ValueError, match="missing features"):
        L.cross_validate(df, folds.drop("y"), "id", "y", ["x", "w"], test=test.drop("w"))
    with pytest.raises(ValueError, match="differ in their keys"):
        L.cross_validate(df.where("id > 0"), folds.drop("y"), "id", "y", ["x"])
