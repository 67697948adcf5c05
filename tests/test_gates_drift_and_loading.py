"""Gates, drift, id filters, archives, diagnostics and registered experiments on small frames."""

import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from riskloom.operators import drift as D
from riskloom.operators import evaluation as E
from riskloom.operators import filters as K
from riskloom.operators import gates as G
from riskloom.operators.aggregation import observed
from riskloom.operators.modeling import Validation
from riskloom.plans import experiments as X
from riskloom.sources import tables as S


def plan(df):
    return df._jdf.queryExecution().toString()


def runs(spark, gains, base=0.7):
    """Three seeds by five folds; ``gains`` of each, and a seed's score is the mean of its folds."""
    rows = []
    for s in range(3):
        own = gains[5 * s : 5 * s + 5]
        rows += [("base", s, f, base) for f in range(1, 6)] + [("new", s, f, base + g) for f, g in enumerate(own, 1)]
        rows += [("base", s, None, base), ("new", s, None, base + sum(own) / 5)]
    return spark.createDataFrame(rows, "experiment string, seed int, fold int, score double")


@pytest.mark.parametrize(
    ("gains", "accepted"),
    [
        ([0.01] * 10 + [-0.001] * 5, True),
        ([0.01] * 9 + [-0.001] * 6, False),  # nine folds
        ([0.001, 0.001, 0.001, 0.001, -0.1] * 3, False),  # no seed gains
        ([0.001] * 14 + [-0.9], False),  # the seeds lose on average
        ([-0.0001] * 5 + [0.00001] * 9 + [0.9], False),  # without the best fold nothing is left
    ],
)
def test_robustness_needs_all_four_rules(spark, gains, accepted):
    row = G.robustness(runs(spark, gains), "base").first()
    assert row.accepted is accepted
    assert row.positive_folds == sum(g > 0 for g in gains)
    assert row.trimmed_fold_delta == pytest.approx(sum(sorted(gains)[1:-1]) / 13, abs=1e-9)


def test_runs_without_counterpart_gain_nothing(spark):
    r = runs(spark, [0.01] * 15).where("NOT (experiment = 'base' AND seed = 2)")
    row = G.robustness(r, "base").first()
    assert (row.positive_seeds, row.positive_folds) == (2, 10)
    assert G.robustness(r.where("experiment = 'base'"), "base").count() == 0


def test_screening_and_replay(spark):
    s = spark.createDataFrame([("base", 0.0, 0), ("a", 0.0005, 4), ("b", 0.0004, 5), ("c", 0.01, 3), ("d", None, 5)], "experiment string, mean_delta double, positive_folds int")
    assert {x.experiment: x.verdict for x in G.screening(s, "base").collect()} == {"base": "CONTROL", "a": "PASS", "b": "FAIL", "c": "FAIL", "d": "FAIL"}
    assert G.check_replay(0.7691, 0.7687) == pytest.approx(0.0004)
    for bad in (0.7694, float("nan")):
        with pytest.raises(RuntimeError, match="off by"):
            G.check_replay(bad, 0.7687)


def test_same_matrix_sees_order_types_values_and_missing(spark):
    a = spark.createDataFrame([(1, 1.5, None), (2, None, "x")], "k long, v double, s string")
    assert G.same_matrix(a, a.repartition(2), "k")
    others = (a.select("k", "s", "v"), a.withColumn("v", F.col("v").cast("float")), a.withColumn("v", F.col("v") + 1), a.withColumn("s", F.coalesce("s", F.lit(""))), a.limit(1))
    assert not any(G.same_matrix(a, b, "k") for b in others)


def test_drift_matches_plain_counting(spark):
    r = random.Random(1)
    make = lambda n, shift: [(r.gauss(shift, 1) if r.random() > 0.1 * (1 + shift) else None, r.choice("abc" if not shift else "abcd"), 5.0) for _ in range(n)]
    old, new = make(900, 0), make(700, 1)
    ddl = "x double, w string, same double"
    got = {x.feature: x for x in D.feature_drift(spark.createDataFrame(old, ddl), spark.createDataFrame(new, ddl), ["x", "w", "same"]).collect()}
    import numpy as np

    edges = np.unique(np.quantile([x[0] for x in old if x[0] is not None], np.arange(1, 10) / 10))

    def share(rows, k, of):
        bins = {}
        for row in rows:
            bins[of(row[k])] = bins.get(of(row[k]), 0) + 1 / len(rows)
        return bins

    for name, k, of in (("x", 0, lambda v: None if v is None else int((edges <= v).sum())), ("w", 1, lambda v: v), ("same", 2, lambda v: v)):
        p, q = share(old, k, of), share(new, k, of)
        csi = sum((max(q.get(b, 0), 1e-4) - max(p.get(b, 0), 1e-4)) * math.log(max(q.get(b, 0), 1e-4) / max(p.get(b, 0), 1e-4)) for b in {*p, *q})
        assert got[name].csi == pytest.approx(csi, abs=1e-9)
        assert got[name].missing_delta == pytest.approx(q.get(None, 0) - p.get(None, 0), abs=1e-9)
        assert got[name].new_share == pytest.approx(sum(s for b, s in q.items() if b not in p), abs=1e-9)
    assert got["w"].new_share > 0 and got["same"].csi == 0
    assert D.feature_drift(spark.createDataFrame(old, ddl), spark.createDataFrame([], ddl), ["w"]).first().csi is None
    with pytest.raises(ValueError, match="missing columns"):
        D.feature_drift(spark.createDataFrame(old, ddl), spark.createDataFrame(new, ddl), ["nope"])


def test_rows_of_ids_read_few_columns_and_shuffle_few_rows(spark, tmp_path):
    spark.range(40_000).select((F.col("id") % 9000).alias("k"), F.col("id").alias("v"), F.lit("wide").alias("unused")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    ids = spark.createDataFrame([(k,) for k in [*range(0, 9000, 100), 123456, None]], "k long")
    want = sorted((x.k, x.v) for x in t.collect() if x.k % 100 == 0)
    for few in (K.FEW, 10):
        out = K.rows_of(t, "k", ids, ["k", "v"], few=few)
        assert sorted(map(tuple, out.collect())) == want
        assert "unused" not in plan(out).split("Physical Plan")[1]
    kept = K._may_hold(t, "k", ids.dropna())
    assert len(want) <= kept.count() < 1.05 * len(want)
    assert K.rows_of(t, "k", ids.limit(0), ["v"]).count() == 0


def test_archives_are_read_in_tasks_from_any_path(spark, tmp_path, monkeypatch):
    text = 'SK_ID_CURR,TARGET,NAME_A,AMT_CREDIT\r\n1,0,"a, ""b""\nc",1.5\r\n2,1,,NaN\r\n3,,é,oops\r\n'
    with zipfile.ZipFile(tmp_path / "application_train.csv", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("deep/train.CSV", "﻿" + text)
        z.writestr("readme.txt", "not this")
    with zipfile.ZipFile(tmp_path / "bureau.csv", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b.csv", "SK_ID_CURR,SK_ID_BUREAU,AMT_X\n" + "".join(f"{k % 50},{k},{k / 4}\n" for k in range(200_000)))
    want = [(1, 0, 'a, "b"\nc', 1.5), (2, 1, None, None), (3, None, "é", None)]
    monkeypatch.setattr(S, "BLOCK", 1 << 16)
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        assert [tuple(x) for x in S.load_table(spark, "train", folder).orderBy("SK_ID_CURR").collect()] == want
    big = S.load_table(spark, "bureau", f"file://{tmp_path}")
    assert big.agg(F.count("*"), F.sum("AMT_X")).first()[:] == (200_000, sum(k / 4 for k in range(200_000)))
    assert S.load_table(spark, "bureau", str(tmp_path), columns=["AMT_X"]).columns == ["AMT_X"]
    some = S.load_table(spark, "bureau", str(tmp_path), columns=["AMT_X"], ids=spark.createDataFrame([(7,)], "SK_ID_CURR long"))
    assert some.columns == ["AMT_X"] and some.count() == 4000
    with zipfile.ZipFile(tmp_path / "application_test.csv", "w") as z:
        z.writestr("a.csv", "SK_ID_CURR\n1\n")
        z.writestr("b.csv", "SK_ID_CURR\n1\n")
    with pytest.raises(Exception, match="one CSV file expected"):
        S.load_table(spark, "test", str(tmp_path)).count()


def test_tables_below_the_folder_are_found(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Application_Train.csv").write_text("SK_ID_CURR,TARGET\n1,0\n")
    assert S.load_table(spark, "train", str(tmp_path)).first()[:] == (1, 0)


def test_observed_counts_come_with_the_run(spark):
    df, seen = observed(spark.newSession().range(100).withColumn("v", F.when(F.col("id") % 4 == 0, 1)), "own", rows=F.count("*"), known=F.count("v"))
    df.groupBy("v").count().write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 100, "known": 25}


def test_registries_keep_order_and_need_their_baseline():
    assert list(X.resolve(X.FAMILY_EXPERIMENTS))[0] == "E01_locked" and len(X.resolve(X.FACTOR_EXPERIMENTS)) == 8
    assert list(X.resolve(X.FACTOR_EXPERIMENTS, ["E02-D", "E01_LOCKED"])) == ["E01_LOCKED", "E02-D"]
    for bad, said in ((["E02-D"], "baseline"), (["E01_LOCKED", "nope"], "unknown"), (["E01_LOCKED", "E01_LOCKED"], "unique")):
        with pytest.raises(ValueError, match=said):
            X.resolve(X.FACTOR_EXPERIMENTS, bad)


def test_two_arms_run_on_the_same_folds(spark, tiny):
    from riskloom.plans import credit

    train, test = (t.where("SK_ID_CURR % 10 < 4") for t in credit.application_tables(spark, tiny))
    seen = []

    def runner(p, folds):
        seen.append(p.features)
        oof = p.train.select("SK_ID_CURR", F.lit(0.5).alias("score"))
        return Validation(oof, [(1, 0.6), (2, 0.6 + len(seen) / 100)], 0.6, 0.6, 0.0, None, None, [1, 1], E.fold_fingerprint(folds, "SK_ID_CURR"), [], 0.0)

    out = X.compare_sets(train, test, ["ratios"], folds=2, runner=runner)
    assert len(seen) == 2 and out["features_added"] == ["CREDIT_ANNUITY_RATIO", "CREDIT_GOODS_DIFF"]
    assert out["feature_counts"] == {"first": len(seen[0]), "second": len(seen[1])} and out["first"]["fold_fingerprint"] == out["second"]["fold_fingerprint"]
