"""Loading, audit, store, evaluation and models; the registered queries against their SQL."""

import json
import math
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.operators import evaluation as E
from riskloom.operators import modeling as L
from riskloom.plans import registry
from riskloom.sources import store as B
from riskloom.sources import tables as S

CSV = "SK_ID_CURR,TARGET,AMT_CREDIT\n1,0,10.5\n2,1,NaN\n3,,\n"


def test_loading(spark, tmp_path):
    (tmp_path / "application_train.csv").write_text(CSV)
    df = S.load_table(spark, "train", str(tmp_path))
    assert df.dtypes == [("SK_ID_CURR", "bigint"), ("TARGET", "int"), ("AMT_CREDIT", "double")]
    assert [r.AMT_CREDIT for r in df.orderBy("SK_ID_CURR").collect()] == [10.5, None, None]
    assert S.load_table(spark, "train", str(tmp_path), rows=2).count() == 2
    with zipfile.ZipFile(tmp_path / "application_test.csv", "w") as z:
        z.writestr("inner.csv", "SK_ID_CURR,AMT_CREDIT\n7,1\n")
    assert S.load_table(spark, "test", str(tmp_path)).first().SK_ID_CURR == 7
    row = {r.table: r for r in S.audit(S.load_tables(spark, None, str(tmp_path))).collect()}["application_train"]
    assert (row.rows, row.columns, row.missing_cells, row.repeated_keys) == (3, 3, 3, 0)
    with pytest.raises(FileNotFoundError):
        S.load_table(spark, "bureau", str(tmp_path))


@pytest.mark.parametrize("text", ["SK_ID_CURR,TARGET\n1,0\n1,1\n", "SK_ID_CURR,TARGET\n1,2\n", "SK_ID_CURR,X\n1,2\n"])
def test_bad_tables(spark, tmp_path, text):
    (tmp_path / "application_train.csv").write_text(text)
    with pytest.raises(S.SchemaError):
        S.load_table(spark, "application_train", str(tmp_path))


def test_names():
    assert S.table_names() == S.DEFAULT and len(S.table_names("all")) == 8 and S.table_names("pos_cash") == ["POS_CASH_balance"]
    for bad in ("nope", []):
        with pytest.raises(ValueError):
            S.table_names(bad)


def test_detection(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "BUREAU.csv").write_text("x")
    assert list(S.detect_folder(str(tmp_path))) == ["bureau"]
    (tmp_path / "bureau.csv").write_text("x")
    with pytest.raises(S.SchemaError):
        S.detect_folder(str(tmp_path))


def block(spark):
    return spark.createDataFrame([(1, 2, None), (2, 0, 1.5), (3, 1, 2.0)], "SK_ID_CURR long, COUNT int, SUM double")


def test_store_round_trip(spark, tmp_path):
    root, families = str(tmp_path), {"COUNT": "counts", "SUM": "amounts"}
    assert B.list_blocks(spark, f"{root}/none") == []
    B.save_block(block(spark), "b", root, "b-v1", families)
    df, said = B.load_block(spark, "b", root, "b-v1")
    assert said["rows"] == 3 and df.orderBy("SK_ID_CURR").collect() == block(spark).collect() and B.list_blocks(spark, root) == ["b"]
    with pytest.raises(B.StoreError, match="built by"):
        B.load_block(spark, "b", root, "b-v2")
    spark.createDataFrame([(json.dumps(said | {"rows": 4}),)], "value string").write.mode("overwrite").text(B.block_paths(root, "b")[1])
    with pytest.raises(B.StoreError, match="rows"):
        B.load_block(spark, "b", root)
    for bad, version, own in ((block(spark).union(block(spark)), "v", families), (block(spark), "", families), (block(spark), "v", {"COUNT": "c"}), (block(spark).withColumn("SK_ID_CURR", F.lit(None).cast("long")), "v", families)):
        with pytest.raises(B.StoreError):
            B.save_block(bad, "c", root, version, own)


def test_submission(spark, tmp_path):
    good = spark.createDataFrame([(1, 0.5), (2, 1.0)], "SK_ID_CURR long, TARGET double")
    B.submission(good, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == ["SK_ID_CURR", "TARGET"]
    for bad in ([(1, 1.5)], [(1, 0.1), (1, 0.2)], [(None, 0.1)], [(1, None)]):
        with pytest.raises(B.StoreError):
            B.submission(spark.createDataFrame(bad, good.schema), str(tmp_path / "t"))


def test_discrimination(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double")
    row = E.discrimination(df, "y", "p").first()
    assert (row.roc_auc, row.gini, row.ks) == (1, 1, 1)
    ties = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double")
    assert E.discrimination(ties, "y", "p").first().roc_auc == 0.5
    assert E.discrimination(df.where("y = 1"), "y", "p").first().roc_auc is None


def test_folds(spark):
    df = spark.createDataFrame([(k, k % 3 == 0) for k in range(90)], "key long, b boolean").select("key", F.col("b").cast("int").alias("y"))
    folds = E.stratified_folds(df, "key", "y", 5)
    E.check_folds(folds, "key", 5)
    assert {r["count"] for r in folds.where("y = 1").groupBy("fold").count().collect()} == {6}
    assert folds.collect().sort() == E.stratified_folds(df.repartition(7), "key", "y", 5).collect().sort()
    assert E.fold_fingerprint(folds) == E.fold_fingerprint(folds.repartition(3)) != E.fold_fingerprint(E.stratified_folds(df, "key", "y", 5, seed=1))
    with pytest.raises(ValueError):
        E.check_folds(folds.union(folds), "key", 5)


def test_scorecard(spark):
    df = spark.createDataFrame([(1 / 51,), (1 / 101,)], "p double").select(E.scorecard_points(F.col("p")).alias("x"))
    a, b = (r.x for r in df.collect())
    assert a == pytest.approx(600) and b - a == pytest.approx(20)


def test_frame_difference_refuses_silent_changes(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    with pytest.raises(ValueError, match="undeclared"):
        E.frame_difference(a, a.withColumn("x", F.lit(3)), "k")
    with pytest.raises(ValueError, match="removed"):
        E.frame_difference(a, a.drop("x"), "k")


def test_models(spark):
    rows = [(k, k % 2, float(k % 2) + (k % 7) / 10, "a" if k % 3 else None) for k in range(120)]
    df = spark.createDataFrame(rows, "key long, y int, x double, w string")
    folds = E.stratified_folds(df, "key", "y", 3).drop("y")
    got = L.cross_validate(df, folds, "key", "y", ["x", "w"], "LOGISTIC")
    assert got.oof.count() == 120 and got.oof_auc > 0.95 and len(got.fold_scores) == 3 and not math.isnan(got.std_auc)
    with pytest.raises(ValueError, match="unknown model"):
        L.build_model("nope")
    with pytest.raises(ValueError, match="nothing observed"):
        L.feature_pipeline(df.withColumn("x", F.lit(None).cast("double")), ["x"])
    best, score = L.random_search({"a": ("int", 1, 9), "b": ("log_float", -3, 0)}, 5, lambda c: c["a"])
    assert score == best["a"]


def test_ablation_runs_the_baseline_first(spark):
    folds = spark.createDataFrame([(10, 1), (11, 2)], "key long, fold int")
    order = []
    runner = lambda c, f: order.append(c["name"]) or [(1, c["v"]), (2, c["v"] + 0.01)]
    rows = L.run_ablation({"x": {"name": "x", "v": 0.51}, "base": {"name": "base", "v": 0.5}}, folds, "base", runner)
    assert order == ["base", "x"]
    d = E.paired_deltas(spark.createDataFrame(rows, "experiment string, fold int, score double"), "base")
    assert [round(r.delta, 6) for r in d.where("experiment = 'x'").collect()] == [0.01, 0.01]
    with pytest.raises(ValueError, match="other folds"):
        L.run_ablation({"base": {}}, folds, "base", lambda c, f: [(1, 0.5)])


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, tiny, name):
    df = registry.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        con.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    at = [list(want.columns).index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert sorted(rows, key=repr) == sorted([tuple(plain(r[k]) for k in at) for r in want.fetchall()], key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
