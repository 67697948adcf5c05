"""Running sums, places and quantiles against plain Python, and the plans they make."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluation as E
from riskloom.operators import ranking as K


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("ranges", [512, 4])
@pytest.mark.parametrize("kind", ["double", "string", "long"])
def test_cumulated_matches_running_sums(spark, kind, ranges):
    r = random.Random(ranges)
    make = {"double": lambda: r.choice([-1.0, 1.0]) * 10 ** r.uniform(-300, 300), "string": lambda: "".join(r.choice("aäz𐐷 ") for _ in range(r.randint(0, 4))), "long": lambda: r.randint(-(2**62), 2**62)}[kind]
    values = sorted({make() for _ in range(900)}, key=lambda v: v.encode() if kind == "string" else v)
    rows = [(v, r.randint(0, 9), 1) for v in values]
    got = {x.v: x for x in K.cumulated(spark.createDataFrame(rows, f"v {kind}, n long, m long"), "v", ["n", "m"], ranges).collect()}
    assert len(got) == len(rows)
    before = 0
    for k, (v, n, _) in enumerate(rows):
        assert (got[v].n_before, got[v].m_before, got[v].m_all) == (before, k, len(rows))
        before += n
    assert all(x.n_all == before for x in got.values())


def test_cumulated_of_nothing(spark):
    assert K.cumulated(spark.createDataFrame([], "v double, n long"), "v", ["n"]).count() == 0


def test_places_by_hash_number_each_class(spark):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else k % 3) for k in range(1000)], "key long, y int")
    rows = K.places_by_hash(df, "key", "y", 7, digits=1).collect()
    assert rows and all(sorted(x.place for x in rows if x.y == y) == list(range(sum(x.y == y for x in rows))) for y in (None, 0, 1, 2))
    import hashlib

    own = sorted((x for x in rows if x.y == 1), key=lambda x: hashlib.md5(f"7:{x.key}".encode()).hexdigest())
    assert [x.place for x in own] == list(range(len(own)))


def test_folds_sort_no_class_in_one_task(spark):
    df = spark.createDataFrame([(k, k % 2) for k in range(500)], "key long, y int")
    folds = E.stratified_folds(df, "key", "y", 5)
    counts = {(x.y, x.fold): x["count"] for x in folds.groupBy("y", "fold").count().collect()}
    assert set(counts.values()) == {50}
    # rows are ranked within a class and a range of the hash; the table of ranges alone is summed by class
    assert "_range" in plan(folds).split("row_number")[1].split("\n")[0]


@pytest.mark.parametrize("bins", [512, 8])
def test_quantiles_match_numpy(spark, bins):
    r = np.random.default_rng(bins)
    columns = {"even": r.random(701), "ties": r.integers(0, 4, 701).astype(float), "wide": 10 ** r.uniform(-5, 100, 701) * r.choice([-1, 1], 701), "hot": np.where(r.random(701) < 0.6, 5.0, r.normal(size=701)), "one": np.full(701, 2.5)}
    rows = [tuple(float(v[k]) for v in columns.values()) + (None if k % 3 else float(k), None) for k in range(701)]
    rows += [(None, float("nan"), None, float("inf"), None, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "gaps", "none"]))
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = K.quantiles(df, df.columns, shares, bins)
    for c, v in (columns | {"gaps": np.arange(0, 701, 3.0)}).items():
        want = np.quantile(v, shares)
        assert np.allclose(got[c]["quantiles"], want, rtol=1e-12), c
        assert got[c]["n"] == len(v) and got[c]["low"] == v.min() and got[c]["high"] == v.max()
    assert got["none"]["n"] == 0 and got["none"]["quantiles"] == [None] * 6
    assert K.describe(df.limit(0), ["even"]).first().n == 0


def test_quantiles_use_no_percentile_and_collect_ranges_only(spark, monkeypatch):
    plans = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: (plans.append(plan(self)), out := collect(self), plans.append(len(out)))[1])
    K.quantiles(spark.range(20000).select((F.col("id") % 997).cast("double").alias("x")), ["x"], [0.5])
    assert plans and not any("percentile" in p for p in plans if isinstance(p, str)) and max(p for p in plans if isinstance(p, int)) <= K.BINS


def test_calibration_bins_keep_ties_together(spark):
    r = random.Random(3)
    rows = [(r.choice([0.2, 0.2, 0.2, round(r.random(), 2)]), int(r.random() < 0.3)) for _ in range(2000)] + [(None, 1), (0.5, None), (float("nan"), 0), (0.1, 7)]
    got = {x.bin: x for x in E.calibration_bins(spark.createDataFrame(rows, "s double, y int"), "y", "s", 8).collect()}
    fine = sorted((s, y) for s, y in rows if s is not None and s == s and y in (0, 1))
    first, bins = {}, {}
    for k, (s, y) in enumerate(fine):
        first.setdefault(s, k)
        bins.setdefault(first[s] * 8 // len(fine) + 1, []).append((s, y))
    assert set(got) == set(bins)
    for b, x in bins.items():
        assert (got[b].n, got[b].low, got[b].high) == (len(x), x[0][0], x[-1][0])
        assert got[b].bad_rate == pytest.approx(sum(y for _, y in x) / len(x)) and got[b].mean_score == pytest.approx(sum(s for s, _ in x) / len(x))
