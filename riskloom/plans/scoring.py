"""Queries of folds, discrimination, calibration, stability, paired comparisons and gates."""

from pyspark.sql import functions as F

from riskloom.operators import drift as D
from riskloom.operators import evaluation as E
from riskloom.operators import gates as G
from riskloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)

_SCORED = "SELECT l.doc_id, l.quality AS y, least(d.n_chars, 20000) / 20000.0::DOUBLE AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def scored(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return t.select("doc_id", F.col("quality").alias("y"), (F.least(F.col("n_chars"), F.lit(20000)) / F.lit(20000.0)).alias("p"))


@query("stratified_folds", "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(concat('42:', doc_id)), doc_id) - 1) % 5 + 1 AS INTEGER) AS fold FROM labels")
def stratified_folds(spark, d):
    return E.stratified_folds(table(spark, d, "labels").where("doc_id IS NOT NULL"), "doc_id", "quality", 5, 42)


@query("oof_coverage", """
    WITH p AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 1.5 ELSE 0.5 END AS s FROM labels WHERE doc_id % 7 <> 0 UNION ALL SELECT -1, 0.1 UNION ALL SELECT doc_id, 0.2 FROM labels WHERE doc_id % 11 = 1 AND doc_id % 7 <> 0),
    g AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN s IS NULL OR s < 0 OR s > 1 THEN 1 ELSE 0 END) AS bad FROM p GROUP BY 1),
    e AS (SELECT DISTINCT doc_id, 1 AS e FROM labels), j AS (SELECT e, n, bad FROM e FULL JOIN g ON e.doc_id = g.doc_id)
    SELECT CAST(count(e) AS BIGINT) AS expected, count(*) FILTER (WHERE e = 1 AND n = 1) AS covered_once, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE e IS NULL) AS extra, CAST(coalesce(sum(bad), 0) AS BIGINT) AS invalid FROM j""")
def oof_coverage(spark, d):
    l = table(spark, d, "labels").select("doc_id")
    own = l.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 50 == 0, 1.5).otherwise(0.5).alias("s"))
    extra = spark.createDataFrame([(-1, 0.1)], "doc_id long, s double")
    again = l.where("doc_id % 11 = 1 AND doc_id % 7 <> 0").select("doc_id", F.lit(0.2).alias("s"))
    return E.check_coverage(own.union(extra).union(again), l, "doc_id", "s")


_GROUPED = f"g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM ({_SCORED}) GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p) AS cp, sum(neg) OVER (ORDER BY p) AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM g)"


@query("roc_auc", f"WITH {_GROUPED} SELECT round(sum(pos * (cn - neg + 0.5 * neg)) / max(tp * tn), 6) AS roc_auc FROM c")
def roc_auc(spark, d):
    return E.discrimination(scored(spark, d), "y", "p").select(R(F.col("roc_auc")).alias("roc_auc"))


@query("ks", f"WITH {_GROUPED} SELECT round(max(abs(cp / tp - cn / tn)), 6) AS ks FROM c")
def ks(spark, d):
    return E.discrimination(scored(spark, d), "y", "p").select(R(F.col("ks")).alias("ks"))


@query("gini", f"WITH {_GROUPED} SELECT round(2 * sum(pos * (cn - neg + 0.5 * neg)) / max(tp * tn) - 1, 6) AS gini FROM c")
def gini(spark, d):
    return E.discrimination(scored(spark, d), "y", "p").select(R(F.col("gini")).alias("gini"))


@query("pr_auc", f"WITH {_GROUPED} SELECT round(sum(pos / tp * (tp - cp + pos) / (tp - cp + pos + tn - cn + neg)), 6) AS pr_auc FROM c")
def pr_auc(spark, d):
    return E.average_precision(scored(spark, d), "y", "p").select(R(F.col("pr_auc")).alias("pr_auc"))


@query("brier", f"SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(CAST(y AS DOUBLE)), 6) AS bad_rate FROM ({_SCORED})")
def brier(spark, d):
    c = E.calibration(scored(spark, d), "y", "p")
    return c.select(R(F.col("brier")).alias("brier"), R(F.col("bad_rate")).alias("bad_rate"))


@query("log_loss", f"SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM (SELECT y, greatest(least(p, 1 - 1e-15), 1e-15) AS q FROM ({_SCORED}))")
def log_loss(spark, d):
    return E.calibration(scored(spark, d), "y", "p").select(R(F.col("log_loss")).alias("log_loss"))


@query("calibration_bins", f"""
    WITH s AS ({_SCORED}), g AS (SELECT p, count(*) AS n, sum(y) AS bads FROM s GROUP BY p), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM g),
    b AS (SELECT CAST(before * 10 // total + 1 AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n, sum(p * n) / sum(n) AS m, sum(bads) / sum(n) AS r, min(p) AS low, max(p) AS high FROM c GROUP BY 1)
    SELECT bin, n, round(m, 6) AS mean_score, round(r, 6) AS bad_rate, round(low, 6) AS low, round(high, 6) AS high, round(sum(abs(m - r) * n) OVER () / sum(n) OVER (), 6) AS gap FROM b""")
def calibration_bins(spark, d):
    x = E.calibration_bins(scored(spark, d), "y", "p", 10)
    return x.select("bin", "n", *[R(F.col(c)).alias(c) for c in ("mean_score", "bad_rate", "low", "high", "gap")])


@query("approval_bad_capture", f"SELECT round(avg(CASE WHEN p < 0.2 THEN 1.0 ELSE 0.0 END), 6) AS approval_rate, round(avg(CASE WHEN p < 0.2 THEN y END), 6) AS approved_bad_rate, round(sum(CASE WHEN p < 0.2 THEN 0 ELSE y END) / sum(y), 6) AS capture_rate FROM ({_SCORED})")
def approval_bad_capture(spark, d):
    x = E.decisions(scored(spark, d), "y", "p", 0.2)
    return x.select(*[R(F.col(c)).alias(c) for c in x.columns])


EDGES = [0.25, 0.5, 1.0, 2.0, 4.0]
_BIN = "(" + " + ".join(f"CAST(value >= {e} AS INTEGER)" for e in EDGES) + ")"


@query("psi", f"""
    WITH r AS (SELECT {_BIN} AS b, count(*) / sum(count(*)) OVER () AS s FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), a AS (SELECT {_BIN} AS b, count(*) / sum(count(*)) OVER () AS s FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
    j AS (SELECT greatest(coalesce(r.s, 0), 0.0001) AS r, greatest(coalesce(a.s, 0), 0.0001) AS a FROM r FULL JOIN a ON r.b = a.b)
    SELECT round(sum((a - r) * ln(a / r)), 8) AS psi FROM j""")
def psi(spark, d):
    t, cut = table(spark, d, "events"), F.lit("2024-01-16").cast("timestamp")
    return E.stability(t.where(F.col("ts") < cut), t.where(F.col("ts") >= cut), "value", EDGES).select(R(F.col("psi"), 8).alias("psi"))


@query("woe_iv", f"""
    WITH g AS (SELECT CAST(p >= 0.05 AS INTEGER) + CAST(p >= 0.1 AS INTEGER) + CAST(p >= 0.2 AS INTEGER) AS bin, count(*) AS n, sum(y) AS bads FROM ({_SCORED}) GROUP BY 1),
    s AS (SELECT *, (n - bads + 0.5) / sum(n - bads + 0.5) OVER () AS pg, (bads + 0.5) / sum(bads + 0.5) OVER () AS pb FROM g)
    SELECT bin, n, CAST(bads AS BIGINT) AS bads, round(ln(pg / pb), 6) AS woe, round((pg - pb) * ln(pg / pb), 6) AS iv FROM s""")
def woe_iv(spark, d):
    t = scored(spark, d).withColumn("b", E.binned(F.col("p"), [0.05, 0.1, 0.2]))
    return E.weight_of_evidence(t, "b", "y").select("bin", "n", "bads", R(F.col("woe")).alias("woe"), R(F.col("iv")).alias("iv"))


@query("scorecard_points", f"SELECT doc_id, round(600 - 20 / ln(2) * ln(50) + 20 / ln(2) * ln((1 - q) / q), 4) AS points FROM (SELECT doc_id, greatest(least(p, 0.99), 0.01) AS q FROM ({_SCORED}))")
def scorecard_points(spark, d):
    q = F.greatest(F.least(F.col("p"), F.lit(0.99)), F.lit(0.01))
    return scored(spark, d).select("doc_id", R(E.scorecard_points(q), 4).alias("points"))


_FOLDS = "f AS (SELECT event_type AS experiment, event_id % 5 + 1 AS fold, round(avg(value), 6) AS score FROM events GROUP BY 1, 2)"


def fold_scores(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("experiment"), (F.col("event_id") % 5 + 1).alias("fold")).agg(R(F.avg("value")).alias("score"))


@query("paired_ablation", f"WITH {_FOLDS} SELECT f.experiment, f.fold, f.score, round(f.score - b.score, 6) AS delta FROM f JOIN f b ON b.fold = f.fold AND b.experiment = 'view'")
def paired_ablation(spark, d):
    return E.paired_deltas(fold_scores(spark, d), "view").withColumn("delta", R(F.col("delta")))


@query("ablation_summary", f"WITH {_FOLDS}, p AS (SELECT f.*, f.score - b.score AS delta FROM f JOIN f b ON b.fold = f.fold AND b.experiment = 'view') SELECT experiment, round(avg(score), 5) AS mean_score, round(coalesce(stddev_samp(score), 0), 5) AS std_score, round(avg(delta), 5) AS mean_delta, CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_folds FROM p GROUP BY 1")
def ablation_summary(spark, d):
    s = E.ablation_summary(fold_scores(spark, d), "view")
    return s.select("experiment", *[R(F.col(c), 5).alias(c) for c in ("mean_score", "std_score", "mean_delta")], "positive_folds")


_SUMMARY = f"WITH {_FOLDS}, p AS (SELECT f.*, f.score - b.score AS delta FROM f JOIN f b ON b.fold = f.fold AND b.experiment = 'view'), s AS (SELECT experiment, avg(score) AS m, avg(delta) AS delta, sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS positive FROM p GROUP BY 1)"


@query("screening_gate", f"{_SUMMARY} SELECT experiment, CASE WHEN experiment = 'view' THEN 'CONTROL' WHEN delta >= 0.0005 AND positive >= 4 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s")
def screening_gate(spark, d):
    return G.screening(E.ablation_summary(fold_scores(spark, d), "view"), "view")


@query("robustness_gate", f"""
    WITH {_FOLDS}, p AS (SELECT f.experiment, f.fold, f.score - b.score AS delta FROM f JOIN f b ON b.fold = f.fold AND b.experiment = 'view' WHERE f.experiment <> 'view')
    SELECT experiment, CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_folds, round(avg(delta), 5) AS mean_delta, round((sum(delta) - min(delta) - max(delta)) / (count(*) - 2), 5) AS trimmed,
      sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) >= 4 AND avg(delta) > 0 AND (sum(delta) - min(delta) - max(delta)) / (count(*) - 2) > 0 AS passed FROM p GROUP BY 1""")
def robustness_gate(spark, d):
    p = E.paired_deltas(fold_scores(spark, d), "view").where("experiment <> 'view'")
    x = F.col("delta")
    trimmed = (F.sum(x) - F.min(x) - F.max(x)) / (F.count(x) - 2)
    g = p.groupBy("experiment").agg(F.sum((x > 0).cast("long")).alias("positive_folds"), F.avg(x).alias("m"), trimmed.alias("t"))
    return g.select("experiment", "positive_folds", R(F.col("m"), 5).alias("mean_delta"), R(F.col("t"), 5).alias("trimmed"), ((F.col("positive_folds") >= 4) & (F.col("m") > 0) & (F.col("t") > 0)).alias("passed"))


_RUNS = "r AS (SELECT event_type AS experiment, CAST(user_id % 3 AS INTEGER) AS seed, CAST(event_id % 5 + 1 AS INTEGER) AS fold, round(avg(value), 6) AS score FROM events GROUP BY 1, 2, 3), o AS (SELECT event_type AS experiment, CAST(user_id % 3 AS INTEGER) AS seed, round(avg(value), 6) AS score FROM events GROUP BY 1, 2)"


@query("robustness_crossed", f"""
    WITH {_RUNS}, f AS (SELECT r.experiment, r.score - b.score AS delta FROM r JOIN r b ON b.seed = r.seed AND b.fold = r.fold AND b.experiment = 'view' WHERE r.experiment <> 'view'),
    s AS (SELECT o.experiment, o.score - b.score AS delta FROM o JOIN o b ON b.seed = o.seed AND b.experiment = 'view' WHERE o.experiment <> 'view'),
    x AS (SELECT experiment, count(*) FILTER (WHERE delta > 0) AS positive_folds, (sum(delta) - min(delta) - max(delta)) / (count(*) - 2) AS t, min(delta) AS low, max(delta) AS high FROM f GROUP BY 1),
    y AS (SELECT experiment, count(*) FILTER (WHERE delta > 0) AS positive_seeds, avg(delta) AS m FROM s GROUP BY 1)
    SELECT x.experiment, positive_seeds, positive_folds, round(m, 5) AS mean_seed_delta, round(t, 5) AS trimmed_fold_delta, round(low, 5) AS low, round(high, 5) AS high, positive_seeds >= 2 AND positive_folds >= 10 AND m > 0 AND t > 0 AS accepted FROM x JOIN y ON x.experiment = y.experiment""")
def robustness_crossed(spark, d):
    """Three seeds by five folds: all four rules."""
    e = table(spark, d, "events").select(F.col("event_type").alias("experiment"), (F.col("user_id") % 3).cast("int").alias("seed"), (F.col("event_id") % 5 + 1).cast("int").alias("fold"), "value")
    score = R(F.avg("value")).alias("score")
    runs = e.groupBy("experiment", "seed", "fold").agg(score).unionByName(e.groupBy("experiment", "seed").agg(score), allowMissingColumns=True)
    out = G.robustness(runs, "view")
    return out.withColumns({c: R(F.col(c), 5) for c in ("mean_seed_delta", "trimmed_fold_delta", "low", "high")})


_DRIFT = {"value": 10, "user_id": 10, "event_type": 0}


def _csi_sql(c, bins):
    side = lambda op: f"ts {op} TIMESTAMP '2024-01-16'"
    v = f"CASE WHEN user_id % 9 = 0 AND {side('>=')} THEN NULL ELSE value END" if c == "value" else c
    edges = ", ".join(f"quantile_cont(v, {k / bins!r})" for k in range(1, bins)) if bins else ""
    e = f"e AS (SELECT list_distinct([{edges}]) AS edges FROM t WHERE early)," if bins else ""
    b = "CASE WHEN v IS NOT NULL THEN CAST(len(list_filter((SELECT edges FROM e), lambda q: q <= v)) AS VARCHAR) END" if bins else "v"
    return f"""SELECT * FROM (WITH t AS (SELECT {'CAST(' * bool(bins)}{v}{' AS DOUBLE)' * bool(bins)} AS v, {side('<')} AS early FROM events), {e}
        h AS (SELECT {b} AS bin, count(*) FILTER (WHERE early) AS r, count(*) FILTER (WHERE NOT early) AS a FROM t GROUP BY 1),
        s AS (SELECT bin, r / sum(r) OVER () AS r, a / sum(a) OVER () AS a FROM h)
        SELECT '{c}' AS feature, round(sum((greatest(a, 0.0001) - greatest(r, 0.0001)) * ln(greatest(a, 0.0001) / greatest(r, 0.0001))), 6) AS csi, round(coalesce(sum(r) FILTER (WHERE bin IS NULL), 0), 6) AS missing_reference, round(coalesce(sum(a) FILTER (WHERE bin IS NULL), 0), 6) AS missing_actual,
          round(coalesce(sum(a) FILTER (WHERE bin IS NULL), 0) - coalesce(sum(r) FILTER (WHERE bin IS NULL), 0), 6) AS missing_delta, round(coalesce(sum(a) FILTER (WHERE r = 0), 0), 6) AS new_share FROM s)"""


@query("feature_drift", " UNION ALL ".join(_csi_sql(c, b) for c, b in _DRIFT.items()))
def feature_drift(spark, d):
    """Two numbers and a text before and after a day; later rows lack some values."""
    cut = F.lit("2024-01-16").cast("timestamp")
    t = table(spark, d, "events")
    late = t.where(F.col("ts") >= cut).withColumn("value", F.when(F.col("user_id") % 9 != 0, F.col("value")))
    out = D.feature_drift(t.where(F.col("ts") < cut), late, list(_DRIFT))
    return out.select("feature", *[R(F.col(c)).alias(c) for c in out.columns if c != "feature"])


_SELECT = "s AS (SELECT 'e' || o_orderpriority AS experiment, round(avg(o_totalprice) / 1e6, 4) AS oof_auc, round(stddev_samp(o_totalprice) / 1e9, 6) AS std_fold_auc, CAST(count(*) % 3 + 3 AS INTEGER) AS positive_folds, CAST(count(*) % 7 AS INTEGER) AS n_features, CAST(count(*) % 2 AS INTEGER) AS n_overwritten FROM orders GROUP BY 1)"


@query("select_final", f"""
    WITH {_SELECT}, b AS (SELECT * FROM s WHERE experiment = 'e5-LOW'),
    ok AS (SELECT s.* FROM s, b WHERE s.experiment <> 'e5-LOW' AND s.oof_auc > b.oof_auc AND s.positive_folds >= 4 AND s.std_fold_auc <= b.std_fold_auc + 0.0005)
    SELECT * FROM ok WHERE oof_auc >= (SELECT max(oof_auc) FROM ok) - 0.00001 ORDER BY n_features, n_overwritten, oof_auc DESC, experiment LIMIT 1""")
def select_final(spark, d):
    g = table(spark, d, "orders").groupBy(F.concat(F.lit("e"), "o_orderpriority").alias("experiment"))
    n = F.count("*")
    s = g.agg(R(F.avg("o_totalprice") / 1e6, 4).alias("oof_auc"), R(F.stddev_samp("o_totalprice") / 1e9).alias("std_fold_auc"), (n % 3 + 3).cast("int").alias("positive_folds"), (n % 7).cast("int").alias("n_features"), (n % 2).cast("int").alias("n_overwritten"))
    return E.select_final(s, "e5-LOW", 5)


@query("frame_diff", """
    WITH a AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer), b AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer)
    SELECT 'c_acctbal' AS "column", 'overwritten' AS state, count(*) FILTER (WHERE a.c_acctbal IS DISTINCT FROM b.c_acctbal) AS changed, round(max(abs(a.c_acctbal - b.c_acctbal)), 6) AS max_abs_difference, false AS type_changed FROM a JOIN b USING (c_custkey)
    UNION ALL SELECT 'c_mktsegment', 'same', 0, NULL, false UNION ALL SELECT 'extra', 'added', NULL, NULL, false""")
def frame_diff(spark, d):
    a = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    b = a.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).withColumn("extra", F.lit(1))
    out = E.frame_difference(a, b, "c_custkey", {"c_acctbal"})
    return out.withColumn("max_abs_difference", R(F.col("max_abs_difference")))
