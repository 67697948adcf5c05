"""Queries of declared, ordered and windowed aggregates over the test tables."""

from pyspark.sql import functions as F

from riskloom.functions.numeric import flag
from riskloom.operators import aggregation as A
from riskloom.operators import evaluation as E
from riskloom.operators import ordered as O
from riskloom.operators.ranking import describe
from riskloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)


def rounded(df, digits=4):
    return df.select(*[R(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


_LINES = "SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_tax > 0.04 THEN l_tax END AS tax FROM lineitem"


@query("agg_spec_all_stats", f"""
    SELECT l_orderkey, count(quantity) AS L_quantity_COUNT, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS L_quantity_SUM, round(avg(quantity), 4) AS L_quantity_MEAN, min(quantity) AS L_quantity_MIN, max(quantity) AS L_quantity_MAX,
      count(DISTINCT quantity) AS L_quantity_NUNIQUE, round(stddev_samp(quantity), 4) AS L_quantity_STD, round(var_samp(quantity), 4) AS L_quantity_VAR,
      count(tax) AS L_tax_COUNT, round(coalesce(sum(tax), 0), 4) AS L_tax_SUM, round(avg(tax), 4) AS L_tax_MEAN, round(min(tax), 4) AS L_tax_MIN, round(max(tax), 4) AS L_tax_MAX, round(stddev_samp(tax), 4) AS L_tax_STD
    FROM ({_LINES}) GROUP BY l_orderkey""")
def agg_spec_all_stats(spark, d):
    spec = A.specs("numbers quantity count sum mean min max nunique std var\nrates tax count sum mean min max std", "L_")
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("quantity"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"))
    return rounded(A.aggregate(t, ["l_orderkey"], spec))


@query("sum_vs_sum_observed", "SELECT l_orderkey, round(coalesce(sum(nullif(l_discount, 0)), 0), 4) AS plain_SUM, round(sum(nullif(l_discount, 0)), 4) AS observed_SUM FROM lineitem GROUP BY l_orderkey")
def sum_vs_sum_observed(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", F.expr("nullif(l_discount, 0)").alias("x"))
    return rounded(A.aggregate(t, ["l_orderkey"], A.specs("a plain=x sum\na observed=x sum_observed")))


@query("last_observed", "SELECT user_id, round(max_by(CASE WHEN value > 1 THEN value END, ts) FILTER (WHERE value > 1), 6) AS value_LAST FROM events GROUP BY user_id")
def last_observed(spark, d):
    t = table(spark, d, "events").select("user_id", "ts", F.when(F.col("value") > 1, F.col("value")).alias("value"))
    return rounded(A.aggregate(t, ["user_id"], A.specs("a value last"), order=F.col("ts")), 6)


@query("one_hot_counts", """
    SELECT o_custkey, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INTEGER) AS "PRI_1-URGENT_COUNT", CAST(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS INTEGER) AS "PRI_2-HIGH_COUNT",
      CAST(sum(CASE WHEN o_orderpriority = 'NEVER' THEN 1 ELSE 0 END) AS INTEGER) AS PRI_NEVER_COUNT, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', 'NEVER') THEN 0 ELSE 1 END) AS INTEGER) AS PRI_OTHER_COUNT
    FROM orders GROUP BY o_custkey""")
def one_hot_counts(spark, d):
    return A.one_hot_counts(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "NEVER"], "PRI")


@query("fill_counts", "SELECT c_custkey, CAST(coalesce(n, 0) AS INTEGER) AS n, spent FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) USING (c_custkey)")
def fill_counts(spark, d):
    some = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), R(F.sum("o_totalprice"), 2).alias("spent"))
    return A.fill_counts(A.merge_features(table(spark, d, "customer").select("c_custkey"), some, "c_custkey"), ["n"])


@query("size_filtered", "SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY o_custkey")
def size_filtered(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("unique_key_check", "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, count(*) - count(DISTINCT o_orderkey) AS repeated FROM orders")
def unique_key_check(spark, d):
    A.assert_unique_key(table(spark, d, "orders"), "o_orderkey", "orders")
    g = table(spark, d, "orders").groupBy("o_orderkey").count()
    return g.agg(F.sum("count").alias("rows"), F.count("*").alias("keys"), F.sum(F.col("count") - 1).alias("repeated"))


@query("status_pivot", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS status_A, count(*) FILTER (WHERE l_returnflag = 'N') AS status_N, count(*) FILTER (WHERE l_returnflag = 'Z') AS status_Z FROM lineitem GROUP BY l_orderkey")
def status_pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(*[F.count_if(F.col("l_returnflag") == s).alias(f"status_{s}") for s in "ANZ"])


@query("trimmed_mean", "SELECT user_id, round((sum(value) - min(value) - max(value)) / (count(*) - 2), 6) AS trimmed FROM events GROUP BY user_id HAVING count(*) > 2")
def trimmed_mean(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(R(A.trimmed_mean(F.col("value"))).alias("trimmed")).where("trimmed IS NOT NULL")


@query("describe_values", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM events")
def describe_values(spark, d):
    x = describe(table(spark, d, "events"), ["value"])
    return x.select("n", *[R(F.col(c)).alias(c) for c in ("mean", "deviation", "low", "q1", "q2", "q3", "high")])


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount")


@query("describe_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS deviation, round(min({c}), 4) AS low, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS q2, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS high FROM lineitem" for c in _MEASURES))
def describe_columns(spark, d):
    x = describe(table(spark, d, "lineitem"), list(_MEASURES))
    return x.select("column", "n", *[R(F.col(c), 4).alias(c) for c in ("mean", "deviation", "low", "q1", "q2", "q3", "high")])


@query("streak_episodes", """
    WITH f AS (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag FROM events),
    i AS (SELECT *, sum(1 - flag) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island, CASE WHEN flag = 1 AND coalesce(lag(flag) OVER (PARTITION BY user_id ORDER BY ts), 0) = 0 THEN 1 ELSE 0 END AS start FROM f),
    g AS (SELECT user_id, island, sum(flag) AS n, sum(start) AS s FROM i GROUP BY 1, 2)
    SELECT user_id, CAST(max(n) AS INTEGER) AS longest, CAST(sum(s) AS INTEGER) AS episodes FROM g GROUP BY user_id""")
def streak_episodes(spark, d):
    t = table(spark, d, "events").select("user_id", "ts", flag(F.col("event_type") == "error").alias("flag"))
    return O.streaks(t, ["user_id"], ["ts"], "flag", "longest", "episodes")


@query("trend_slope", """
    WITH r AS (SELECT user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rank FROM events),
    p AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS place FROM r WHERE rank <= 20 AND v IS NOT NULL)
    SELECT user_id, round(CASE WHEN count(*) > 1 THEN regr_slope(v, place) END, 6) AS slope FROM p GROUP BY user_id""")
def trend_slope(spark, d):
    t = table(spark, d, "events").select("user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    s = O.slopes(O.newest(t, ["user_id"], [F.desc("ts")], 20), ["user_id"], [F.col("ts")], {"v": "slope"})
    return s.select("user_id", R(F.col("slope")).alias("slope"))


@query("top_n_recent", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5")
def top_n_recent(spark, d):
    return O.newest(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.col("event_id")], 5, "place").select("user_id", "event_id", "place")


_AGE = "date_diff('day', DATE '2001-08-01', CAST(o_orderdate AS DATE))"


@query("trailing_windows", f"""
    SELECT o_custkey, count(*) FILTER (WHERE age >= -1200) AS n_1200, round(sum(o_totalprice) FILTER (WHERE age >= -1200), 2) AS sum_1200, count(*) FILTER (WHERE age >= -1800) AS n_1800, round(sum(o_totalprice) FILTER (WHERE age >= -1800), 2) AS sum_1800
    FROM (SELECT *, {_AGE} AS age FROM orders) GROUP BY o_custkey""")
def trailing_windows(spark, d):
    age = F.datediff(F.col("o_orderdate").cast("date"), F.lit("2001-08-01").cast("date"))
    made = [c for w in (1200, 1800) for c in (F.count_if(age >= -w).alias(f"n_{w}"), R(F.sum(F.when(age >= -w, F.col("o_totalprice"))), 2).alias(f"sum_{w}"))]
    return table(spark, d, "orders").groupBy("o_custkey").agg(*made)


@query("recent_minus_lifetime", f"SELECT o_custkey, round(avg(o_totalprice) FILTER (WHERE age >= -1500) - avg(o_totalprice) + 0.00001234, 3) AS delta FROM (SELECT *, {_AGE} AS age FROM orders) GROUP BY o_custkey")
def recent_minus_lifetime(spark, d):
    age = F.datediff(F.col("o_orderdate").cast("date"), F.lit("2001-08-01").cast("date"))
    # the small term keeps exact halves off the rounding
    delta = F.avg(F.when(age >= -1500, F.col("o_totalprice"))) - F.avg("o_totalprice") + 0.00001234
    return table(spark, d, "orders").groupBy("o_custkey").agg(R(delta, 3).alias("delta"))


@query("latest_snapshot_ratio", """
    WITH l AS (SELECT user_id, event_type, max_by(value, ts) FILTER (WHERE value IS NOT NULL) AS v, max_by(event_id % 97, ts) AS w FROM events GROUP BY 1, 2)
    SELECT user_id, round(sum(v) / nullif(sum(w), 0), 6) AS ratio FROM l GROUP BY user_id""")
def latest_snapshot_ratio(spark, d):
    t = table(spark, d, "events").select("user_id", "event_type", "ts", "value", (F.col("event_id") % 97).alias("w"))
    last = A.aggregate(t, ["user_id", "event_type"], A.specs("a value last\na w last"), order=F.col("ts"))
    return last.groupBy("user_id").agg(R(F.try_divide(F.sum("value_LAST"), F.sum("w_LAST"))).alias("ratio"))


@query("days_since_last", "SELECT user_id, -max(date_diff('day', DATE '2024-02-29', CAST(ts AS DATE))) FILTER (WHERE event_type = 'error') AS days FROM events GROUP BY user_id")
def days_since_last(spark, d):
    age = F.datediff(F.col("ts").cast("date"), F.lit("2024-02-29").cast("date"))
    return table(spark, d, "events").groupBy("user_id").agg((-F.max(F.when(F.col("event_type") == "error", age))).cast("long").alias("days"))


@query("importance_summary", "SELECT l_returnflag AS feature, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS deviation FROM lineitem GROUP BY 1")
def importance_summary(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("feature"), F.col("l_quantity").alias("importance"))
    return E.importance_summary(rows).select("feature", R(F.col("mean")).alias("mean"), R(F.col("deviation")).alias("deviation"))
