"""Queries of the loading, audit and row-wise operators over the test tables."""

from pyspark.sql import functions as F

from riskloom.functions import numeric as N
from riskloom.operators.aggregation import safe_name
from riskloom.plans import marts as M
from riskloom.plans.registry import query, table
from riskloom.sources import tables as S

R = lambda c, n=6: F.round(c, n)


@query("audit_keys", """
    SELECT * FROM (
    SELECT 'customer' AS "table", count(*) AS rows, CAST(5 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS missing_cells, count(*) - count(DISTINCT c_custkey) AS repeated_keys FROM customer
    UNION ALL SELECT 'lineitem', count(*), 11, 0, NULL FROM lineitem
    UNION ALL SELECT 'orders', count(*), 6, 0, count(*) - count(DISTINCT o_orderkey) FROM orders)""")
def audit_keys(spark, d):
    names = {"customer": "c_custkey", "lineitem": None, "orders": "o_orderkey"}
    return S.audit({n: table(spark, d, n) for n in names}, names)


@query("audit_missing", """
    WITH t AS (SELECT nullif(l_tax, 0) AS tax, nullif(l_discount, 0) AS discount, l_quantity AS quantity FROM lineitem)
    SELECT 'tax' AS "column", count(*) - count(tax) AS missing_count, round((count(*) - count(tax)) / count(*), 6) AS missing_rate, 'double' AS dtype FROM t
    UNION ALL SELECT 'discount', count(*) - count(discount), round((count(*) - count(discount)) / count(*), 6), 'double' FROM t
    UNION ALL SELECT 'quantity', count(*) - count(quantity), round((count(*) - count(quantity)) / count(*), 6), 'double' FROM t""")
def audit_missing(spark, d):
    t = table(spark, d, "lineitem").selectExpr("nullif(l_tax, 0) AS tax", "nullif(l_discount, 0) AS discount", "l_quantity AS quantity")
    return S.missing_summary(t).withColumn("missing_rate", R(F.col("missing_rate")))


@query("target_distribution", "SELECT quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT * FROM labels UNION ALL SELECT -1, NULL, NULL) GROUP BY quality")
def target_distribution(spark, d):
    extra = spark.createDataFrame([(-1, None, None)], "doc_id long, quality int, toxic int")
    return S.distribution(table(spark, d, "labels").unionByName(extra), "quality").withColumn("share", R(F.col("share")))


@query("duplicate_rows", "WITH t AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 2) SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows")
def duplicate_rows(spark, d):
    t = table(spark, d, "lineitem")
    return S.repeated_rows(t.unionByName(t.where("l_linenumber = 2")))


@query("key_overlap", "SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')")
def key_overlap(spark, d):
    o, cut = table(spark, d, "orders"), F.lit("1996-01-01").cast("timestamp")
    return S.shared_keys(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_custkey")


@query("compact_cast", "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity, round(sum(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE)), 2) AS price FROM lineitem GROUP BY l_orderkey")
def compact_cast(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("q"), F.col("l_extendedprice").cast("float").alias("p"))
    return t.groupBy("l_orderkey").agg(F.sum("q").alias("quantity"), R(F.sum(F.col("p").cast("double")), 2).alias("price"))


@query("safe_divide_f32", "SELECT l_orderkey, l_linenumber, l_extendedprice, round(CAST(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) / CAST(CAST(nullif(l_tax, 0) AS FLOAT) AS DOUBLE) AS FLOAT)::DOUBLE, 3) AS ratio FROM lineitem")
def safe_divide_f32(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", R(N.safe_divide(F.col("l_extendedprice"), F.col("l_tax")).cast("double"), 3).alias("ratio"))


@query("legacy_divide", "SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio FROM lineitem")
def legacy_divide(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", R(N.plain_divide(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("ratio"))


@query("sentinel_clean", "SELECT p_partkey, CASE WHEN p_size = 50 THEN 1 ELSE 0 END AS anomalous, CAST(CASE WHEN p_size = 50 THEN NULL ELSE p_size END AS BIGINT) AS size FROM part")
def sentinel_clean(spark, d):
    return table(spark, d, "part").select("p_partkey", N.flag(F.col("p_size") == 50).cast("int").alias("anomalous"), N.without_sentinel(F.col("p_size"), 50).cast("long").alias("size"))


_TRIPLE = "SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b, nullif(l_quantity / 50, 1) AS c FROM lineitem"


def triple(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "nullif(l_discount, 0) AS a", "nullif(l_tax, 0) AS b", "nullif(l_quantity / 50, 1) AS c")


@query("rowwise_stats", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(n AS INTEGER) AS n, round(s / nullif(n, 0), 6) AS mean, round(least(a, b, c), 6) AS low, round(greatest(a, b, c), 6) AS high,
      round(CASE n WHEN 1 THEN s WHEN 2 THEN s / 2 WHEN 3 THEN s - least(a, b, c) - greatest(a, b, c) END, 6) AS median,
      round(CASE WHEN n > 1 THEN sqrt((coalesce((a - s / n) * (a - s / n), 0) + coalesce((b - s / n) * (b - s / n), 0) + coalesce((c - s / n) * (c - s / n), 0)) / (n - 1)) END, 5) AS deviation,
      round(CASE WHEN n > 1 THEN coalesce(a, 1) * coalesce(b, 1) * coalesce(c, 1) END, 6) AS product
    FROM (SELECT *, CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT) AS n, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS s FROM ({_TRIPLE}))""")
def rowwise_stats(spark, d):
    x = [F.col("a"), F.col("b"), F.col("c")]
    return triple(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", N.row_count(*x).alias("n"), R(N.row_mean(*x)).alias("mean"), R(N.row_min(*x)).alias("low"), R(N.row_max(*x)).alias("high"), R(N.row_median(*x)).alias("median"), R(N.row_std(*x), 5).alias("deviation"), R(N.row_product(*x)).alias("product"))


@query("pairwise_ratio", f"SELECT l_orderkey, l_linenumber, l_partkey, round(a - b, 6) AS a_MINUS_b, round(a / b, 6) AS a_DIV_b, round(b / a, 6) AS b_DIV_a, round(a - c, 6) AS a_MINUS_c, round(a / nullif(c, 0), 6) AS a_DIV_c, round(c / a, 6) AS c_DIV_a FROM ({_TRIPLE})")
def pairwise_ratio(spark, d):
    t = triple(spark, d)
    made = N.pair_features(["a", "b"]) | N.pair_features(["a", "c"])
    return t.select("l_orderkey", "l_linenumber", "l_partkey", *[R(c).alias(k) for k, c in made.items()])


@query("prefix_row_sum", "SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(l_discount, 0) + coalesce(nullif(l_tax, 0), 0), 6) AS total, round(CASE WHEN nullif(l_tax, 0) IS NULL AND nullif(l_discount, 0) IS NULL THEN NULL ELSE coalesce(l_discount, 0) + coalesce(l_tax, 0) END, 6) AS total_observed FROM lineitem")
def prefix_row_sum(spark, d):
    t = table(spark, d, "lineitem").withColumns({"RATE_tax": F.expr("nullif(l_tax, 0)"), "RATE_discount": F.expr("nullif(l_discount, 0)")})
    x = [F.col(c) for c in N.starting_with(t, "RATE_")]
    return t.select("l_orderkey", "l_linenumber", "l_partkey", R(N.row_sum(*x)).alias("total"), R(N.row_sum(*x, least=1)).alias("total_observed"))


@query("clamp_null", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN NULL ELSE greatest(c_acctbal, 0) END AS balance FROM customer")
def clamp_null(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.at_least_zero(F.when(F.col("c_acctbal") <= 5000, F.col("c_acctbal"))).alias("balance"))


@query("status_map", """
    WITH t AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'R' THEN CAST(l_linenumber % 7 AS VARCHAR) WHEN 'N' THEN 'X' END AS s FROM lineitem),
    v AS (SELECT l_orderkey, CASE WHEN s = 'C' THEN 0 WHEN s IN ('0', '1', '2', '3', '4', '5') THEN CAST(s AS INTEGER) END AS v FROM t)
    SELECT l_orderkey, CAST(sum(v) AS BIGINT) AS severity, count(v) AS observed, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS past_due FROM v GROUP BY l_orderkey""")
def status_map(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "R", (F.col("l_linenumber") % 7).cast("string")).when(F.col("l_returnflag") == "N", "X")
    t = table(spark, d, "lineitem").select("l_orderkey", M.severity(status).alias("s"))
    return t.groupBy("l_orderkey").agg(F.sum("s").alias("severity"), F.sum(N.flag(F.col("s").isNotNull())).alias("observed"), F.sum(N.flag(F.col("s") > 0)).alias("past_due"))


@query("nested_status", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'CONTROL' WHEN l_discount >= 0.05 AND l_quantity >= 25 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM lineitem")
def nested_status(spark, d):
    ok = (F.col("l_discount") >= 0.05) & (F.col("l_quantity") >= 25)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linestatus") == "O", "CONTROL").when(ok, "PASS").otherwise("FAIL").alias("verdict"))


@query("safe_names", "SELECT p_partkey, translate(concat(p_brand, '[', p_type, ']:{', p_size, '}'), '\"\\[]{}:,', '________') AS name FROM part")
def safe_names(spark, d):
    text = F.concat("p_brand", F.lit("["), "p_type", F.lit("]:{"), F.col("p_size").cast("string"), F.lit("}"))
    return table(spark, d, "part").select("p_partkey", safe_name(text).alias(safe_name("name")))
