"""Queries of joins, set operations and nested aggregates over the test tables."""

from pyspark.sql import functions as F

from riskloom.operators import aggregation as A
from riskloom.operators.filters import rows_of
from riskloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)


@query("nested_client_mart", """
    WITH loan AS (
      SELECT l_orderkey, count(*) AS n_lines, sum(nullif(l_tax, 0)) AS tax_sum, sum(l_quantity) AS quantity_sum,
             max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_return
      FROM lineitem GROUP BY l_orderkey)
    SELECT o_custkey AS client, count(*) AS loan_count, CAST(sum(n_lines) AS BIGINT) AS line_count,
           round(sum(tax_sum), 4) AS tax_sum_observed, round(coalesce(sum(quantity_sum), 0), 4) AS quantity_sum,
           CAST(sum(has_return) AS BIGINT) AS loans_with_return, round(sum(has_return) / count(*), 6) AS return_share
    FROM orders LEFT JOIN loan ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def nested_client_mart(spark, d):
    """Lines to orders to customers: two grains, observed sums and plain sums, a share."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.expr("nullif(l_tax, 0)").alias("tax"), (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    loan = lines.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("tax").alias("tax_sum"), F.sum("l_quantity").alias("quantity_sum"), F.max("returned").alias("has_return"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.join(loan, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_custkey").alias("client")).agg(
        F.count("*").alias("loan_count"),
        F.sum("n_lines").alias("line_count"),
        R(F.sum("tax_sum"), 4).alias("tax_sum_observed"),
        R(F.coalesce(F.sum("quantity_sum"), F.lit(0)), 4).alias("quantity_sum"),
        F.sum("has_return").alias("loans_with_return"),
        R(F.sum("has_return") / F.count("*")).alias("return_share"),
    )


def _spend(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(R(F.sum("o_totalprice"), 2).alias("spent"), F.count("*").alias("orders"))


_SPEND = "SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS spent, count(*) AS orders FROM orders GROUP BY o_custkey"


@query("merge_features_left", f"SELECT c_custkey, c_mktsegment, spent, orders FROM customer LEFT JOIN ({_SPEND}) USING (c_custkey)")
def merge_features_left(spark, d):
    return A.merge_features(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), _spend(spark, d), "c_custkey")


@query("merge_blocks", f"""
    SELECT c_custkey, c_mktsegment, spent, urgent FROM customer LEFT JOIN ({_SPEND}) USING (c_custkey)
    LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) USING (c_custkey)""")
def merge_blocks(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("urgent"))
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return A.merge_blocks(base, {"spend": _spend(spark, d), "urgent": urgent}, "c_custkey", {"spend": ["spent"]})


@query("outer_merge", """
    SELECT coalesce(a.k, b.k) AS k, early, late FROM (SELECT o_custkey AS k, count(*) AS early FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01' GROUP BY 1) a
    FULL JOIN (SELECT o_custkey AS k, count(*) AS late FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' GROUP BY 1) b ON a.k = b.k""")
def outer_merge(spark, d):
    early, late = F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp"), F.col("o_orderdate") >= F.lit("1997-06-01").cast("timestamp")
    counts = lambda rows, name: table(spark, d, "orders").where(rows).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(name))
    return A.merge_features(counts(early, "early"), counts(late, "late"), "k", "full")


@query("one_to_one_check", "SELECT o_orderkey, o_custkey, n FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (o_orderkey)")
def one_to_one_check(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return A.joined_one_to_one(table(spark, d, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey")


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("pruned_rows_of_ids", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000)")
def pruned_rows_of_ids(spark, d):
    ids = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_orderkey").alias("l_orderkey"))
    return rows_of(table(spark, d, "lineitem"), "l_orderkey", ids, ["l_orderkey", "l_quantity"], few=100)


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("coverage_ratio", "SELECT round(avg(CASE WHEN k IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') ON k = o_orderkey")
def coverage_ratio(spark, d):
    k = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    return table(spark, d, "orders").join(k, F.col("k") == F.col("o_orderkey"), "left").agg(R(F.avg(F.col("k").isNotNull().cast("double"))).alias("coverage"))


@query("union_vocab", "SELECT DISTINCT c_mktsegment AS word, 'segment' AS kind FROM customer UNION SELECT DISTINCT p_brand, 'brand' FROM part")
def union_vocab(spark, d):
    a = table(spark, d, "customer").select(F.col("c_mktsegment").alias("word"), F.lit("segment").alias("kind"))
    return a.unionByName(table(spark, d, "part").select(F.col("p_brand").alias("word"), F.lit("brand").alias("kind"))).distinct()


@query("union_missing_cols", "SELECT n_nationkey AS k, n_name, NULL AS r_name FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def union_missing_cols(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return a.unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name"), allowMissingColumns=True)


@query("set_ops", """
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
    SELECT 'both' AS kind, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
    UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_ops(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "OP")
    parts = {"both": a.intersect(b), "only_a": a.subtract(b), "any": a.union(b).distinct()}
    one = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, df in parts.items()]
    return one[0].union(one[1]).union(one[2])


@query("topk_sort", "SELECT c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM customer QUALIFY row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= 20")
def topk_sort(spark, d):
    top = table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
    packed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("c_acctbal")).alias("by"), "c_custkey", "c_acctbal"))).alias("rows"))
    return packed.select(F.posexplode("rows").alias("k", "r")).select("r.c_custkey", "r.c_acctbal", (F.col("k") + 1).alias("place"))


@query("tolerance_select", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= (SELECT max(p_retailprice) FROM part) - 5")
def tolerance_select(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    best = p.agg(F.max("p_retailprice").alias("best"))
    return p.join(F.broadcast(best), F.col("p_retailprice") >= F.col("best") - 5).drop("best")
