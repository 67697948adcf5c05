"""Queries that run the marts and application features over the test tables, dressed as credit tables.

Orders stand for loans and applications, lines for instalments and monthly statuses, events for monthly balances.
Missing values are made with CASE, as the tables have none.
"""

from pyspark.sql import functions as F

from riskloom.operators.ordered import newest
from riskloom.plans import application as P
from riskloom.plans import marts as M
from riskloom.plans.registry import query, table

DIGITS, OFF = 3, 0.00001234


def doubles(df, key):
    """Every feature as a double, rounded: engines differ in integer and float widths. OFF keeps exact halves off."""
    return df.select(F.col(key).cast("long").alias(key), *[F.round(F.col(c).cast("double") + OFF, DIGITS).alias(c) for c in df.columns if c != key])


def published(names, key):
    return f"SELECT CAST({key} AS BIGINT) AS {key}, " + ", ".join(f'round(CAST("{n}" AS DOUBLE) + {OFF}, {DIGITS}) AS "{n}"' for n in names)


def f32(a, b):
    return f"CAST(CAST(CAST({a} AS FLOAT) AS DOUBLE) / nullif(CAST(CAST({b} AS FLOAT) AS DOUBLE), 0) AS FLOAT)"


def minus(a, b):
    return f"CAST(CAST(CAST({a} AS FLOAT) AS DOUBLE) - CAST(CAST({b} AS FLOAT) AS DOUBLE) AS FLOAT)"


def aggs(spec):
    return ", ".join(a.sql() for a in spec)


def streak(source, key, order, flag, longest, episodes):
    return f"""(SELECT {key}, max(n) AS {longest}, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS {episodes} FROM (SELECT {key}, island, sum({flag}) AS n FROM (
      SELECT {key}, {flag}, sum(1 - {flag}) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island FROM {source}) GROUP BY 1, 2) GROUP BY 1)"""


def hot(column, categories, prefix):
    quoted = ", ".join(f"'{c}'" for c in categories)
    return ", ".join([f"sum(CASE WHEN {column} = '{c}' THEN 1 ELSE 0 END) AS \"{prefix}_{c}_COUNT\"" for c in categories] + [f"sum(CASE WHEN {column} IN ({quoted}) THEN 0 ELSE 1 END) AS {prefix}_OTHER_COUNT"])


LOANS = """SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU, CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Consumer credit' WHEN '2-HIGH' THEN 'Credit card' WHEN '3-MEDIUM' THEN 'Mortgage' ELSE o_orderpriority END AS CREDIT_TYPE,
  {days} AS DAYS_CREDIT, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {days} + o_orderkey % 900 END AS DAYS_CREDIT_ENDDATE, CASE WHEN o_orderstatus = 'F' THEN {days} + o_orderkey % 700 END AS DAYS_ENDDATE_FACT, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 40 ELSE 0 END AS CREDIT_DAY_OVERDUE,
  CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_totalprice END AS AMT_CREDIT_SUM, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 2 END AS AMT_CREDIT_SUM_DEBT, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 10 ELSE 0 END AS AMT_CREDIT_SUM_OVERDUE,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice - 100000 END AS AMT_CREDIT_SUM_LIMIT, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 20 END AS AMT_CREDIT_MAX_OVERDUE, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice / 30 END AS AMT_ANNUITY, o_orderkey % 3 AS CNT_CREDIT_PROLONG FROM orders"""
SPARK_DAYS, DUCK_DAYS = "datediff(o_orderdate, DATE '2001-08-01')", "date_diff('day', DATE '2001-08-01', CAST(o_orderdate AS DATE))"
BALANCES = "SELECT l_orderkey AS SK_ID_BUREAU, -l_linenumber AS MONTHS_BALANCE, CASE max(l_returnflag) WHEN 'A' THEN 'C' WHEN 'R' THEN CAST(max(l_linenumber) % 5 + 1 AS VARCHAR(1)) ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'X' ELSE '0' END END AS STATUS FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey, l_linenumber"
RENT = """SELECT o_custkey AS SK_ID_CURR, l_orderkey AS SK_ID_PREV, l_linenumber AS NUM_INSTALMENT_NUMBER, CAST({due} AS DOUBLE) AS DAYS_INSTALMENT, CAST(CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE {due} + l_partkey % 140 - 60 END AS DOUBLE) AS DAYS_ENTRY_PAYMENT,
  CASE WHEN l_partkey % 23 = 0 THEN 0 ELSE l_extendedprice END AS AMT_INSTALMENT, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS AMT_PAYMENT FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
SPARK_DUE, DUCK_DUE = "datediff(l_shipdate, DATE '2001-12-31')", "date_diff('day', DATE '2001-12-31', CAST(l_shipdate AS DATE))"
EARLIER = """SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_PREV, CASE o_orderstatus WHEN 'O' THEN 'Approved' WHEN 'F' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Cash loans' WHEN '2-HIGH' THEN 'XNA' ELSE o_orderpriority END AS NAME_CONTRACT_TYPE, CASE o_orderkey % 4 WHEN 0 THEN 'middle' WHEN 1 THEN 'high' WHEN 2 THEN 'XNA' END AS NAME_YIELD_GROUP,
  o_totalprice AS AMT_CREDIT, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice * 0.9 END AS AMT_APPLICATION, o_totalprice / 12 AS AMT_ANNUITY, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 8 END AS AMT_DOWN_PAYMENT, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice * 1.1 END AS AMT_GOODS_PRICE,
  CASE WHEN o_orderkey % 2 = 0 THEN 0.125 END AS RATE_DOWN_PAYMENT, {days} AS DAYS_DECISION, CAST(o_orderkey % 36 AS DOUBLE) AS CNT_PAYMENT FROM orders"""
MONTHS = """SELECT user_id AS SK_ID_CURR, user_id * 10 + CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS SK_ID_PREV, -CAST(row_number() OVER (PARTITION BY user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 4 END ORDER BY ts DESC, event_id) AS INTEGER) AS MONTHS_BALANCE,
  CASE WHEN event_id % 3 = 0 THEN 'Completed' ELSE 'Active' END AS NAME_CONTRACT_STATUS, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS AMT_BALANCE, CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(event_id % 5 + 1 AS DOUBLE) END AS AMT_CREDIT_LIMIT_ACTUAL, value / 2 AS AMT_PAYMENT_TOTAL_CURRENT, CAST(event_id % 4 AS DOUBLE) AS AMT_INST_MIN_REGULARITY,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 3 AS DOUBLE) END AS AMT_DRAWINGS_CURRENT, CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 60 ELSE 0 END AS INTEGER) AS SK_DPD, CAST(CASE WHEN event_id % 10 = 0 THEN event_id % 60 ELSE 0 END AS INTEGER) AS SK_DPD_DEF, CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(event_id % 24 AS DOUBLE) END AS CNT_INSTALMENT, CAST(event_id % 12 AS DOUBLE) AS CNT_INSTALMENT_FUTURE FROM events"""


def dressed(spark, d, sql, *names):
    """The frame that ``sql`` makes of the named tables."""
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql.replace("VARCHAR(1)", "STRING"), **{n: table(spark, d, n) for n in names})


def loans(spark, d):
    return dressed(spark, d, LOANS.replace("{days}", SPARK_DAYS), "orders")


def balances(spark, d):
    return dressed(spark, d, BALANCES, "lineitem")


_SEVERITY = "CASE WHEN STATUS = 'C' THEN 0 WHEN STATUS IN ('0', '1', '2', '3', '4', '5') THEN CAST(STATUS AS INTEGER) END"
_BUREAU_NAMES = [a.name for a in M.BUREAU + M.ACTIVE] + [f"BUREAU_CTYPE_{c}_COUNT" for c in [*M.CREDIT_TYPES, "OTHER"]] + ["BUREAU_LOANS_WITH_DPD_COUNT", "BUREAU_ACTIVE_LOAN_RATIO", "BUREAU_ACTIVE_UTILIZATION", "BUREAU_DEBT_CREDIT_RATIO_TOTAL", "BUREAU_OVERDUE_DEBT_RATIO_TOTAL"]


@query("mart_bureau_like", f"""
    WITH loans AS ({LOANS.replace('{days}', DUCK_DAYS)}),
    months AS (SELECT *, CASE WHEN STATUS_SEVERITY IS NOT NULL THEN 1 ELSE 0 END AS IS_OBSERVED, CASE WHEN STATUS_SEVERITY > 0 THEN 1 ELSE 0 END AS IS_DPD FROM (SELECT *, {_SEVERITY} AS STATUS_SEVERITY FROM ({BALANCES}))),
    per AS (SELECT *, {f32('BB_DPD_MONTH_SUM', 'BB_OBSERVED_MONTH_SUM')} AS BB_DPD_MONTH_SHARE FROM (SELECT SK_ID_BUREAU, {aggs(M.BALANCE)}, avg(STATUS_SEVERITY) FILTER (WHERE MONTHS_BALANCE >= -6) AS BB_RECENT_STATUS_MEAN, sum(IS_DPD) FILTER (WHERE MONTHS_BALANCE >= -6) AS BB_RECENT_DPD_SUM FROM months GROUP BY 1) LEFT JOIN {streak('months', 'SK_ID_BUREAU', 'MONTHS_BALANCE', 'IS_DPD', 'BB_LONGEST_DPD_STREAK', 'BB_DPD_EPISODES')} USING (SK_ID_BUREAU)),
    j AS (SELECT *, CASE WHEN CREDIT_ACTIVE = 'Active' THEN 1 ELSE 0 END AS IS_ACTIVE, CASE WHEN CREDIT_ACTIVE = 'Closed' THEN 1 ELSE 0 END AS IS_CLOSED, CASE WHEN CREDIT_DAY_OVERDUE > 0 THEN 1 ELSE 0 END AS HAS_OVERDUE, {f32('AMT_CREDIT_SUM_DEBT', 'AMT_CREDIT_SUM')} AS DEBT_CREDIT_RATIO, {f32('AMT_CREDIT_SUM_OVERDUE', 'AMT_CREDIT_SUM')} AS OVERDUE_CREDIT_RATIO FROM loans LEFT JOIN per USING (SK_ID_BUREAU)),
    g AS (SELECT SK_ID_CURR, {aggs(M.BUREAU)}, {hot('CREDIT_TYPE', M.CREDIT_TYPES, 'BUREAU_CTYPE')}, sum(AMT_CREDIT_SUM_DEBT) FILTER (WHERE IS_ACTIVE = 1) AS BUREAU_ACTIVE_DEBT_SUM, sum(AMT_CREDIT_SUM) FILTER (WHERE IS_ACTIVE = 1) AS BUREAU_ACTIVE_CREDIT_SUM, sum(AMT_CREDIT_SUM_LIMIT) FILTER (WHERE IS_ACTIVE = 1) AS BUREAU_ACTIVE_LIMIT_SUM, count(*) FILTER (WHERE IS_ACTIVE = 1) AS BUREAU_ACTIVE_LOAN_COUNT, count(*) FILTER (WHERE BB_DPD_MONTH_SUM > 0) AS BUREAU_LOANS_WITH_DPD_COUNT FROM j GROUP BY 1)
    {published(_BUREAU_NAMES, 'SK_ID_CURR')} FROM (SELECT *, {f32('BUREAU_ACTIVE_LOAN_COUNT', 'BUREAU_LOAN_COUNT')} AS BUREAU_ACTIVE_LOAN_RATIO, {f32('BUREAU_ACTIVE_DEBT_SUM', 'BUREAU_ACTIVE_CREDIT_SUM')} AS BUREAU_ACTIVE_UTILIZATION, {f32('BUREAU_AMT_CREDIT_SUM_DEBT_SUM', 'BUREAU_AMT_CREDIT_SUM_SUM')} AS BUREAU_DEBT_CREDIT_RATIO_TOTAL, {f32('BUREAU_AMT_CREDIT_SUM_OVERDUE_SUM', 'BUREAU_AMT_CREDIT_SUM_DEBT_SUM')} AS BUREAU_OVERDUE_DEBT_RATIO_TOTAL FROM g)""")
def mart_bureau_like(spark, d):
    return doubles(M.bureau(loans(spark, d), balances(spark, d)), M.CLIENT)


_HISTORY = [
    "LOAN_COUNT", "ACTIVE_COUNT", "SOLD_COUNT", "CREDIT_TYPE_NUNIQUE", "CREDIT_PROLONG_SUM", "ACTIVE_LOAN_RATIO", "BB_COVERAGE_RATIO",
    "CREDIT_SUM", "CREDIT_MAX", "DEBT_SUM", "DEBT_MEAN", "DEBT_MAX", "ACTIVE_CREDIT_SUM", "ACTIVE_DEBT_SUM", "OVERDUE_SUM", "LIMIT_SUM", "ANNUITY_SUM", "DEBT_CREDIT_RATIO", "OVERDUE_DEBT_RATIO",
    "DAYS_CREDIT_MAX", "DAYS_CREDIT_MIN", "DAYS_CREDIT_MEAN", "ACTIVE_ENDDATE_MAX", "CLOSED_ENDDATE_FACT_MAX", "CLOSED_ENDDATE_DELAY_MEAN", "BB_MONTHS_BALANCE_MIN", "BB_MONTHS_BALANCE_MAX", "BB_MONTHS_SINCE_LAST_DPD",
    "CREDIT_DAY_OVERDUE_MAX", "BB_MONTH_COUNT", "BB_STATUS_0_TOTAL_RATIO", "BB_STATUS_C_TOTAL_RATIO", "BB_ANY_DPD_TOTAL_RATIO", "BB_SEVERE_DPD_TOTAL_RATIO", "BB_ANY_DPD_OBSERVED_RATIO", "BB_SEVERE_DPD_OBSERVED_RATIO",
]


@query("mart_e03_like", f"""
    WITH loans AS ({LOANS.replace('{days}', DUCK_DAYS)}), m AS (SELECT SK_ID_BUREAU, count(*) AS t, count(*) FILTER (WHERE STATUS IN ('0','1','2','3','4','5')) AS o, count(*) FILTER (WHERE STATUS = '0') AS z, count(*) FILTER (WHERE STATUS = 'C') AS c, count(*) FILTER (WHERE STATUS IN ('1','2','3','4','5')) AS a, count(*) FILTER (WHERE STATUS IN ('3','4','5')) AS s, min(MONTHS_BALANCE) AS low, max(MONTHS_BALANCE) AS high, -max(MONTHS_BALANCE) FILTER (WHERE STATUS IN ('1','2','3','4','5')) AS since FROM ({BALANCES}) GROUP BY 1),
    j AS (SELECT * FROM loans LEFT JOIN m USING (SK_ID_BUREAU)),
    g AS (SELECT SK_ID_CURR, count(*) AS BUREAU_LOAN_COUNT, count(*) FILTER (WHERE CREDIT_ACTIVE = 'Active') AS BUREAU_ACTIVE_COUNT, count(*) FILTER (WHERE CREDIT_ACTIVE = 'Sold') AS BUREAU_SOLD_COUNT, count(DISTINCT CREDIT_TYPE) AS BUREAU_CREDIT_TYPE_NUNIQUE, sum(CNT_CREDIT_PROLONG) AS BUREAU_CREDIT_PROLONG_SUM,
      {f32("count(*) FILTER (WHERE CREDIT_ACTIVE = 'Active')", 'count(*)')} AS BUREAU_ACTIVE_LOAN_RATIO, {f32('count(t)', 'count(*)')} AS BUREAU_BB_COVERAGE_RATIO, sum(AMT_CREDIT_SUM) AS BUREAU_CREDIT_SUM, sum(AMT_CREDIT_SUM_DEBT) AS BUREAU_DEBT_SUM, avg(AMT_CREDIT_SUM_DEBT) AS BUREAU_DEBT_MEAN, sum(AMT_CREDIT_SUM) FILTER (WHERE CREDIT_ACTIVE = 'Active') AS BUREAU_ACTIVE_CREDIT_SUM,
      {f32('sum(AMT_CREDIT_SUM_DEBT)', 'sum(AMT_CREDIT_SUM)')} AS BUREAU_DEBT_CREDIT_RATIO, {f32('sum(AMT_CREDIT_SUM_OVERDUE)', 'sum(AMT_CREDIT_SUM_DEBT)')} AS BUREAU_OVERDUE_DEBT_RATIO, max(DAYS_CREDIT) AS BUREAU_DAYS_CREDIT_MAX, max(DAYS_CREDIT_ENDDATE) FILTER (WHERE CREDIT_ACTIVE = 'Active') AS BUREAU_ACTIVE_ENDDATE_MAX, avg(DAYS_ENDDATE_FACT - DAYS_CREDIT_ENDDATE) FILTER (WHERE CREDIT_ACTIVE = 'Closed') AS BUREAU_CLOSED_ENDDATE_DELAY_MEAN,
      min(low) AS BUREAU_BB_MONTHS_BALANCE_MIN, min(since) AS BUREAU_BB_MONTHS_SINCE_LAST_DPD, sum(coalesce(t, 0)) AS BUREAU_BB_MONTH_COUNT, {f32('sum(c)', 'sum(t)')} AS BUREAU_BB_STATUS_C_TOTAL_RATIO, {f32('sum(a)', 'sum(o)')} AS BUREAU_BB_ANY_DPD_OBSERVED_RATIO, {f32('sum(s)', 'sum(t)')} AS BUREAU_BB_SEVERE_DPD_TOTAL_RATIO,
      max(AMT_CREDIT_SUM) AS BUREAU_CREDIT_MAX, max(AMT_CREDIT_SUM_DEBT) AS BUREAU_DEBT_MAX, sum(AMT_CREDIT_SUM_DEBT) FILTER (WHERE CREDIT_ACTIVE = 'Active') AS BUREAU_ACTIVE_DEBT_SUM, sum(AMT_CREDIT_SUM_OVERDUE) AS BUREAU_OVERDUE_SUM, sum(AMT_CREDIT_SUM_LIMIT) AS BUREAU_LIMIT_SUM, sum(AMT_ANNUITY) AS BUREAU_ANNUITY_SUM,
      min(DAYS_CREDIT) AS BUREAU_DAYS_CREDIT_MIN, avg(DAYS_CREDIT) AS BUREAU_DAYS_CREDIT_MEAN, max(DAYS_ENDDATE_FACT) FILTER (WHERE CREDIT_ACTIVE = 'Closed') AS BUREAU_CLOSED_ENDDATE_FACT_MAX, max(high) AS BUREAU_BB_MONTHS_BALANCE_MAX, max(CREDIT_DAY_OVERDUE) AS BUREAU_CREDIT_DAY_OVERDUE_MAX,
      {f32('sum(z)', 'sum(t)')} AS BUREAU_BB_STATUS_0_TOTAL_RATIO, {f32('sum(a)', 'sum(t)')} AS BUREAU_BB_ANY_DPD_TOTAL_RATIO, {f32('sum(s)', 'sum(o)')} AS BUREAU_BB_SEVERE_DPD_OBSERVED_RATIO FROM j GROUP BY 1)
    {published([f'BUREAU_{n}' for n in _HISTORY], 'SK_ID_CURR')} FROM g""")
def mart_e03_like(spark, d):
    return doubles(M.bureau_history(loans(spark, d), balances(spark, d)), M.CLIENT)


_PREV = [a.name for a in M.PREVIOUS + M.APPROVED] + [f"PREV_CONTRACT_{c}_COUNT" for c in [*M.CONTRACT_TYPES, "OTHER"]] + [f"PREV_YIELD_{c}_COUNT" for c in [*M.YIELD_GROUPS, "OTHER"]] + ["PREV_RECENT_REFUSAL_COUNT", "PREV_HAS_RECENT_REFUSAL", "PREV_AMT_APPLICATION_TREND"]


@query("mart_previous_like", f"""
    WITH p AS (SELECT *, CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 1 ELSE 0 END AS IS_APPROVED, CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 ELSE 0 END AS IS_REFUSED, CASE WHEN NAME_CONTRACT_STATUS = 'Canceled' THEN 1 ELSE 0 END AS IS_CANCELLED, CAST(CAST(CAST(AMT_APPLICATION AS FLOAT) AS DOUBLE) - CAST(CAST(AMT_CREDIT AS FLOAT) AS DOUBLE) AS FLOAT) AS AMT_DIFF_APPLICATION_CREDIT, {f32('AMT_DOWN_PAYMENT', 'AMT_GOODS_PRICE')} AS DOWN_PAYMENT_RATIO, {f32('AMT_CREDIT', 'AMT_GOODS_PRICE')} AS LOAN_TO_PRICE FROM ({EARLIER.replace('{days}', DUCK_DAYS)})),
    r AS (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_DECISION DESC, SK_ID_PREV DESC) AS rank FROM p), t AS (SELECT SK_ID_CURR, AMT_APPLICATION AS v, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY rank DESC) - 1 AS place FROM r WHERE rank <= 5 AND AMT_APPLICATION IS NOT NULL),
    s AS (SELECT SK_ID_CURR, CASE WHEN count(*) > 1 THEN regr_slope(v, place) END AS PREV_AMT_APPLICATION_TREND FROM t GROUP BY 1),
    g AS (SELECT SK_ID_CURR, {aggs(M.PREVIOUS)}, {hot('NAME_CONTRACT_TYPE', M.CONTRACT_TYPES, 'PREV_CONTRACT')}, {hot('NAME_YIELD_GROUP', M.YIELD_GROUPS, 'PREV_YIELD')}, max(AMT_CREDIT) FILTER (WHERE IS_APPROVED = 1) AS PREV_HIST_CREDIT_MAX, avg(AMT_CREDIT) FILTER (WHERE IS_APPROVED = 1) AS PREV_HIST_CREDIT_MEAN, max(AMT_ANNUITY) FILTER (WHERE IS_APPROVED = 1) AS PREV_HIST_ANNUITY_MAX, count(*) FILTER (WHERE IS_REFUSED = 1 AND DAYS_DECISION >= -365) AS PREV_RECENT_REFUSAL_COUNT FROM p GROUP BY 1)
    {published(_PREV, 'SK_ID_CURR')} FROM (SELECT *, CASE WHEN PREV_RECENT_REFUSAL_COUNT > 0 THEN 1 ELSE 0 END AS PREV_HAS_RECENT_REFUSAL FROM g LEFT JOIN s USING (SK_ID_CURR))""")
def mart_previous_like(spark, d):
    return doubles(M.previous_application(dressed(spark, d, EARLIER.replace("{days}", SPARK_DAYS), "orders")), M.CLIENT)


_RANKED = "row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_INSTALMENT DESC, NUM_INSTALMENT_NUMBER DESC, SK_ID_PREV DESC, DAYS_ENTRY_PAYMENT DESC NULLS LAST, AMT_PAYMENT DESC NULLS LAST)"
_WINDOWS = ", ".join(f"avg(DPD) FILTER (WHERE due >= -{w}) AS INST_DPD_{w}D_MEAN, max(DPD) FILTER (WHERE due >= -{w}) AS INST_DPD_{w}D_MAX, sum(IS_LATE) FILTER (WHERE due >= -{w}) AS INST_LATE_{w}D_SUM, sum(UNDERPAYMENT) FILTER (WHERE due >= -{w}) AS INST_UNDERPAYMENT_{w}D_SUM, nullif(count(*) FILTER (WHERE due >= -{w}), 0) AS INST_{w}D_COUNT, avg(PAYMENT_RATIO) FILTER (WHERE due >= -{w}) AS INST_PAYMENT_RATIO_{w}D_MEAN" for w in M.TRAILING)
_LAST = ", ".join(f"avg(DPD) FILTER (WHERE rank <= {n}) AS INST_LAST{n}_DPD_MEAN, max(DPD) FILTER (WHERE rank <= {n}) AS INST_LAST{n}_DPD_MAX, avg(PAYMENT_RATIO) FILTER (WHERE rank <= {n}) AS INST_LAST{n}_PAYMENT_RATIO_MEAN, sum(IS_LATE) FILTER (WHERE rank <= {n}) AS INST_LAST{n}_LATE_SUM" for n in M.SEQUENCES)
_INST = [a.name for a in M.INSTALMENT_CLIENT + M.LIFETIME] + [f"INST_{x}" for w in M.TRAILING for x in (f"DPD_{w}D_MEAN", f"DPD_{w}D_MAX", f"LATE_{w}D_SUM", f"PAYMENT_RATIO_{w}D_MEAN", f"UNDERPAYMENT_{w}D_SUM", f"{w}D_COUNT", f"LATE_RATE_{w}D", f"DPD_RECENT_MINUS_LIFE_{w}D", f"LATE_RATE_RECENT_MINUS_LIFE_{w}D")] + [f"INST_LAST{n}_{x}" for n in M.SEQUENCES for x in ("DPD_MEAN", "DPD_MAX", "PAYMENT_RATIO_MEAN", "LATE_SUM")] + ["INST_LOANS_WITH_LATE_COUNT", "INST_DAYS_SINCE_LAST_LATE", "INST_DPD_TREND_SLOPE", "INST_PAYMENT_RATIO_TREND_SLOPE", "INST_LATE_RATE_LIFETIME"]
_LATE = f32("INST_LATE_LIFETIME_SUM", "INST_COUNT_LIFETIME_COUNT")
_RATES = ", ".join(f"{f32(f'INST_LATE_{w}D_SUM', f'INST_{w}D_COUNT')} AS INST_LATE_RATE_{w}D, {minus(f'INST_DPD_{w}D_MEAN', 'INST_DPD_LIFETIME_MEAN')} AS INST_DPD_RECENT_MINUS_LIFE_{w}D, {minus(f32(f'INST_LATE_{w}D_SUM', f'INST_{w}D_COUNT'), _LATE)} AS INST_LATE_RATE_RECENT_MINUS_LIFE_{w}D" for w in M.TRAILING)


@query("mart_installments_like", f"""
    WITH r AS (SELECT *, DAYS_INSTALMENT AS due, CASE WHEN DPD > 0 THEN 1 ELSE 0 END AS IS_LATE, CASE WHEN UNDERPAYMENT > 0 THEN 1 ELSE 0 END AS IS_UNDERPAID, {', '.join(f'CASE WHEN DPD >= {k} THEN 1 ELSE 0 END AS DPD_GE_{k}' for k in (7, 30, 60, 90))}, {_RANKED} AS rank
      FROM (SELECT *, CASE WHEN DAYS_ENTRY_PAYMENT IS NOT NULL THEN greatest(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0) END AS DPD, {f32('AMT_PAYMENT', 'AMT_INSTALMENT')} AS PAYMENT_RATIO, CASE WHEN AMT_PAYMENT IS NOT NULL THEN greatest(AMT_INSTALMENT - AMT_PAYMENT, 0) END AS UNDERPAYMENT FROM ({RENT.replace('{due}', DUCK_DUE)}))),
    l AS (SELECT *, {f32('LATE_SUM', 'INST_COUNT')} AS LATE_RATE, {f32('UNDERPAID_SUM', 'INST_COUNT')} AS UNDERPAID_RATE FROM (SELECT SK_ID_CURR, SK_ID_PREV, {aggs(M.INSTALMENT_LOAN)} FROM r GROUP BY 1, 2) LEFT JOIN {streak('r', 'SK_ID_PREV', 'NUM_INSTALMENT_NUMBER, DAYS_INSTALMENT, DAYS_ENTRY_PAYMENT NULLS FIRST, AMT_PAYMENT NULLS FIRST', 'IS_LATE', 'LONGEST_LATE_STREAK', 'LATE_EPISODES')} USING (SK_ID_PREV)),
    c AS (SELECT SK_ID_CURR, {aggs(M.INSTALMENT_CLIENT)}, count(*) FILTER (WHERE LATE_SUM > 0) AS INST_LOANS_WITH_LATE_COUNT FROM l GROUP BY 1),
    f AS (SELECT SK_ID_CURR, {aggs(M.LIFETIME)}, {_WINDOWS}, {_LAST}, -max(due) FILTER (WHERE IS_LATE = 1) AS INST_DAYS_SINCE_LAST_LATE FROM r GROUP BY 1),
    p AS (SELECT SK_ID_CURR, DPD AS v, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY rank DESC) - 1 AS place FROM r WHERE rank <= 20 AND DPD IS NOT NULL), s AS (SELECT SK_ID_CURR, CASE WHEN count(*) > 1 THEN regr_slope(v, place) END AS INST_DPD_TREND_SLOPE FROM p GROUP BY 1),
    q AS (SELECT SK_ID_CURR, PAYMENT_RATIO AS v, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY rank DESC) - 1 AS place FROM r WHERE rank <= 20 AND PAYMENT_RATIO IS NOT NULL), u AS (SELECT SK_ID_CURR, CASE WHEN count(*) > 1 THEN regr_slope(v, place) END AS INST_PAYMENT_RATIO_TREND_SLOPE FROM q GROUP BY 1)
    {published(_INST, 'SK_ID_CURR')} FROM (SELECT *, {_LATE} AS INST_LATE_RATE_LIFETIME, {_RATES} FROM c JOIN f USING (SK_ID_CURR) LEFT JOIN s USING (SK_ID_CURR) LEFT JOIN u USING (SK_ID_CURR))""")
def mart_installments_like(spark, d):
    return doubles(M.installments(dressed(spark, d, RENT.replace("{due}", SPARK_DUE), "lineitem", "orders")), M.CLIENT)


@query("mart_installments_full")
def mart_installments_full(spark, d):
    """All 86 features, rows only."""
    return M.installments(dressed(spark, d, RENT.replace("{due}", SPARK_DUE), "lineitem", "orders"))


_CARD_SPEC = [a for a in M.CARD if a.stat != "last"]
_CARD = [a.name for a in M.CARD_CLIENT + M.CARD_RECENT] + ["CC_PORTFOLIO_BALANCE", "CC_PORTFOLIO_LIMIT", "CC_PORTFOLIO_UTILIZATION"]


@query("mart_card_like", f"""
    WITH r AS (SELECT *, CASE WHEN UTILIZATION > 0.9 THEN 1 ELSE 0 END AS IS_HIGH_UTILIZATION, CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END AS IS_DPD, CASE WHEN NAME_CONTRACT_STATUS = 'Active' THEN 1 ELSE 0 END AS IS_ACTIVE, CASE WHEN AMT_DRAWINGS_CURRENT > 0 THEN 1 ELSE 0 END AS HAS_DRAWING
      FROM (SELECT *, {f32('AMT_BALANCE', 'AMT_CREDIT_LIMIT_ACTUAL')} AS UTILIZATION, {f32('AMT_PAYMENT_TOTAL_CURRENT', 'AMT_INST_MIN_REGULARITY')} AS PAYMENT_RATIO FROM ({MONTHS}))),
    p AS (SELECT SK_ID_PREV, UTILIZATION AS v, row_number() OVER (PARTITION BY SK_ID_PREV ORDER BY MONTHS_BALANCE) - 1 AS place FROM r WHERE UTILIZATION IS NOT NULL), s AS (SELECT SK_ID_PREV, CASE WHEN count(*) > 1 THEN regr_slope(v, place) END AS CC_UTIL_TREND_SLOPE FROM p GROUP BY 1),
    c AS (SELECT *, {f32('CC_HIGH_UTIL_MONTH_SUM', 'CC_MONTHS_COUNT')} AS CC_HIGH_UTIL_RATE, {f32('CC_DPD_MONTH_SUM', 'CC_MONTHS_COUNT')} AS CC_DPD_RATE FROM (SELECT SK_ID_CURR, SK_ID_PREV, {aggs(_CARD_SPEC)}, {', '.join(f'max_by({c}, MONTHS_BALANCE) FILTER (WHERE {c} IS NOT NULL) AS {n}_LAST' for c, n in (('UTILIZATION', 'UTILIZATION'), ('AMT_BALANCE', 'AMT_BALANCE'), ('AMT_CREDIT_LIMIT_ACTUAL', 'AMT_CREDIT_LIMIT_ACTUAL'), ('IS_ACTIVE', 'CC_ACTIVE')))} FROM r GROUP BY 1, 2) LEFT JOIN s USING (SK_ID_PREV)),
    g AS (SELECT SK_ID_CURR, {aggs(M.CARD_CLIENT)}, sum(AMT_BALANCE_LAST) AS CC_PORTFOLIO_BALANCE, sum(AMT_CREDIT_LIMIT_ACTUAL_LAST) AS CC_PORTFOLIO_LIMIT FROM c GROUP BY 1), n AS (SELECT SK_ID_CURR, {aggs(M.CARD_RECENT)} FROM r WHERE MONTHS_BALANCE >= -6 GROUP BY 1)
    {published(_CARD, 'SK_ID_CURR')} FROM (SELECT *, {f32('CC_PORTFOLIO_BALANCE', 'CC_PORTFOLIO_LIMIT')} AS CC_PORTFOLIO_UTILIZATION FROM g LEFT JOIN n USING (SK_ID_CURR))""")
def mart_card_like(spark, d):
    return doubles(M.credit_card(dressed(spark, d, MONTHS, "events")), M.CLIENT)


_POS = [a.name for a in M.POS_CLIENT + M.POS_RECENT] + ["POS_CONTRACTS_WITH_DPD_COUNT", "POS_COMPLETION_RATE", "POS_DPD_CONTRACT_RATIO"]


@query("mart_pos_like", f"""
    WITH r AS (SELECT *, CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END AS IS_DPD, CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 1 ELSE 0 END AS IS_COMPLETED, {f32('(CNT_INSTALMENT - CNT_INSTALMENT_FUTURE)', 'CNT_INSTALMENT')} AS COMPLETION_RATIO FROM ({MONTHS})),
    c AS (SELECT *, {f32('POS_DPD_MONTH_SUM', 'POS_MONTHS_COUNT')} AS POS_DPD_RATE FROM (SELECT SK_ID_CURR, SK_ID_PREV, {aggs(M.POS)} FROM r GROUP BY 1, 2) LEFT JOIN {streak('r', 'SK_ID_PREV', 'MONTHS_BALANCE', 'IS_DPD', 'POS_LONGEST_DPD_STREAK', 'POS_DPD_EPISODES')} USING (SK_ID_PREV)),
    g AS (SELECT SK_ID_CURR, {aggs(M.POS_CLIENT)}, count(*) FILTER (WHERE POS_DPD_MONTH_SUM > 0) AS POS_CONTRACTS_WITH_DPD_COUNT FROM c GROUP BY 1), n AS (SELECT SK_ID_CURR, {aggs(M.POS_RECENT)} FROM r WHERE MONTHS_BALANCE >= -6 GROUP BY 1)
    {published(_POS, 'SK_ID_CURR')} FROM (SELECT *, {f32('POS_POS_COMPLETED_SUM', 'POS_POS_CONTRACT_COUNT')} AS POS_COMPLETION_RATE, {f32('POS_CONTRACTS_WITH_DPD_COUNT', 'POS_POS_CONTRACT_COUNT')} AS POS_DPD_CONTRACT_RATIO FROM g LEFT JOIN n USING (SK_ID_CURR))""")
def mart_pos_like(spark, d):
    return doubles(M.pos_cash(dressed(spark, d, MONTHS, "events")), M.CLIENT)


APPLICATIONS = """SELECT o_orderkey AS SK_ID_CURR, CAST(o_orderkey % 2 AS INTEGER) AS TARGET, o_totalprice AS AMT_CREDIT, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_totalprice / 3 END AS AMT_INCOME_TOTAL, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice / 20 END AS AMT_ANNUITY, o_totalprice * 0.9 AS AMT_GOODS_PRICE,
  CAST(o_orderkey % 5 AS DOUBLE) AS CNT_FAM_MEMBERS, CAST(o_orderkey % 3 AS DOUBLE) AS CNT_CHILDREN, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey % 20 AS DOUBLE) END AS OWN_CAR_AGE, CAST(-10000 - o_orderkey % 9000 AS DOUBLE) AS DAYS_BIRTH, CASE WHEN o_orderkey % 6 = 0 THEN 365243.0 ELSE CAST(-(o_orderkey % 4000) AS DOUBLE) END AS DAYS_EMPLOYED, CAST(-(o_orderkey % 1500) AS DOUBLE) AS DAYS_LAST_PHONE_CHANGE,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 97) / CAST(97 AS DOUBLE) END AS EXT_SOURCE_1, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 89) / CAST(89 AS DOUBLE) END AS EXT_SOURCE_2, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 83) / CAST(83 AS DOUBLE) END AS EXT_SOURCE_3,
  CAST(o_orderkey % 2 AS DOUBLE) AS FLAG_DOCUMENT_2, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 1.0 END AS FLAG_DOCUMENT_3, CAST(o_orderkey % 2 AS DOUBLE) AS FLAG_MOBIL, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 1.0 END AS FLAG_PHONE,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 0.5 END AS APARTMENTS_AVG, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 13) / CAST(13 AS DOUBLE) END AS APARTMENTS_MODE, (o_orderkey % 5) / CAST(5 AS DOUBLE) AS APARTMENTS_MEDI, (o_orderkey % 7) / CAST(7 AS DOUBLE) AS BASEMENTAREA_AVG, CASE WHEN o_orderkey % 22 = 0 THEN NULL ELSE 0.75 END AS BASEMENTAREA_MODE, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE (o_orderkey % 19) / CAST(19 AS DOUBLE) END AS BASEMENTAREA_MEDI, 'brick' AS WALLSMATERIAL_MODE FROM orders"""


def applications(spark, d):
    t = dressed(spark, d, APPLICATIONS, "orders")
    return t.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in t.dtypes])


_EXT = P.EXTERNAL
_MISSING = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _EXT)
_EMPLOYED = "CASE WHEN DAYS_EMPLOYED <> 365243 THEN DAYS_EMPLOYED END"


def over(columns, how):
    """An aggregate of what is there of a row's columns: lists leave missing values out."""
    return f"list_aggregate([{', '.join(columns)}], '{how}')"


def halves(a, b):
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


_E01 = {
    "DAYS_EMPLOYED_ANOMALOUS": "CASE WHEN DAYS_EMPLOYED = 365243 THEN 1 ELSE 0 END",
    **{name: halves(_EMPLOYED if a == "DAYS_EMPLOYED" else a, b) for name, (a, b) in P.RATIOS.items()},
    "CAR_BIRTH_RATIO": "OWN_CAR_AGE / abs(DAYS_BIRTH)",
    **{f"EXT_SOURCE_{k}": over(_EXT, how) for k, how in (("MEAN", "avg"), ("MEDIAN", "median"), ("MIN", "min"), ("MAX", "max"), ("STD", "stddev_samp"))},
    "EXT_SOURCE_MISSING_COUNT": _MISSING,
    "EXT_SOURCE_PRODUCT": f"CASE WHEN {_MISSING} < 2 THEN {over(_EXT, 'product')} END",
    "EXT_SOURCE_RANGE": f"{over(_EXT, 'max')} - {over(_EXT, 'min')}",
    **{name: sql for i, a in enumerate(_EXT) for b in _EXT[i + 1 :] for name, sql in ((f"{a}_MINUS_{b}", f"{a} - {b}"), (f"{a}_DIV_{b}", halves(a, b)), (f"{b}_DIV_{a}", halves(b, a)))},
    "DOCUMENT_FLAG_COUNT": "FLAG_DOCUMENT_2 + coalesce(FLAG_DOCUMENT_3, 0)",
    "CONTACT_FLAG_COUNT": "FLAG_MOBIL + coalesce(FLAG_PHONE, 0)",
    "HOUSING_AVG_MEAN": over(["APARTMENTS_AVG", "BASEMENTAREA_AVG"], "avg"),
}


@query("e01_ratios", f"{published(_E01, 'SK_ID_CURR')} FROM (SELECT SK_ID_CURR, {', '.join(f'{v} AS {k}' for k, v in _E01.items())} FROM ({APPLICATIONS}))")
def e01_ratios(spark, d):
    return doubles(P.first_set(applications(spark, d)).select("SK_ID_CURR", *_E01), "SK_ID_CURR")


_FLOATS = [f"CAST(CAST({c} AS FLOAT) AS DOUBLE)" for c in _EXT]
_E02 = {
    **{name: f32(*P.RATIOS[name]) for name in P.FOUR},
    "CREDIT_ANNUITY_RATIO": f32("AMT_CREDIT", "AMT_ANNUITY"),
    "CREDIT_GOODS_DIFF": "CAST(AMT_CREDIT - AMT_GOODS_PRICE AS FLOAT)",
    "AGE_YEARS": "CAST(-DAYS_BIRTH / 365.25 AS FLOAT)",
    "EMPLOYED_YEARS": "CASE WHEN DAYS_EMPLOYED <> 365243 THEN CAST(-DAYS_EMPLOYED / 365.25 AS FLOAT) END",
    "EMPLOYED_AGE_RATIO": f32(_EMPLOYED, "DAYS_BIRTH"),
    **{f"EXT_SOURCE_{k}": f"CAST({over(_FLOATS, how)} AS FLOAT)" for k, how in (("MEAN", "avg"), ("MIN", "min"), ("MAX", "max"), ("STD", "stddev_samp"))},
    "EXT_SOURCE_COUNT": f"3 - ({_MISSING})",
    "DOCUMENT_COUNT": "FLAG_DOCUMENT_2 + coalesce(FLAG_DOCUMENT_3, 0)",
    "CONTACT_COUNT": "FLAG_MOBIL + coalesce(FLAG_PHONE, 0)",
    "PHONE_CHANGE_YEARS": "CAST(-DAYS_LAST_PHONE_CHANGE / 365.25 AS FLOAT)",
    "CHILDREN_RATIO": f32(*P.RATIOS["CHILDREN_RATIO"]),
    **{f"HOUSING_NUMERIC_{s}_{k}": f"CAST({over([f'CAST(CAST({b}_{s} AS FLOAT) AS DOUBLE)' for b in ('APARTMENTS', 'BASEMENTAREA')], how)} AS FLOAT)" for s in ("AVG", "MODE", "MEDI") for k, how in (("MEAN", "avg"), ("MIN", "min"), ("MAX", "max"))},
}


@query("e02_families", f"{published(_E02, 'SK_ID_CURR')} FROM (SELECT SK_ID_CURR, {', '.join(f'{v} AS {k}' for k, v in _E02.items())} FROM ({APPLICATIONS}))")
def e02_families(spark, d):
    return doubles(P.second_set(applications(spark, d)).select("SK_ID_CURR", *_E02), "SK_ID_CURR")


_NRD = {"ANNUITY_INCOME_RATIO": f32("AMT_ANNUITY", "AMT_INCOME_TOTAL"), "GOODS_CREDIT_RATIO": f32("AMT_GOODS_PRICE", "AMT_CREDIT"), "CREDIT_ANNUITY_RATIO": f32("AMT_CREDIT", "AMT_ANNUITY")}


@query("factorial_nrd", f"{published(_NRD, 'SK_ID_CURR')} FROM (SELECT SK_ID_CURR, {', '.join(f'{v} AS {k}' for k, v in _NRD.items())} FROM ({APPLICATIONS}))")
def factorial_nrd(spark, d):
    return doubles(P.factorial(applications(spark, d), "NR").select("SK_ID_CURR", *_NRD), "SK_ID_CURR")


_NRD_ALL = _NRD | {"CREDIT_INCOME_RATIO": f32("AMT_CREDIT", "AMT_INCOME_TOTAL"), "INCOME_PER_PERSON": f32("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"), "CREDIT_GOODS_DIFF": "CAST(AMT_CREDIT - AMT_GOODS_PRICE AS FLOAT)"}


@query("factorial_all", f"{published(_NRD_ALL, 'SK_ID_CURR')} FROM (SELECT SK_ID_CURR, {', '.join(f'{v} AS {k}' for k, v in _NRD_ALL.items())} FROM ({APPLICATIONS}))")
def factorial_all(spark, d):
    """All three changes at once."""
    return doubles(P.factorial(applications(spark, d), "NRD").select("SK_ID_CURR", *_NRD_ALL), "SK_ID_CURR")


@query("replayed_ratios", "SELECT count(*) AS n, true AS same, false AS same_without_difference FROM orders")
def replayed_ratios(spark, d):
    """Whether the three changes together are the second set's ratios, value by value, and two of them are not."""
    from riskloom.operators.gates import same_matrix

    t = applications(spark, d)
    second = P.second_set(t, ["ratios"])
    same, less = (same_matrix(P.factorial(t, f), second, "SK_ID_CURR") for f in ("NRD", "NR"))
    return t.agg(F.count("*").alias("n"), F.lit(same).alias("same"), F.lit(less).alias("same_without_difference"))


@query("aggregation_diagnostics", f"""
    WITH l AS ({LOANS.replace('{days}', DUCK_DAYS)}), b AS ({BALANCES})
    SELECT (SELECT count(*) FROM l) AS loan_rows, (SELECT count(*) FROM b) AS month_rows, (SELECT count(DISTINCT SK_ID_BUREAU) FROM b) AS month_loans, (SELECT count(*) FROM l WHERE SK_ID_BUREAU IN (SELECT SK_ID_BUREAU FROM b)) AS covered_loans, (SELECT count(DISTINCT SK_ID_CURR) FROM l) AS feature_rows, (SELECT count(*) FROM b WHERE STATUS IS NULL) AS unknown_status""")
def aggregation_diagnostics(spark, d):
    """Counts of a nested aggregation, taken by its own run: rows in, loans with months, loans covered, rows out."""
    from riskloom.operators.aggregation import observed

    one, own = F.count("*"), spark.newSession()  # see ``observed``
    months, of_months = observed(balances(own, d), "months", month_rows=one, unknown_status=F.count_if(F.col("STATUS").isNull()))
    per_loan, of_loans = observed(months.groupBy("SK_ID_BUREAU").agg(F.count("*").alias("months")), "months by loan", month_loans=one)
    rows, of_rows = observed(loans(own, d).select("SK_ID_CURR", "SK_ID_BUREAU").join(per_loan, "SK_ID_BUREAU", "left"), "loans", loan_rows=one, covered_loans=F.count("months"))
    out, of_out = observed(rows.groupBy("SK_ID_CURR").agg(F.sum("months").alias("months")), "clients", feature_rows=one)
    out.write.format("noop").mode("overwrite").save()  # the features' own job; the metrics come with it
    said = {k: v for o in (of_months, of_loans, of_rows, of_out) for k, v in o.get.items()}
    return spark.createDataFrame([tuple(said.values())], ", ".join(f"{k} long" for k in said))


@query("block_roundtrip")
def block_roundtrip(spark, d):
    """A mart saved as a block, loaded again and merged onto the applicants; rows only."""
    import uuid

    from riskloom.operators.aggregation import merge_blocks
    from riskloom.sources.staging import shared_folder
    from riskloom.sources.store import load_block, save_block

    root = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    mart = M.previous_application(dressed(spark, d, EARLIER.replace("{days}", SPARK_DAYS), "orders"))
    mart = mart.toDF(*[c.replace(" ", "_") for c in mart.columns])
    save_block(mart, "previous_application", root, M.VERSIONS["previous_application"], {c: "all" for c in mart.columns if c != M.CLIENT})
    block, _ = load_block(spark, "previous_application", root, M.VERSIONS["previous_application"])
    clients = table(spark, d, "customer").select(F.col("c_custkey").alias(M.CLIENT))
    return merge_blocks(clients, {"previous_application": block}, M.CLIENT, {"previous_application": ["PREV_APPLICATION_COUNT", "PREV_AMT_CREDIT_MAX"]})


def _labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")


@query("cv_gbt_oof")
def cv_gbt_oof(spark, d):
    """Out-of-fold scores of boosted trees on labelled documents' lengths and languages; rows only."""
    from riskloom.operators.evaluation import stratified_folds
    from riskloom.operators.modeling import cross_validate

    t = _labelled(spark, d)
    folds = stratified_folds(t, "doc_id", "quality", 3)
    return cross_validate(t, folds.drop("quality"), "doc_id", "quality", ["n_chars", "lang"], "gbt", {"maxIter": 8, "maxDepth": 3}).oof


_CV_FOLDS = "f AS (SELECT l.doc_id, l.quality, CAST((row_number() OVER (PARTITION BY l.quality ORDER BY md5(concat('42:', l.doc_id)), l.doc_id) - 1) % 3 + 1 AS INTEGER) AS fold FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query("cv_contract", f"""
    WITH {_CV_FOLDS} SELECT fold, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives, count(*) AS covered_once, CAST(0 AS BIGINT) AS invalid, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS test_rows, 0.0::DOUBLE AS test_gap, 1.0::DOUBLE AS importance, true AS stopped FROM f GROUP BY fold""")
def cv_contract(spark, d):
    """Per fold of boosted trees: its rows, how often they are scored, how far the test scores are from the mean of the
    models' scores, the sum of the importances, and whether the trees kept to the most allowed."""
    from riskloom.operators.evaluation import stratified_folds
    from riskloom.operators.modeling import cross_validate

    t, most = _labelled(spark, d), 6
    unknown = table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")
    v = cross_validate(t, stratified_folds(t, "doc_id", "quality", 3).drop("quality"), "doc_id", "quality", ["n_chars", "lang"], "gbt", {"maxIter": most, "maxDepth": 3}, test=unknown)
    per_key = v.oof.groupBy("fold", "doc_id", "quality").agg(F.count("*").alias("times"), F.sum(F.when(F.col("score").between(0, 1), 0).otherwise(1)).alias("bad"))
    rows = per_key.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("positives"), F.count_if(F.col("times") == 1).alias("covered_once"), F.sum("bad").alias("invalid"))
    scores = [F.col(c) for c in v.test.columns if c.startswith("score_")]
    test = v.test.agg(F.count("*").alias("test_rows"), F.round(F.max(F.abs(F.col("score") - sum(scores, F.lit(0.0)) / len(scores))), 9).alias("test_gap"))
    total = v.importances.groupBy("fold").agg(F.round(F.sum("importance"), 6).alias("importance"))
    ended = spark.createDataFrame([(k, 1 <= n <= most) for k, n in enumerate(v.best_iterations, 1)], "fold int, stopped boolean")
    return rows.join(total, "fold").join(ended, "fold").join(F.broadcast(test))  # one row


@query("cv_importances", """
    SELECT * FROM (VALUES ('long_text', 1.0::DOUBLE, 0.0::DOUBLE, 3::BIGINT), ('lang', 0.0, 0.0, 3), ('source', 0.0, 0.0, 3)) v(feature, mean, deviation, folds) WHERE (SELECT count(DISTINCT n_chars >= 1500) FROM labels l JOIN documents d ON l.doc_id = d.doc_id) = 2""")
def cv_importances(spark, d):
    """Importances over the folds where one feature tells the classes apart: it has all of it in every fold."""
    from riskloom.operators.evaluation import importance_summary, stratified_folds
    from riskloom.operators.modeling import cross_validate

    t = _labelled(spark, d).withColumn("long_text", (F.col("n_chars") >= 1500).cast("int")).withColumn("y", F.col("long_text"))
    v = cross_validate(t, stratified_folds(t, "doc_id", "y", 3).drop("y"), "doc_id", "y", ["lang", "source", "long_text"], "gbt", {"maxIter": 3, "maxDepth": 2})
    folds = v.importances.groupBy("feature").agg(F.count("*").alias("folds"))
    return importance_summary(v.importances).join(folds, "feature").select("feature", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "folds")


# Text columns by their names in the application table, here over orders.
_TEXT = {"NAME_EDUCATION_TYPE": "o_orderpriority", "CODE_GENDER": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END", "ORGANIZATION_TYPE": "CASE WHEN o_orderkey % 4 = 0 THEN concat('only test ', o_orderkey % 3) ELSE concat('Ä ', o_custkey % 50) END"}
_WITH_TEXT = APPLICATIONS.replace(" FROM orders", "".join(f", {v} AS {k}" for k, v in _TEXT.items()) + " FROM orders")


def application_tables(spark, d):
    """Train rows with their target and test rows without, by the remainder of the id."""
    t = dressed(spark, d, _WITH_TEXT, "orders")
    t = t.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in t.dtypes])
    return t.where("SK_ID_CURR % 4 <> 0"), t.where("SK_ID_CURR % 4 = 0").drop("TARGET")


@query("prepared_application", f"""
    SELECT SK_ID_CURR, CASE WHEN SK_ID_CURR % 4 = 0 THEN 'test' ELSE 'train' END AS side, CASE WHEN SK_ID_CURR % 4 <> 0 THEN TARGET END AS target, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (ORDER BY {c}) - 1 END AS {c}' for c in [*_TEXT, 'WALLSMATERIAL_MODE'])}, round(CAST({f32('AMT_CREDIT', 'AMT_ANNUITY')} AS DOUBLE), 4) AS CREDIT_ANNUITY_RATIO FROM ({_WITH_TEXT})""")
def prepared_application(spark, d):
    """Both tables with the second feature set, text coded by their shared vocabulary."""
    from riskloom.operators.prepared import prepare

    p = prepare(*application_tables(spark, d), P.second_set)
    named = ["SK_ID_CURR", *p.categorical, F.round(F.col("CREDIT_ANNUITY_RATIO").cast("double"), 4).alias("CREDIT_ANNUITY_RATIO")]
    train = p.train.select(F.lit("train").alias("side"), F.col("TARGET").alias("target"), *named)
    return train.unionByName(p.test.select(F.lit("test").alias("side"), F.lit(None).cast("int").alias("target"), *named))


@query("newest_loans", f"SELECT SK_ID_CURR, SK_ID_BUREAU, CAST(row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_CREDIT DESC, SK_ID_BUREAU) AS INTEGER) AS place FROM ({LOANS.replace('{days}', DUCK_DAYS)}) QUALIFY row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_CREDIT DESC, SK_ID_BUREAU) <= 3")
def newest_loans(spark, d):
    return newest(loans(spark, d), [M.CLIENT], [F.desc("DAYS_CREDIT"), F.col(M.LOAN)], 3, "place").select(M.CLIENT, M.LOAN, "place")
