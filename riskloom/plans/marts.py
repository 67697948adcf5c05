"""Feature marts: monthly and instalment rows to loan to client, one row per client.

Tables carry the public credit schema (SK_ID_CURR, SK_ID_PREV, ...). Every window and sequence is a conditional
aggregate of one group-by; loan and client level share the partitioning by client where the loan belongs to it. NULL
client keys are left out. Only counts of things that can't be missing are filled with 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import at_least_zero, clean, flag, float_difference, safe_divide
from riskloom.operators.aggregation import Agg, aggregate, families, fill_counts, one_hot, safe_name, specs
from riskloom.operators.ordered import newest, slopes, streaks

CLIENT, LOAN, CONTRACT = "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV"
VERSIONS = {"bureau": "bureau-v1", "previous_application": "previous-application-v1", "installments": "installments-v1", "credit_card": "credit-card-v1", "pos_cash": "pos-cash-v1"}

# What is aggregated at each grain, and the declared categories.
BALANCE = specs("""
counts BB_MONTHS=MONTHS_BALANCE count
recency BB_MONTHS_BALANCE=MONTHS_BALANCE min
delinquency BB_STATUS=STATUS_SEVERITY mean max
delinquency BB_DPD_MONTH=IS_DPD sum
counts BB_OBSERVED_MONTH=IS_OBSERVED sum
""")
BUREAU = specs("""
recency DAYS_CREDIT max min mean
recency DAYS_CREDIT_ENDDATE max min
delinquency CREDIT_DAY_OVERDUE max mean
amounts AMT_CREDIT_SUM sum_observed mean max
amounts AMT_CREDIT_SUM_DEBT sum_observed mean max
amounts AMT_CREDIT_SUM_OVERDUE sum_observed max
amounts AMT_CREDIT_SUM_LIMIT sum_observed
amounts AMT_CREDIT_MAX_OVERDUE max mean
amounts AMT_ANNUITY sum_observed mean
counts CNT_CREDIT_PROLONG sum
amounts DEBT_CREDIT_RATIO mean max min
amounts OVERDUE_CREDIT_RATIO mean max
counts ACTIVE=IS_ACTIVE sum
counts CLOSED=IS_CLOSED sum
delinquency HAS_OVERDUE sum mean
counts LOAN=SK_ID_BUREAU count
counts BB_MONTHS_TOTAL=BB_MONTHS_COUNT sum
delinquency BB_STATUS_MEAN mean max
delinquency BB_STATUS_WORST=BB_STATUS_MAX max
recency BB_MONTHS_BALANCE_MIN min
delinquency BB_DPD_MONTH_TOTAL=BB_DPD_MONTH_SUM sum
delinquency BB_DPD_MONTH_SHARE mean max
delinquency BB_LONGEST_DPD_STREAK max mean
delinquency BB_DPD_EPISODES max sum
delinquency BB_RECENT_STATUS_MEAN mean max
delinquency BB_RECENT_DPD_TOTAL=BB_RECENT_DPD_SUM sum
""", "BUREAU_")
ACTIVE = specs("""
amounts ACTIVE_DEBT=AMT_CREDIT_SUM_DEBT sum_observed
amounts ACTIVE_CREDIT=AMT_CREDIT_SUM sum_observed
amounts ACTIVE_LIMIT=AMT_CREDIT_SUM_LIMIT sum_observed
counts ACTIVE_LOAN=SK_ID_BUREAU count
""", "BUREAU_")
PREVIOUS = specs("""
counts APPLICATION=SK_ID_PREV count
counts APPROVED=IS_APPROVED sum mean
counts REFUSED=IS_REFUSED sum mean
counts CANCELLED=IS_CANCELLED sum mean
amounts AMT_CREDIT sum_observed mean max
amounts AMT_APPLICATION mean max
amounts AMT_ANNUITY mean max
amounts AMT_DIFF_APPLICATION_CREDIT mean max min
amounts DOWN_PAYMENT_RATIO mean max
amounts RATE_DOWN_PAYMENT mean max
amounts LOAN_TO_PRICE mean max
recency DAYS_DECISION max min mean
counts CNT_PAYMENT mean max
""", "PREV_")
APPROVED = specs("""
amounts HIST_CREDIT=AMT_CREDIT max mean
amounts HIST_ANNUITY=AMT_ANNUITY max
""", "PREV_")
INSTALMENT_LOAN = specs("""
counts INST=NUM_INSTALMENT_NUMBER count
delinquency DPD mean max sum
delinquency LATE=IS_LATE sum
amounts PAYMENT_RATIO mean min
amounts UNDERPAYMENT sum_observed max
amounts UNDERPAID=IS_UNDERPAID sum
delinquency DPD_GE_7 sum
delinquency DPD_GE_30 sum
delinquency DPD_GE_60 sum
delinquency DPD_GE_90 sum
""")
INSTALMENT_CLIENT = specs("""
counts INST_LOAN=SK_ID_PREV count
counts INST_COUNT sum mean max
delinquency DPD_MEAN mean max
delinquency DPD_WORST=DPD_MAX max mean
delinquency DPD_TOTAL=DPD_SUM sum
delinquency LATE=LATE_SUM sum max
delinquency LATE_RATE mean max
amounts PAYMENT_RATIO_MEAN mean min
amounts PAYMENT_RATIO_WORST=PAYMENT_RATIO_MIN min
amounts UNDERPAYMENT=UNDERPAYMENT_SUM sum_observed max
amounts UNDERPAID=UNDERPAID_SUM sum
amounts UNDERPAID_RATE mean max
delinquency LONGEST_LATE_STREAK max mean
delinquency LATE_EPISODES max sum
delinquency DPD_GE_7=DPD_GE_7_SUM sum
delinquency DPD_GE_30=DPD_GE_30_SUM sum
delinquency DPD_GE_60=DPD_GE_60_SUM sum
delinquency DPD_GE_90=DPD_GE_90_SUM sum
""", "INST_")
LIFETIME = specs("""
delinquency INST_DPD_LIFETIME=DPD mean
amounts INST_PAYMENT_RATIO_LIFETIME=PAYMENT_RATIO mean
delinquency INST_LATE_LIFETIME=IS_LATE sum
counts INST_COUNT_LIFETIME=NUM_INSTALMENT_NUMBER count
""")
CARD = specs("""
counts CC_MONTHS=MONTHS_BALANCE count
amounts UTILIZATION mean max min last
amounts CC_HIGH_UTIL_MONTH=IS_HIGH_UTILIZATION sum
amounts PAYMENT_RATIO mean min
delinquency SK_DPD mean max sum
delinquency SK_DPD_DEF mean max
delinquency CC_DPD_MONTH=IS_DPD sum
amounts AMT_BALANCE mean max last
amounts AMT_CREDIT_LIMIT_ACTUAL mean max last
amounts AMT_DRAWINGS_CURRENT mean sum_observed
counts CC_DRAWING_MONTH=HAS_DRAWING sum
counts CC_ACTIVE=IS_ACTIVE last
""")
CARD_CLIENT = specs("""
counts CC_CARD=SK_ID_PREV count
counts CC_MONTHS_COUNT sum mean
amounts UTILIZATION_MEAN mean max
amounts UTILIZATION_WORST=UTILIZATION_MAX max
amounts UTILIZATION_LAST mean max
amounts CC_HIGH_UTIL_MONTH=CC_HIGH_UTIL_MONTH_SUM sum max
amounts CC_HIGH_UTIL_RATE mean max
amounts PAYMENT_RATIO_MEAN mean min
delinquency SK_DPD_MEAN mean max
delinquency SK_DPD_WORST=SK_DPD_MAX max
delinquency SK_DPD_DEF_WORST=SK_DPD_DEF_MAX max
delinquency CC_DPD_MONTH=CC_DPD_MONTH_SUM sum max
delinquency CC_DPD_RATE mean max
amounts AMT_BALANCE_MEAN mean max
amounts AMT_CREDIT_LIMIT_ACTUAL_MAX max sum_observed
amounts AMT_DRAWINGS_CURRENT_SUM sum_observed
amounts CC_UTIL_TREND_SLOPE mean max
counts CC_ACTIVE_CARD=CC_ACTIVE_LAST sum
""", "CC_")
CARD_RECENT = specs("""
amounts CC_RECENT_UTILIZATION=UTILIZATION mean max
delinquency CC_RECENT_DPD=SK_DPD max
""", "CC_")
POS = specs("""
counts POS_MONTHS=MONTHS_BALANCE count
recency POS_LAST_MONTH=MONTHS_BALANCE max
delinquency SK_DPD mean max sum
delinquency SK_DPD_DEF mean max sum
delinquency POS_DPD_MONTH=IS_DPD sum
counts CNT_INSTALMENT max
counts CNT_INSTALMENT_FUTURE min
counts COMPLETION_RATIO max
counts POS_COMPLETED=IS_COMPLETED max
""")
POS_CLIENT = specs("""
counts POS_CONTRACT=SK_ID_PREV count
counts POS_MONTHS_COUNT sum mean max
recency POS_LAST_MONTH=POS_LAST_MONTH_MAX max
delinquency SK_DPD_MEAN mean max
delinquency SK_DPD_WORST=SK_DPD_MAX max
delinquency SK_DPD_TOTAL=SK_DPD_SUM sum
delinquency SK_DPD_DEF_MEAN mean max
delinquency SK_DPD_DEF_WORST=SK_DPD_DEF_MAX max
delinquency POS_DPD_MONTH=POS_DPD_MONTH_SUM sum max
delinquency POS_DPD_RATE mean max
delinquency POS_LONGEST_DPD_STREAK max mean
delinquency POS_DPD_EPISODES max sum
counts CNT_INSTALMENT_MAX mean max
counts CNT_INSTALMENT_FUTURE_MIN mean min
counts COMPLETION_RATIO_MAX mean min
counts POS_COMPLETED=POS_COMPLETED_MAX sum
""", "POS_")
POS_RECENT = specs("""
delinquency POS_RECENT_DPD=SK_DPD max mean
delinquency POS_RECENT_DPD_MONTH=IS_DPD sum
""", "POS_")
CREDIT_TYPES = ["Consumer credit", "Credit card", "Car loan", "Mortgage", "Microloan"]
CONTRACT_TYPES = ["Cash loans", "Consumer loans", "Revolving loans", "XNA"]
YIELD_GROUPS = ["low_action", "low_normal", "middle", "high", "XNA"]
TRAILING, SEQUENCES, TREND, RECENT_MONTHS = (60, 90, 180, 365), (1, 3, 5), 20, -6


def severity(status: Column) -> Column:
    """C and 0 are 0, 1 to 5 themselves, anything else unknown."""
    return F.when(status == "C", 0).when(status.isin(*"012345"), status.try_cast("int"))


def _where(aggs: list[Agg], predicate: Column) -> list[Column]:
    return [a.over(where=predicate) for a in aggs]


def _if_any(aggs: list[Agg], predicate: Column) -> list[Column]:
    """As if aggregated over the rows alone and joined back: without such rows all are NULL, sums too."""
    any_row = F.max(F.when(predicate, True))
    return [F.when(any_row, a.over(where=predicate)).alias(a.name) for a in aggs]


def bureau_balance(balance: DataFrame) -> DataFrame:
    """One row per loan: months, status, recent months, streaks and share of months past due."""
    rows = clean(balance).where(F.col(LOAN).isNotNull()).withColumn("STATUS_SEVERITY", severity(F.col("STATUS")))
    rows = rows.withColumns({"IS_OBSERVED": flag(F.col("STATUS_SEVERITY").isNotNull()), "IS_DPD": flag(F.col("STATUS_SEVERITY") > 0)})
    recent = F.col("MONTHS_BALANCE") >= RECENT_MONTHS
    some = _if_any(specs("delinquency BB_RECENT_STATUS=STATUS_SEVERITY mean\ndelinquency BB_RECENT_DPD=IS_DPD sum"), recent)
    out = aggregate(rows, [LOAN], BALANCE, more=some)
    runs = streaks(rows, [LOAN], ["MONTHS_BALANCE"], "IS_DPD", "BB_LONGEST_DPD_STREAK", "BB_DPD_EPISODES")
    return out.join(runs, LOAN, "left").withColumn("BB_DPD_MONTH_SHARE", safe_divide(F.col("BB_DPD_MONTH_SUM"), F.col("BB_OBSERVED_MONTH_SUM")))


EMPTY_BALANCE = "SK_ID_BUREAU long, BB_MONTHS_COUNT long, BB_MONTHS_BALANCE_MIN long, BB_STATUS_MEAN double, BB_STATUS_MAX int, BB_DPD_MONTH_SUM long, BB_OBSERVED_MONTH_SUM long, BB_RECENT_STATUS_MEAN double, BB_RECENT_DPD_SUM long, BB_LONGEST_DPD_STREAK int, BB_DPD_EPISODES int, BB_DPD_MONTH_SHARE float"


def bureau(loans: DataFrame, balance: DataFrame | None = None) -> DataFrame:
    """61 features per client from loans elsewhere and, if given, their monthly balances."""
    months = bureau_balance(balance) if balance is not None else loans.sparkSession.createDataFrame([], EMPTY_BALANCE)
    rows = clean(loans).where(F.col(CLIENT).isNotNull())
    status = F.col("CREDIT_ACTIVE")
    rows = rows.withColumns(
        {
            "IS_ACTIVE": flag(status == "Active"),
            "IS_CLOSED": flag(status == "Closed"),
            "HAS_OVERDUE": flag(F.col("CREDIT_DAY_OVERDUE") > 0),
            "DEBT_CREDIT_RATIO": safe_divide(F.col("AMT_CREDIT_SUM_DEBT"), F.col("AMT_CREDIT_SUM")),
            "OVERDUE_CREDIT_RATIO": safe_divide(F.col("AMT_CREDIT_SUM_OVERDUE"), F.col("AMT_CREDIT_SUM")),
        }
    )
    rows = rows.join(months, LOAN, "left")
    with_dpd = F.count(F.when(F.col("BB_DPD_MONTH_SUM") > 0, 1)).alias("BUREAU_LOANS_WITH_DPD_COUNT")
    active = _if_any(ACTIVE[:3], status == "Active") + _where(ACTIVE[3:], status == "Active")
    out = aggregate(rows, [CLIENT], BUREAU, more=[*active, *one_hot("CREDIT_TYPE", CREDIT_TYPES, "BUREAU_CTYPE"), with_dpd])
    out = fill_counts(out, ["BUREAU_ACTIVE_LOAN_COUNT", "BUREAU_LOANS_WITH_DPD_COUNT"])
    ratio = lambda a, b: safe_divide(F.col(f"BUREAU_{a}"), F.col(f"BUREAU_{b}"))
    return out.withColumns(
        {
            "BUREAU_ACTIVE_LOAN_RATIO": ratio("ACTIVE_LOAN_COUNT", "LOAN_COUNT"),
            "BUREAU_ACTIVE_UTILIZATION": ratio("ACTIVE_DEBT_SUM", "ACTIVE_CREDIT_SUM"),
            "BUREAU_DEBT_CREDIT_RATIO_TOTAL": ratio("AMT_CREDIT_SUM_DEBT_SUM", "AMT_CREDIT_SUM_SUM"),
            "BUREAU_OVERDUE_DEBT_RATIO_TOTAL": ratio("AMT_CREDIT_SUM_OVERDUE_SUM", "AMT_CREDIT_SUM_DEBT_SUM"),
        }
    )


def previous_application(rows: DataFrame) -> DataFrame:
    """45 features per client from earlier applications."""
    status = F.col("NAME_CONTRACT_STATUS")
    rows = clean(rows).where(F.col(CLIENT).isNotNull())
    rows = rows.withColumns(
        {
            "IS_APPROVED": flag(status == "Approved"),
            "IS_REFUSED": flag(status == "Refused"),
            "IS_CANCELLED": flag(status == "Canceled"),
            "AMT_DIFF_APPLICATION_CREDIT": float_difference(F.col("AMT_APPLICATION"), F.col("AMT_CREDIT")),
            "DOWN_PAYMENT_RATIO": safe_divide(F.col("AMT_DOWN_PAYMENT"), F.col("AMT_GOODS_PRICE")),
            "LOAN_TO_PRICE": safe_divide(F.col("AMT_CREDIT"), F.col("AMT_GOODS_PRICE")),
        }
    )
    refused = F.count(F.when((status == "Refused") & (F.col("DAYS_DECISION") >= -365), 1)).cast("int").alias("PREV_RECENT_REFUSAL_COUNT")
    more = [*_where(APPROVED, status == "Approved"), refused, *one_hot("NAME_CONTRACT_TYPE", CONTRACT_TYPES, "PREV_CONTRACT"), *one_hot("NAME_YIELD_GROUP", YIELD_GROUPS, "PREV_YIELD")]
    out = aggregate(rows, [CLIENT], PREVIOUS, more=more)
    five = newest(rows.select(CLIENT, CONTRACT, "DAYS_DECISION", "AMT_APPLICATION"), [CLIENT], [F.desc("DAYS_DECISION"), F.desc(CONTRACT), F.desc("AMT_APPLICATION")], 5)
    trend = slopes(five, [CLIENT], [F.desc("_rank")], {"AMT_APPLICATION": "PREV_AMT_APPLICATION_TREND"})
    return out.join(trend, CLIENT, "left").withColumn("PREV_HAS_RECENT_REFUSAL", flag(F.col("PREV_RECENT_REFUSAL_COUNT") > 0))


def installments(rows: DataFrame) -> DataFrame:
    """86 features per client from instalments due and paid: loan level, trailing windows, last payments, trends."""
    due, paid = F.col("DAYS_INSTALMENT"), F.col("DAYS_ENTRY_PAYMENT")
    rows = clean(rows).where(F.col(CLIENT).isNotNull())
    rows = rows.withColumns({"DPD": at_least_zero((paid - due).cast("double")), "PAYMENT_RATIO": safe_divide(F.col("AMT_PAYMENT"), F.col("AMT_INSTALMENT")), "UNDERPAYMENT": at_least_zero((F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT")).cast("double"))})
    rows = rows.withColumns({"IS_LATE": flag(F.col("DPD") > 0), "IS_UNDERPAID": flag(F.col("UNDERPAYMENT") > 0), **{f"DPD_GE_{d}": flag(F.col("DPD") >= d) for d in (7, 30, 60, 90)}})
    loan = aggregate(rows, [CLIENT, CONTRACT], INSTALMENT_LOAN)
    runs = streaks(rows.where(F.col(CONTRACT).isNotNull()), [CONTRACT], ["NUM_INSTALMENT_NUMBER", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_PAYMENT"], "IS_LATE", "LONGEST_LATE_STREAK", "LATE_EPISODES")
    loan = loan.join(runs, CONTRACT, "left").withColumns({"LATE_RATE": safe_divide(F.col("LATE_SUM"), F.col("INST_COUNT")), "UNDERPAID_RATE": safe_divide(F.col("UNDERPAID_SUM"), F.col("INST_COUNT"))})
    client = aggregate(loan, [CLIENT], INSTALMENT_CLIENT, more=[F.count(F.when(F.col("LATE_SUM") > 0, 1)).cast("int").alias("INST_LOANS_WITH_LATE_COUNT")])

    windows: list[Column] = []
    for w in TRAILING:
        windows += _if_any(specs(f"delinquency DPD_{w}D=DPD mean max\ndelinquency LATE_{w}D=IS_LATE sum\namounts PAYMENT_RATIO_{w}D=PAYMENT_RATIO mean\namounts UNDERPAYMENT_{w}D=UNDERPAYMENT sum_observed\ncounts {w}D=NUM_INSTALMENT_NUMBER count", "INST_"), due >= -w)
    ordered = newest(rows, [CLIENT], [F.desc("DAYS_INSTALMENT"), F.desc("NUM_INSTALMENT_NUMBER"), F.desc(CONTRACT), F.desc("DAYS_ENTRY_PAYMENT"), F.desc("AMT_PAYMENT")], 2_147_483_647)
    last: list[Column] = []
    for n in SEQUENCES:
        last += _if_any(specs(f"delinquency LAST{n}_DPD=DPD mean max\namounts LAST{n}_PAYMENT_RATIO=PAYMENT_RATIO mean\ndelinquency LAST{n}_LATE=IS_LATE sum", "INST_"), F.col("_rank") <= n)
    since = (-F.max(F.when(F.col("IS_LATE") == 1, due))).alias("INST_DAYS_SINCE_LAST_LATE")
    flat = aggregate(ordered, [CLIENT], LIFETIME, more=[*windows, *last, since])
    trend = slopes(ordered.where(F.col("_rank") <= TREND), [CLIENT], [F.desc("_rank")], {"DPD": "INST_DPD_TREND_SLOPE", "PAYMENT_RATIO": "INST_PAYMENT_RATIO_TREND_SLOPE"})
    out = client.join(flat, CLIENT, "left").join(trend, CLIENT, "left")
    out = out.withColumn("INST_LATE_RATE_LIFETIME", safe_divide(F.col("INST_LATE_LIFETIME_SUM"), F.col("INST_COUNT_LIFETIME_COUNT")))
    for w in TRAILING:
        out = out.withColumn(f"INST_LATE_RATE_{w}D", safe_divide(F.col(f"INST_LATE_{w}D_SUM"), F.col(f"INST_{w}D_COUNT")))
        out = out.withColumn(f"INST_DPD_RECENT_MINUS_LIFE_{w}D", float_difference(F.col(f"INST_DPD_{w}D_MEAN"), F.col("INST_DPD_LIFETIME_MEAN")))
        out = out.withColumn(f"INST_LATE_RATE_RECENT_MINUS_LIFE_{w}D", float_difference(F.col(f"INST_LATE_RATE_{w}D"), F.col("INST_LATE_RATE_LIFETIME")))
    return out


def credit_card(rows: DataFrame) -> DataFrame:
    """36 features per client from monthly card balances."""
    rows = clean(rows).where(F.col(CLIENT).isNotNull())
    rows = rows.withColumns({"UTILIZATION": safe_divide(F.col("AMT_BALANCE"), F.col("AMT_CREDIT_LIMIT_ACTUAL")), "PAYMENT_RATIO": safe_divide(F.col("AMT_PAYMENT_TOTAL_CURRENT"), F.col("AMT_INST_MIN_REGULARITY"))})
    rows = rows.withColumns({"IS_HIGH_UTILIZATION": flag(F.col("UTILIZATION") > 0.9), "IS_DPD": flag(F.col("SK_DPD") > 0), "IS_ACTIVE": flag(F.col("NAME_CONTRACT_STATUS") == "Active"), "HAS_DRAWING": flag(F.col("AMT_DRAWINGS_CURRENT") > 0)})
    card = aggregate(rows, [CLIENT, CONTRACT], CARD, order=F.col("MONTHS_BALANCE"))
    trend = slopes(rows.where(F.col(CONTRACT).isNotNull()), [CONTRACT], [F.col("MONTHS_BALANCE"), F.col("AMT_BALANCE")], {"UTILIZATION": "CC_UTIL_TREND_SLOPE"})
    card = card.join(trend, CONTRACT, "left").withColumns({"CC_HIGH_UTIL_RATE": safe_divide(F.col("CC_HIGH_UTIL_MONTH_SUM"), F.col("CC_MONTHS_COUNT")), "CC_DPD_RATE": safe_divide(F.col("CC_DPD_MONTH_SUM"), F.col("CC_MONTHS_COUNT"))})
    portfolio = [F.sum("AMT_BALANCE_LAST").alias("CC_PORTFOLIO_BALANCE"), F.sum("AMT_CREDIT_LIMIT_ACTUAL_LAST").alias("CC_PORTFOLIO_LIMIT")]
    out = aggregate(card, [CLIENT], CARD_CLIENT, more=portfolio)
    out = out.withColumn("CC_PORTFOLIO_UTILIZATION", safe_divide(F.col("CC_PORTFOLIO_BALANCE"), F.col("CC_PORTFOLIO_LIMIT")))
    recent = rows.where(F.col("MONTHS_BALANCE") >= RECENT_MONTHS)
    return fill_counts(out.join(aggregate(recent, [CLIENT], CARD_RECENT), CLIENT, "left"), ["CC_CC_ACTIVE_CARD_SUM"])


def pos_cash(rows: DataFrame) -> DataFrame:
    """33 features per client from monthly point-of-sale and cash loan balances."""
    rows = clean(rows).where(F.col(CLIENT).isNotNull())
    paid = safe_divide(F.col("CNT_INSTALMENT") - F.col("CNT_INSTALMENT_FUTURE"), F.col("CNT_INSTALMENT"))
    rows = rows.withColumns({"IS_DPD": flag(F.col("SK_DPD") > 0), "IS_COMPLETED": flag(F.col("NAME_CONTRACT_STATUS") == "Completed"), "COMPLETION_RATIO": paid})
    contract = aggregate(rows, [CLIENT, CONTRACT], POS)
    runs = streaks(rows.where(F.col(CONTRACT).isNotNull()), [CONTRACT], ["MONTHS_BALANCE", "SK_DPD"], "IS_DPD", "POS_LONGEST_DPD_STREAK", "POS_DPD_EPISODES")
    contract = contract.join(runs, CONTRACT, "left").withColumn("POS_DPD_RATE", safe_divide(F.col("POS_DPD_MONTH_SUM"), F.col("POS_MONTHS_COUNT")))
    out = aggregate(contract, [CLIENT], POS_CLIENT, more=[F.count(F.when(F.col("POS_DPD_MONTH_SUM") > 0, 1)).cast("int").alias("POS_CONTRACTS_WITH_DPD_COUNT")])
    recent = rows.where(F.col("MONTHS_BALANCE") >= RECENT_MONTHS)
    out = out.join(aggregate(recent, [CLIENT], POS_RECENT), CLIENT, "left")
    return out.withColumns({"POS_COMPLETION_RATE": safe_divide(F.col("POS_POS_COMPLETED_SUM"), F.col("POS_POS_CONTRACT_COUNT")), "POS_DPD_CONTRACT_RATIO": safe_divide(F.col("POS_CONTRACTS_WITH_DPD_COUNT"), F.col("POS_POS_CONTRACT_COUNT"))})


def mart_families() -> dict[str, dict[str, list[str]]]:
    return {"bureau": families(BUREAU + ACTIVE), "previous_application": families(PREVIOUS + APPROVED), "installments": families(INSTALMENT_CLIENT + LIFETIME), "credit_card": families(CARD_CLIENT + CARD_RECENT), "pos_cash": families(POS_CLIENT + POS_RECENT)}


def bureau_history(loans: DataFrame, balance: DataFrame, groups: tuple[str, ...] = ("counts", "amounts", "recency", "delinquency")) -> DataFrame:
    """The second bureau set, 36 features in four groups: here only statuses 0 to 5 are observed.

    The balance must have one row per loan and month. History counts are 0 for loans without history; shares and
    amounts stay missing.
    """
    status, month = F.col("STATUS"), F.col("MONTHS_BALANCE")
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    dpd = status.isin(*"12345")
    months = balance.where(F.col(LOAN).isNotNull()).groupBy(LOAN).agg(
        F.count("*").alias("M_TOTAL"), count(status.isin(*"012345"), "M_OBSERVED"), count(status == "0", "M_0"), count(status == "C", "M_C"), count(dpd, "M_ANY"), count(status.isin(*"345"), "M_SEVERE"), count(status == "X", "M_X"),
        F.min(month).alias("M_MIN"), F.max(month).alias("M_MAX"), (-F.max(F.when(dpd, month))).alias("M_SINCE"),
    )
    rows = clean(loans).where(F.col(CLIENT).isNotNull()).join(months, LOAN, "left")
    rows = fill_counts(rows.withColumn("HAS_HISTORY", flag(F.col("M_TOTAL").isNotNull())), ["M_TOTAL", "M_OBSERVED", "M_0", "M_C", "M_ANY", "M_SEVERE", "M_X"], "long")
    active, closed = F.col("CREDIT_ACTIVE") == "Active", F.col("CREDIT_ACTIVE") == "Closed"
    x = F.col
    share = lambda a, b: safe_divide(F.sum(a), F.sum(b))
    made: dict[str, dict[str, Column]] = {
        "counts": {
            "LOAN_COUNT": F.count("*"), "ACTIVE_COUNT": F.sum(active.cast("int")), "SOLD_COUNT": F.sum((x("CREDIT_ACTIVE") == "Sold").cast("int")), "CREDIT_TYPE_NUNIQUE": F.count_distinct("CREDIT_TYPE"),
            "CREDIT_PROLONG_SUM": F.coalesce(F.sum("CNT_CREDIT_PROLONG"), F.lit(0)), "ACTIVE_LOAN_RATIO": safe_divide(F.sum(active.cast("int")), F.count("*")), "BB_COVERAGE_RATIO": safe_divide(F.sum("HAS_HISTORY"), F.count("*")),
        },
        "amounts": {
            "CREDIT_SUM": F.sum("AMT_CREDIT_SUM"), "CREDIT_MAX": F.max("AMT_CREDIT_SUM"), "DEBT_SUM": F.sum("AMT_CREDIT_SUM_DEBT"), "DEBT_MEAN": F.avg("AMT_CREDIT_SUM_DEBT"), "DEBT_MAX": F.max("AMT_CREDIT_SUM_DEBT"),
            "ACTIVE_CREDIT_SUM": F.sum(F.when(active, x("AMT_CREDIT_SUM"))), "ACTIVE_DEBT_SUM": F.sum(F.when(active, x("AMT_CREDIT_SUM_DEBT"))), "OVERDUE_SUM": F.sum("AMT_CREDIT_SUM_OVERDUE"), "LIMIT_SUM": F.sum("AMT_CREDIT_SUM_LIMIT"), "ANNUITY_SUM": F.sum("AMT_ANNUITY"),
            "DEBT_CREDIT_RATIO": share("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM"), "OVERDUE_DEBT_RATIO": share("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM_DEBT"),
        },
        "recency": {
            "DAYS_CREDIT_MAX": F.max("DAYS_CREDIT"), "DAYS_CREDIT_MIN": F.min("DAYS_CREDIT"), "DAYS_CREDIT_MEAN": F.avg("DAYS_CREDIT"), "ACTIVE_ENDDATE_MAX": F.max(F.when(active, x("DAYS_CREDIT_ENDDATE"))),
            "CLOSED_ENDDATE_FACT_MAX": F.max(F.when(closed, x("DAYS_ENDDATE_FACT"))), "CLOSED_ENDDATE_DELAY_MEAN": F.avg(F.when(closed, x("DAYS_ENDDATE_FACT") - x("DAYS_CREDIT_ENDDATE"))),
            "BB_MONTHS_BALANCE_MIN": F.min("M_MIN"), "BB_MONTHS_BALANCE_MAX": F.max("M_MAX"), "BB_MONTHS_SINCE_LAST_DPD": F.min("M_SINCE"),
        },
        "delinquency": {
            "CREDIT_DAY_OVERDUE_MAX": F.max("CREDIT_DAY_OVERDUE"), "BB_MONTH_COUNT": F.sum("M_TOTAL"), "BB_STATUS_0_TOTAL_RATIO": share("M_0", "M_TOTAL"), "BB_STATUS_C_TOTAL_RATIO": share("M_C", "M_TOTAL"),
            "BB_ANY_DPD_TOTAL_RATIO": share("M_ANY", "M_TOTAL"), "BB_SEVERE_DPD_TOTAL_RATIO": share("M_SEVERE", "M_TOTAL"), "BB_ANY_DPD_OBSERVED_RATIO": share("M_ANY", "M_OBSERVED"), "BB_SEVERE_DPD_OBSERVED_RATIO": share("M_SEVERE", "M_OBSERVED"),
        },
    }
    unknown = set(groups) - set(made)
    if unknown:
        raise ValueError(f"unknown groups: {sorted(unknown)}")
    return rows.groupBy(CLIENT).agg(*[c.alias(safe_name(f"BUREAU_{n}")) for g in made if g in groups for n, c in made[g].items()])
