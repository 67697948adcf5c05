"""The marts and application features on hand-checked frames."""

import pytest
from pyspark.sql import functions as F

from riskloom.plans import application as P
from riskloom.plans import marts as M

BUREAU = "SK_ID_CURR long, SK_ID_BUREAU long, CREDIT_ACTIVE string, CREDIT_TYPE string, DAYS_CREDIT int, DAYS_CREDIT_ENDDATE double, DAYS_ENDDATE_FACT double, CREDIT_DAY_OVERDUE int, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM_OVERDUE double, AMT_CREDIT_SUM_LIMIT double, AMT_CREDIT_MAX_OVERDUE double, AMT_ANNUITY double, CNT_CREDIT_PROLONG int"


@pytest.fixture(scope="module")
def loans(spark):
    rows = [
        (1, 10, "Active", "Consumer credit", -100, 200.0, None, 0, 1000.0, 400.0, 0.0, None, None, 50.0, 0),
        (1, 11, "Closed", "Credit card", -500, -100.0, -120.0, 5, 500.0, 100.0, 10.0, 20.0, 30.0, None, 1),
        (2, 12, "Active", "Spaceship", -50, None, None, 0, 0.0, 50.0, 0.0, None, None, None, 0),
        (3, 13, "Sold", None, -900, None, None, 0, 700.0, None, None, None, None, None, 0),
    ]
    return spark.createDataFrame(rows, BUREAU)


@pytest.fixture(scope="module")
def months(spark):
    rows = [(10, -k, s) for k, s in enumerate("0110X", 1)] + [(11, -k, s) for k, s in enumerate("C23X", 1)]
    return spark.createDataFrame(rows, "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")


def by_client(df):
    return {r.SK_ID_CURR: r for r in df.collect()}


def test_balance(months):
    got = {r.SK_ID_BUREAU: r for r in M.bureau_balance(months).collect()}
    ten = got[10]
    assert (ten.BB_MONTHS_COUNT, ten.BB_OBSERVED_MONTH_SUM, ten.BB_DPD_MONTH_SUM, ten.BB_LONGEST_DPD_STREAK, ten.BB_DPD_EPISODES) == (5, 4, 2, 2, 1)
    assert ten.BB_DPD_MONTH_SHARE == 0.5 and got[11].BB_STATUS_MAX == 3


def test_bureau(loans, months):
    df = M.bureau(loans, months)
    got = by_client(df)
    assert len(df.columns) == 62 and len(got) == 3
    assert got[1].BUREAU_AMT_CREDIT_SUM_DEBT_SUM == 500 and got[3].BUREAU_AMT_CREDIT_SUM_DEBT_SUM is None
    assert got[1].BUREAU_ACTIVE_LOAN_RATIO == 0.5 and got[3].BUREAU_ACTIVE_LOAN_COUNT == 0 and got[3].BUREAU_ACTIVE_DEBT_SUM is None
    assert got[2].BUREAU_CTYPE_OTHER_COUNT == 1 and got[2].BUREAU_ACTIVE_UTILIZATION is None
    assert got[1].BUREAU_LOANS_WITH_DPD_COUNT == 2 and got[3].BUREAU_BB_MONTHS_TOTAL_SUM == 0
    without = M.bureau(loans)
    assert without.columns == df.columns and by_client(without)[1].BUREAU_BB_MONTHS_TOTAL_SUM == 0


def test_bureau_history(spark):
    rows = [(1, 101, "Active", "a", -10, 5.0, None, 0, 0.0, 10.0, 0.0, -3.0, None, None, 0), (1, 102, "Closed", "b", -20, -5.0, -4.0, 0, None, None, None, None, None, None, 0)]
    months = spark.createDataFrame([(101, -1, "0"), (101, -2, "1"), (102, -1, "C")], "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")
    got = M.bureau_history(spark.createDataFrame(rows, BUREAU), months)
    row = got.first()
    assert len(got.columns) == 37
    assert row.BUREAU_ANNUITY_SUM is None and row.BUREAU_DEBT_CREDIT_RATIO is None and row.BUREAU_LIMIT_SUM == -3 and row.BUREAU_BB_MONTHS_SINCE_LAST_DPD == 2
    assert row.BUREAU_BB_ANY_DPD_TOTAL_RATIO == pytest.approx(1 / 3) and row.BUREAU_BB_ANY_DPD_OBSERVED_RATIO == 0.5


PREVIOUS = "SK_ID_CURR long, SK_ID_PREV long, NAME_CONTRACT_STATUS string, NAME_CONTRACT_TYPE string, NAME_YIELD_GROUP string, AMT_CREDIT double, AMT_APPLICATION double, AMT_ANNUITY double, AMT_DOWN_PAYMENT double, AMT_GOODS_PRICE double, RATE_DOWN_PAYMENT double, DAYS_DECISION int, CNT_PAYMENT double"


def test_previous(spark):
    rows = [
        (1, 1, "Approved", "Cash loans", "high", 100.0, 90.0, 10.0, None, 0.0, None, -400, 12.0),
        (1, 2, "Refused", "Revolving loans", "odd", 200.0, 190.0, 20.0, 5.0, 100.0, 0.1, -50, None),
        (2, 3, "Canceled", None, None, None, None, None, None, None, None, -1000, None),
    ]
    df = M.previous_application(spark.createDataFrame(rows, PREVIOUS))
    got = by_client(df)
    assert len(df.columns) == 46
    assert got[1].PREV_RECENT_REFUSAL_COUNT == 1 and got[1].PREV_HAS_RECENT_REFUSAL == 1 and got[1].PREV_AMT_APPLICATION_TREND == 100
    assert got[1].PREV_LOAN_TO_PRICE_MEAN == 2 and got[1].PREV_HIST_CREDIT_MAX == 100 and got[1].PREV_YIELD_OTHER_COUNT == 1
    assert got[2].PREV_CANCELLED_SUM == 1 and got[2].PREV_HIST_CREDIT_MAX is None and got[2].PREV_AMT_CREDIT_SUM is None and got[2].PREV_RECENT_REFUSAL_COUNT == 0


def test_installments(spark):
    rows = [
        (1, 10, 1, -100.0, -105.0, 100.0, 100.0), (1, 10, 2, -70.0, -60.0, 100.0, 60.0), (1, 10, 3, -40.0, 10.0, 100.0, 100.0), (1, 11, 1, -30.0, -20.0, 50.0, 50.0),
        (2, 12, 1, -400.0, -400.0, 10.0, 10.0), (2, 12, 2, -380.0, None, 10.0, None),
    ]
    df = M.installments(spark.createDataFrame(rows, "SK_ID_CURR long, SK_ID_PREV long, NUM_INSTALMENT_NUMBER int, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double"))
    got = by_client(df)
    assert len(df.columns) == 87
    assert (got[1].INST_DPD_WORST_MAX, got[1].INST_LATE_SUM, got[1].INST_UNDERPAYMENT_SUM) == (50, 3, 40)
    assert (got[2].INST_DPD_WORST_MAX, got[2].INST_LATE_SUM, got[2].INST_UNDERPAYMENT_SUM) == (0, 0, 0)
    assert got[1].INST_LONGEST_LATE_STREAK_MAX == 2 and got[1].INST_DAYS_SINCE_LAST_LATE == 30 and got[2].INST_DAYS_SINCE_LAST_LATE is None
    assert got[1].INST_60D_COUNT == 2 and got[2].INST_60D_COUNT is None and got[2].INST_LATE_365D_SUM is None
    assert got[1].INST_LAST1_DPD_MAX == 10 and got[1].INST_LAST3_LATE_SUM == 3 and got[2].INST_DPD_TREND_SLOPE is None


MONTHS = "SK_ID_CURR long, SK_ID_PREV long, MONTHS_BALANCE int, NAME_CONTRACT_STATUS string, "


def test_credit_card(spark):
    rows = [(1, 10, -2, "Active", 500.0, 1000.0, 10.0, 20.0, 0.0, 0, 0), (1, 10, -1, "Active", 950.0, 1000.0, None, 0.0, 5.0, 3, 0), (2, 11, -9, "Completed", 0.0, 100.0, 1.0, 1.0, None, 0, 0), (2, 11, -8, "Completed", None, None, 1.0, 1.0, None, 0, 0)]
    df = M.credit_card(spark.createDataFrame(rows, MONTHS + "AMT_BALANCE double, AMT_CREDIT_LIMIT_ACTUAL double, AMT_PAYMENT_TOTAL_CURRENT double, AMT_INST_MIN_REGULARITY double, AMT_DRAWINGS_CURRENT double, SK_DPD int, SK_DPD_DEF int"))
    got = by_client(df)
    assert len(df.columns) == 37
    assert got[1].CC_PORTFOLIO_UTILIZATION == pytest.approx(0.95) and got[2].CC_PORTFOLIO_UTILIZATION == 0
    assert got[1].CC_CC_UTIL_TREND_SLOPE_MAX == pytest.approx(0.45) and got[1].CC_CC_ACTIVE_CARD_SUM == 1 and got[2].CC_CC_ACTIVE_CARD_SUM == 0
    assert got[2].CC_CC_RECENT_DPD_MAX is None and got[1].CC_CC_DPD_RATE_MAX == 0.5


def test_pos_cash(spark):
    rows = [(1, 10, -k, "Active", 10.0, 10.0 - k, d, 0) for k, d in zip((4, 3, 2, 1), (0, 5, 9, 0))] + [(1, 11, -1, "Completed", 4.0, 0.0, 0, 0), (2, 12, -9, "Active", None, None, 0, 0)]
    df = M.pos_cash(spark.createDataFrame(rows, MONTHS + "CNT_INSTALMENT double, CNT_INSTALMENT_FUTURE double, SK_DPD int, SK_DPD_DEF int"))
    got = by_client(df)
    assert len(df.columns) == 34
    assert got[1].POS_POS_DPD_MONTH_SUM == 2 and got[1].POS_POS_DPD_RATE_MAX == 0.5 and got[1].POS_CONTRACTS_WITH_DPD_COUNT == 1
    assert got[1].POS_POS_LONGEST_DPD_STREAK_MAX == 2 and got[1].POS_COMPLETION_RATE == 0.5 and got[2].POS_POS_RECENT_DPD_MAX is None


APPLICATION = "SK_ID_CURR long, TARGET int, AMT_CREDIT double, AMT_INCOME_TOTAL double, AMT_ANNUITY double, AMT_GOODS_PRICE double, CNT_FAM_MEMBERS double, CNT_CHILDREN double, OWN_CAR_AGE double, DAYS_BIRTH double, DAYS_EMPLOYED double, DAYS_LAST_PHONE_CHANGE double, EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double, FLAG_DOCUMENT_2 double, FLAG_DOCUMENT_3 double, FLAG_MOBIL double, FLAG_PHONE double, APARTMENTS_AVG double, APARTMENTS_MODE double, APARTMENTS_MEDI double, WALLSMATERIAL_MODE string"
ROWS = [
    (1, 0, 1000.0, 500.0, 100.0, 900.0, 2.0, 1.0, 5.0, -10000.0, -1000.0, -365.25, 0.2, 0.4, None, 1.0, 0.0, 1.0, 1.0, 0.5, 0.4, 0.3, "brick"),
    (2, 1, 1000.0, 0.0, None, 900.0, 0.0, 0.0, None, -12000.0, 365243.0, None, 0.5, None, None, 0.0, None, 1.0, None, None, 0.4, 0.3, None),
    (3, 0, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
]


def test_application_sets(spark):
    df = spark.createDataFrame(ROWS, APPLICATION)
    one = by_client(P.first_set(df))
    assert one[1].CREDIT_INCOME_RATIO == 2 and one[2].CREDIT_INCOME_RATIO is None and one[2].DAYS_EMPLOYED_ANOMALOUS == 1 and one[2].DAYS_EMPLOYED is None
    assert one[1].EXT_SOURCE_STD == pytest.approx(0.1414214) and one[2].EXT_SOURCE_STD is None and one[3].EXT_SOURCE_MISSING_COUNT == 3 and one[1].EXT_SOURCE_PRODUCT == pytest.approx(0.08) and one[2].EXT_SOURCE_PRODUCT is None
    assert one[3].DOCUMENT_FLAG_COUNT == 0 and one[1].HOUSING_AVG_MEAN == 0.5
    second = P.second_set(df)
    two = by_client(second)
    assert two[3].DOCUMENT_COUNT is None and two[1].PHONE_CHANGE_YEARS == 1 and two[1].EXT_SOURCE_COUNT == 2 and two[1].HOUSING_NUMERIC_MODE_MAX == pytest.approx(0.4)
    assert second.columns[: len(P.first_set(df).columns)] == P.first_set(df).columns
    with pytest.raises(ValueError, match="unknown"):
        P.second_set(df, ["nope"])
    with pytest.raises(ValueError, match="missing"):
        P.first_set(df.drop("AMT_CREDIT"))


def test_factorial_adds_what_it_says(spark):
    df = spark.createDataFrame(ROWS, APPLICATION)
    base = len(P.first_set(df).columns)
    for factors, added in {"": 0, "N": 0, "R": 1, "D": 1, "NR": 1, "ND": 1, "RD": 2, "NRD": 2}.items():
        assert len(P.factorial(df, factors).columns) == base + added
    with pytest.raises(ValueError):
        P.factorial(df, "X")
    with pytest.raises(ValueError, match="overwrite"):
        P.factorial(df.withColumn("CREDIT_GOODS_DIFF", F.lit(1)), "D")


def test_alignment(spark):
    train = spark.createDataFrame(ROWS, APPLICATION)
    test = train.drop("TARGET").select(*reversed(train.drop("TARGET").columns))
    a, b = P.aligned(train, test, P.first_set)
    assert [c for c in a.columns if c != "TARGET"] == b.columns
    with pytest.raises(ValueError, match="predictors"):
        P.aligned(train, test.drop("AMT_CREDIT"), P.first_set)
