"""Every output of every mart is described; streams give what tables give."""

import pytest

from riskloom.plans import catalog, credit
from riskloom.plans import marts as M
from riskloom.streaming.trailing import last_per_user, windowed_totals


def built(spark, d):
    return {
        "bureau": M.bureau(credit.loans(spark, d), credit.balances(spark, d)),
        "previous_application": M.previous_application(credit.dressed(spark, d, credit.EARLIER.replace("{days}", credit.SPARK_DAYS), "orders")),
        "installments": M.installments(credit.dressed(spark, d, credit.RENT.replace("{due}", credit.SPARK_DUE), "lineitem", "orders")),
        "credit_card": M.credit_card(credit.dressed(spark, d, credit.MONTHS, "events")),
        "pos_cash": M.pos_cash(credit.dressed(spark, d, credit.MONTHS, "events")),
    }


def test_every_feature_is_described(spark, tiny):
    blocks = {b: df.columns for b, df in built(spark, tiny).items()}
    assert {b: len(c) - 1 for b, c in blocks.items()} == {"bureau": 61, "previous_application": 45, "installments": 86, "credit_card": 36, "pos_cash": 33}
    text = catalog.markdown(blocks)
    assert all(c in text for columns in blocks.values() for c in columns if c != M.CLIENT)
    with pytest.raises(ValueError, match="nothing describes"):
        catalog.describe("bureau", ["SURPRISE"])


@pytest.mark.parametrize(("build", "mode"), [(windowed_totals, "complete"), (last_per_user, "complete")])
def test_streams_give_what_tables_give(spark, tiny, tmp_path, build, mode):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName(f"live_{build.__name__}").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    tidy = lambda df: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()}
    assert tidy(spark.table(f"live_{build.__name__}")) == tidy(build(events)) != set()
