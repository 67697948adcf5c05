"""The streaming operators over the events table, read as a table."""

from pyspark.sql import functions as F

from riskloom.plans.registry import query, table
from riskloom.streaming.trailing import last_per_user, windowed_totals


@query("windowed_totals", "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_totals(spark, d):
    return windowed_totals(table(spark, d, "events")).withColumns({"start": F.date_format("start", "yyyy-MM-dd"), "total": F.round("total", 4)})


@query("last_per_user", "SELECT user_id, count(*) AS events, round(max_by(value, ts), 6) AS last_value FROM events GROUP BY user_id")
def last_values(spark, d):
    return last_per_user(table(spark, d, "events")).withColumn("last_value", F.round("last_value", 6))
