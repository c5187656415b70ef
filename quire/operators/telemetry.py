"""Totals over usage rows whose numbers lie in a JSON column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, keys, total, failed, requests, retry_rate per group.

    rows: key, value, failed (boolean), requests (null counts as one). A rate of no requests is null.
    """
    n, r = F.count("*"), F.sum(F.coalesce("requests", F.lit(1)))
    return rows.groupBy(*by).agg(
        n.alias("rows"), F.count_distinct("key").alias("keys"), F.round(F.sum("value"), 4).alias("total"), F.count_if("failed").alias("failed"), r.alias("requests"),
        F.round(F.greatest(r - n, F.lit(0)) / F.nullif(r, F.lit(0)), 6).alias("retry_rate"),
    )


def message_delta(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, fresh: how many more messages of a signature there are after than before."""
    b = before.groupBy(*key).agg(F.count("*").alias("_b"))
    a = after.groupBy(*key).agg(F.count("*").alias("_a"))
    return a.join(b, key, "full_outer").select(*key, F.greatest(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)), F.lit(0)).alias("fresh")).where("fresh > 0")
