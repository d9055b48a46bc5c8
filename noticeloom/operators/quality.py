"""Completeness of documents' events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_processed(event_id: Column) -> Column:
    return event_id.isNotNull()


def is_edited(user_event: Column) -> Column:
    """Whether a user's struct holds anything."""
    return user_event.isNotNull() & (F.to_json(user_event) != "{}")


def flags(df: DataFrame, title: Column, address: Column, times: Column) -> DataFrame:
    """df with has_title, has_address and has_times; times is an array."""
    given = lambda c: F.coalesce(c.isNotNull() & (c.cast("string") != ""), F.lit(False))
    return df.withColumns({"has_title": given(title), "has_address": given(address), "has_times": F.coalesce(F.size(times) > 0, F.lit(False))})


def thirds(df: DataFrame) -> DataFrame:
    """df with thirds, how many of title, address and times an event has, and quality, that number over 3."""
    n = F.col("has_title").cast("int") + F.col("has_address").cast("int") + F.col("has_times").cast("int")
    return df.withColumn("thirds", n).withColumn("quality", F.col("thirds") / 3)


def counts(df: DataFrame) -> DataFrame:
    """One row: documents, and those with a title, an address and times."""
    return df.agg(F.count("*").alias("documents"), F.count_if("has_title").alias("titles"), F.count_if("has_address").alias("addresses"), F.count_if("has_times").alias("dates"))
