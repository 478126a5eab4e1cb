"""Usage log: append, totals and counts by tool in a time range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since(days: int, anchor: Column) -> Column:
    """Whether ts lies within so many days before the anchor."""
    if days < 0:
        raise ValueError("days must not be negative")
    return F.col("ts") >= anchor - F.make_dt_interval(F.lit(days))


def total(usage: DataFrame, days: int, anchor: Column) -> DataFrame:
    return usage.where(since(days, anchor)).agg(F.count("*").alias("calls"))


def by_tool(usage: DataFrame, days: int, anchor: Column) -> DataFrame:
    return usage.where(since(days, anchor)).groupBy("tool").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool")


def checked(rows: DataFrame) -> DataFrame:
    """Rows to append: counts and durations beyond 32 bits raise an error, nulls stay."""
    most = 2**31 - 1
    narrow = lambda c: F.when(F.col(c).isNull() | F.col(c).between(-most - 1, most), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is out of range"))).cast("int").alias(c)
    return rows.select("id", "ts", "tool", "repo_path", narrow("duration_ms"), narrow("result_count"))


def result_count(payload: Column) -> Column:
    """Results in a tool's JSON answer: the length of its results or symbols array, null where it has neither."""
    size = lambda path: F.json_array_length(F.get_json_object(payload, path))
    return F.coalesce(size("$.results"), size("$.symbols"))
