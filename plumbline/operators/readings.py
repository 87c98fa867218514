"""Readings of road detectors: which rows are readings, and when.

A detector is the pair (city, detid). A reading is a row whose city, detid, day and interval are present
(interval finite). Its instant is day plus interval seconds, put on its calendar day: an interval past the end of
the day moves to the next one, a negative one to the day before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import has_number, has_word, number_or_null

KEY = ("city", "detid")
DAY_S = 86400


def is_reading() -> Column:
    return F.col("city").isNotNull() & F.col("day").isNotNull() & has_number(F.col("interval"), ()) & has_word(F.col("detid"))


def readings(raw: DataFrame, *values: str) -> DataFrame:
    """(city, detid, day_no, sec, <values>, loaded_at, obs_id): day_no counts days since 1970-01-01, sec the seconds of that day.

    A value without a usable number is null. Columns beyond those needed are left out, whatever their names.
    """
    over = F.floor(F.col("interval") / DAY_S)
    return raw.where(is_reading()).select(
        "city",
        "detid",
        (F.unix_date(F.col("day").cast("date")) + over).cast("int").alias("day_no"),
        (F.col("interval") - over * DAY_S).alias("sec"),
        *(number_or_null(F.col(v)).alias(v) for v in values),
        "loaded_at",
        "obs_id",
    )


def latest(rows: DataFrame, values: tuple[str, ...], *instant: str) -> DataFrame:
    """One row for each instant of a detector, with the values sent last (ties: greatest obs_id).

    A grouping, not a row_number: where the values aren't asked for, Catalyst drops them and the order with them.
    """
    sent = F.max(F.struct("loaded_at", "obs_id", *values))
    return rows.groupBy(*instant).agg(sent.alias("sent")).select(*instant, *(F.col(f"sent.{v}").alias(v) for v in values))


def spans(rows: DataFrame) -> DataFrame:
    """(city, detid, first_s, last_s): the first and last whole second with a reading, counted from 1970-01-01.

    Combined before the shuffle, so a detector with most of the rows costs one row a task.
    """
    s = F.col("day_no").cast("long") * DAY_S + F.floor("sec")
    return rows.groupBy(*KEY).agg(F.min(s).alias("first_s"), F.max(s).alias("last_s"))


def day_key(day_no: str | Column) -> Column:
    d = F.date_from_unix_date(day_no)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")
