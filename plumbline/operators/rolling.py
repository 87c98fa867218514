"""Rolling totals over trailing calendar periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.readings import DAY_S, KEY, day_key, latest, readings, spans


def rolling_totals(raw: DataFrame, values: tuple[str, ...] = ("flow", "occ"), periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each detector and each calendar day from its first to its last with a reading: trailing totals and averages.

    Columns: city, detid, day_key, n_day (readings of the day), and for each period of p days, that day included, n_{p}d and for each value
    v_sum_{p}d, v_avg_{p}d (mean over usable values; null without one, where the sum is 0).

    Readings are first reduced to daily totals, spread by (city, detid, day). Each calendar day is then range-joined to the daily totals
    within its longest trailing period: both sides carry a coarse bucket of that many days, a calendar day looks
    into its own bucket and the one before, and the exact bounds are a condition of the join.

    Each instant counts once, in its latest version. Rows without city, detid, day or interval are no readings; readings
    without a usable value count in n only. Empty input: empty output.
    """
    longest = max(periods)
    rows = readings(raw, *values)
    daily = (
        latest(rows.repartition(*KEY, "day_no"), values, *KEY, "day_no", "sec")
        .groupBy(*KEY, "day_no")
        .agg(F.count("*").alias("n"), *(f(v).alias(f"{v}_{a}") for v in values for a, f in (("n", F.count), ("s", F.sum))))
        .withColumn("bucket", F.floor(F.col("day_no") / longest).cast("int"))
    )
    own = F.floor(F.col("at_day") / longest).cast("int")
    calendar = (
        spans(rows)
        .withColumn("at_day", F.explode(F.sequence(F.floor(F.col("first_s") / DAY_S).cast("int"), F.floor(F.col("last_s") / DAY_S).cast("int"))))
        .select(*KEY, "at_day", F.explode(F.array(own, own - 1)).alias("bucket"))
    )
    d, c = daily.alias("d"), calendar.alias("c")
    near = [F.col(f"c.{k}") == F.col(f"d.{k}") for k in (*KEY, "bucket")]
    joined = c.join(d, [*near, F.col("d.day_no") <= F.col("c.at_day"), F.col("d.day_no") > F.col("c.at_day") - longest], "left")
    ago = F.col("c.at_day") - F.col("d.day_no")
    total = lambda col, p: F.coalesce(F.sum(F.when(ago < p, F.col(f"d.{col}"))), F.lit(0))
    sums = joined.groupBy(*(F.col(f"c.{k}") for k in KEY), F.col("c.at_day")).agg(
        total("n", 1).alias("n_day"),
        *(total("n", p).alias(f"n_{p}d") for p in periods),
        *(total(f"{v}_{a}", p).alias(f"{v}_{a}_{p}") for v in values for a in "ns" for p in periods),
    )
    return sums.select(
        *KEY,
        day_key("at_day").alias("day_key"),
        "n_day",
        *(f"n_{p}d" for p in periods),
        *(x for v in values for p in periods for x in (F.col(f"{v}_s_{p}").cast("double").alias(f"{v}_sum_{p}d"), F.when(F.col(f"{v}_n_{p}") > 0, F.col(f"{v}_s_{p}") / F.col(f"{v}_n_{p}")).alias(f"{v}_avg_{p}d"))),
    )
