"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.readings import DAY_S, KEY, day_key, latest, readings

DIVISORS = [d for d in range(1, DAY_S + 1) if DAY_S % d == 0]


def _grain(steps: DataFrame) -> Column:
    """The greatest number of seconds that divides every step; steps divide the day, so there are few to try."""
    fits = steps.select("step_s").distinct().select("step_s", F.explode(F.array(*map(F.lit, DIVISORS))).alias("d")).groupBy("d").agg(F.max(F.col("step_s") % F.col("d")).alias("rest"))
    return fits.where("rest = 0").agg(F.max("d").alias("d")).select("d").scalar()


def regular_grid(raw: DataFrame, detectors: DataFrame, value: str = "flow", max_gap: int = 3) -> DataFrame:
    """One row for each step of a detector between its first and last step with a reading.

    Columns: city, detid, day_key, slot, n_readings, <value>, state. The value of a step is the mean of its
    readings, each instant counted once in its latest version. state is "observed"; "carried" where the last
    observation at most max_gap steps back stands in, over midnight and over days without any reading as well; "missing" (value null) beyond that.

    Readings are spread by (city, detid, day), reduced to instants and to buckets of the greatest common part of all steps; only those, as many as
    the grid has places however many readings there are, meet the detectors' steps and come together by detector. Each detector's time sequence is laid out from every bucket to the next one, which is
    the left join of the whole sequence to the buckets without shuffling the steps. The raw table is read once.

    Null or unusable city, detid, day or interval: no reading. Readings without a usable value: n_readings > 0, the
    value carried or missing. Repeated rows: one reading. Detectors without a known step (absent from detectors, null, or not dividing
    the day): no rows. Empty input: empty output.
    """
    steps = detectors.where((F.col("step_s") > 0) & (F.lit(DAY_S) % F.col("step_s") == 0)).groupBy(*KEY).agg(F.max("step_s").alias("step_s"))
    grain = _grain(steps)
    instants = latest(readings(raw, value).repartition(*KEY, "day_no"), (value,), *KEY, "day_no", "sec")
    fine = instants.groupBy(*KEY, "day_no", F.floor(F.col("sec") / grain).alias("part")).agg(F.count("*").alias("n"), F.count(value).alias("known"), F.sum(value).alias("total"))
    slots = F.expr(f"{DAY_S} div step_s")
    pos = F.col("day_no") * slots + F.floor(F.col("part") * grain / F.col("step_s"))
    buckets = (
        fine.repartition(*KEY)
        .join(steps, list(KEY))
        .groupBy(*KEY, slots.alias("slots"), pos.cast("long").alias("pos"))
        .agg(F.sum("n").alias("n"), (F.sum("total") / F.when(F.sum("known") > 0, F.sum("known"))).alias("v"))
    )
    w = Window.partitionBy(*KEY).orderBy("pos")
    known = F.col("v").isNotNull()
    laid = buckets.withColumns(
        {
            "last_v": F.last("v", ignorenulls=True).over(w),
            "last_pos": F.last(F.when(known, F.col("pos")), ignorenulls=True).over(w),
            "end": F.coalesce(F.lead("pos").over(w) - 1, F.col("pos")),
        }
    ).withColumn("step", F.explode(F.sequence("pos", "end")))
    here = F.col("step") == F.col("pos")
    carried = F.coalesce(F.col("step") - F.col("last_pos") <= max_gap, F.lit(False))
    return laid.select(
        *KEY,
        day_key(F.expr("cast(floor(step / slots) as int)")).alias("day_key"),
        F.pmod("step", "slots").cast("int").alias("slot"),
        F.when(here, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_readings"),
        F.when(carried, F.col("last_v")).alias(value),
        F.when(here & known, "observed").when(carried, "carried").otherwise("missing").alias("state"),
    )
