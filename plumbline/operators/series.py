"""Feature series of detector observations: cleaning, recent days, busiest detectors, calendar and lag features, chronological split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import scratch

SERIES = ("city", "detid")
#: Rows of one detector in one window.
PIECE_ROWS = 100_000


@dataclass(frozen=True)
class SeriesConfig:
    """Settings of prepare(); None switches a limit off."""

    horizon: int = 1
    lags: tuple[int, ...] = (1, 2, 3, 6)
    days: int | None = 30
    detectors: int | None = 40
    min_points: int = 400
    row_id: str = "obs_id"


def finite(c: Column) -> Column:
    """The number, with NaN and infinities made null."""
    return F.when((c > F.lit(float("-inf"))) & (c < F.lit(float("inf"))), c)


def _number(raw: DataFrame, name: str) -> Column:
    return finite(F.expr(f"try_cast(`{name}` as double)"))


def clean_observations(raw: DataFrame) -> DataFrame:
    """Rows with a date, a finite interval, flow and occ, city and detid, and an error of zero or none.

    Cells that can't be read count as missing. Without an error column no row is dropped for it. Text and typed columns are both accepted.
    """
    fixed = {"day": F.expr("try_cast(day as date)"), **{c: _number(raw, c) for c in ("interval", "flow", "occ")}}
    out = raw.withColumns(fixed)
    if "error" in raw.columns:
        out = out.where(F.coalesce(_number(raw, "error"), F.lit(0.0)) == 0)
    return out.na.drop(subset=["day", "interval", "flow", "occ", *SERIES])


def recent_days(obs: DataFrame, days: int | None) -> DataFrame:
    """The last `days` calendar days of each city. The last day is found by a combined aggregate, so a large city isn't sorted into one task."""
    if days is None:
        return obs
    last = obs.groupBy("city").agg(F.max("day").alias("__last")).withColumnRenamed("city", "__city")
    return obs.join(last, F.col("city") == F.col("__city")).where(F.col("day") >= F.date_sub("__last", days - 1)).drop("__city", "__last")


def busiest_detectors(obs: DataFrame, most: int | None, min_points: int, row_id: str = "obs_id") -> DataFrame:
    """(city, detid, n): per city at most `most` detectors with min_points rows or more, by rows; ties go to the one seen first."""
    n = obs.groupBy(*SERIES).agg(F.count("*").alias("n"), F.min(row_id).alias("__first")).where(F.col("n") >= min_points)
    if most is not None:
        w = Window.partitionBy("city").orderBy(F.desc("n"), "__first")
        n = n.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most)
    return n.select(*SERIES, "n")


def profile(obs: DataFrame, row_id: str = "obs_id") -> DataFrame:
    """(city, detid, day, n, top, first): rows, greatest interval and least row_id of each detector and day, written to the shared folder. What the limits and windows need to know of the rows is in it."""
    out = obs.groupBy(*SERIES, "day").agg(F.count("*").alias("n"), F.max("interval").alias("top"), F.min(row_id).alias("first"))
    at = scratch(obs.sparkSession, "series")
    out.write.parquet(at)
    return obs.sparkSession.read.parquet(at)


def kept_days(prof: DataFrame, config: SeriesConfig) -> DataFrame:
    """(city, detid, day, n, period): the days within the limits of the detectors within the limits; a city's period is its greatest interval + 1."""
    recent = recent_days(prof, config.days)
    n = recent.groupBy(*SERIES).agg(F.sum("n").alias("__n"), F.min("first").alias("__first"), F.max("top").alias("__top")).where(F.col("__n") >= config.min_points)
    if config.detectors is not None:
        n = n.withColumn("__rank", F.row_number().over(Window.partitionBy("city").orderBy(F.desc("__n"), "__first"))).where(F.col("__rank") <= config.detectors)
    period = n.groupBy("city").agg((F.max("__top") + 1.0).alias("period"))
    return recent.join(n.select(*SERIES), list(SERIES), "left_semi").join(period, "city").select(*SERIES, "day", "n", "period")


def pieces(days: DataFrame, behind: int, ahead: int, rows: int) -> DataFrame:
    """Adds total, before (rows of the series, and before the day), home (the day's piece of about `rows` rows) and pieces: home, and those that look at rows of the day from `behind` rows
    after or `ahead` rows before it. Every day has a row at least, so few neighbouring days are asked."""
    w = Window.partitionBy(*SERIES).orderBy("day")
    held = days.withColumns({"total": F.sum("n").over(Window.partitionBy(*SERIES)), "before": F.sum("n").over(w) - F.col("n")})
    held = held.withColumn("home", F.floor(F.col("before") / rows).cast("int"))
    here = F.struct("home", "before", (F.col("before") + F.col("n")).alias("end"))
    near = lambda lo, hi: F.collect_list(here).over(w.rowsBetween(lo, hi))
    held = held.withColumns({"__next": near(1, behind), "__last": near(-ahead, -1)})
    end = F.col("before") + F.col("n")
    needed = F.concat(F.filter("__next", lambda x: x["before"] - end < behind), F.filter("__last", lambda x: F.col("before") - x["end"] < ahead))
    return held.withColumn("pieces", F.array_union(F.array("home"), F.transform(needed, lambda x: x["home"]))).drop("__next", "__last")


def with_days(obs: DataFrame, days: DataFrame) -> DataFrame:
    """Rows on the given days of the given detectors; the columns of days come along, led by two underscores. Joined by (city, detid, day), so one detector's rows spread."""
    own = days.select(*(F.col(c).alias(f"__{c}") for c in days.columns))
    same = [F.col(c) == F.col(f"__{c}") for c in (*SERIES, "day")]
    return obs.join(own, same).drop("__city", "__detid", "__day")


def _calendar(rows: DataFrame) -> DataFrame:
    part = F.least(F.greatest(F.col("interval") / F.when(F.col("__period") == 0, 1.0).otherwise(F.col("__period")), F.lit(0.0)), F.lit(1.0))
    turn = lambda x: F.lit(2.0) * F.pi() * x
    dow = F.weekday("day").cast("byte")
    return rows.withColumns(
        {
            "dow": dow,
            "is_weekend": (dow >= 5).cast("byte"),
            "dow_sin": F.sin(turn(dow / 7.0)),
            "dow_cos": F.cos(turn(dow / 7.0)),
            "tod_sin": F.sin(turn(part)),
            "tod_cos": F.cos(turn(part)),
        }
    )


def calendar_features(obs: DataFrame) -> DataFrame:
    """Adds dow (Monday 0), is_weekend, and sine and cosine of weekday and time of day; a day's period is the city's greatest interval + 1."""
    period = obs.groupBy("city").agg((F.max("interval") + 1.0).alias("__period")).withColumnRenamed("city", "__city")
    return _calendar(obs.join(period, F.col("city") == F.col("__city"))).drop("__city", "__period")


def _lagged(rows: DataFrame, lags: tuple[int, ...], horizon: int, row_id: str) -> DataFrame:
    """Rows with the columns of pieces(): each piece is a window, whose rows lent by other days give lags and targets only."""
    cut = rows.withColumn("__piece", F.explode("__pieces"))
    p = Window.partitionBy(*SERIES, "__piece")
    w = p.orderBy("day", "interval", row_id)
    steps = sorted({*lags, 1})
    out = cut.withColumns({**{f"{c}_lag{k}": F.lag(c, k).over(w) for c in ("flow", "occ") for k in steps}, "y": F.lead("flow", horizon).over(w), "__i": F.row_number().over(w) - 1 + F.min("__before").over(p)})
    end = {s: (F.lit(s) * F.col("__total")).cast("int") for s in (0.6, 0.8)}
    i = F.col("__i")
    split = (
        F.when(i < end[0.6] - horizon, "train")
        .when((i >= end[0.6]) & (i < end[0.8] - horizon), "val")
        .when((i >= end[0.8]) & (i < F.col("__total") - horizon), "test")
    )
    own = out.where(F.col("__piece") == F.col("__home"))
    return own.withColumns({"flow_diff1": F.col("flow") - F.col("flow_lag1"), "split": split}).drop("__i", "__piece", "__home", "__pieces", "__before", "__total", "__n", "__period")


def _days_for_lags(days: DataFrame, lags: tuple[int, ...], horizon: int) -> DataFrame:
    return pieces(days, max(*lags, 1), horizon, PIECE_ROWS)


def lag_features(obs: DataFrame, lags: tuple[int, ...], horizon: int, row_id: str = "obs_id") -> DataFrame:
    """Adds flow and occ lagged by rows, flow_diff1, y (flow `horizon` rows on) and split. All windows share one exchange and one sort.

    A series longer than PIECE_ROWS is cut between days; days next to a cut are lent over it, and row numbers go on from piece to piece, so results are those of the whole series.
    split: the first 60 % of a series' rows train, the next 20 % val, the rest test, each without its last `horizon` rows (null there).
    """
    days = _days_for_lags(profile(obs, row_id).select(*SERIES, "day", "n"), lags, horizon)
    return _lagged(with_days(obs, days), lags, horizon, row_id)


def feature_names(lags: tuple[int, ...]) -> list[str]:
    steps = sorted({*lags, 1})
    return ["interval", "flow", "occ", "tod_sin", "tod_cos", "dow_sin", "dow_cos", "is_weekend", "flow_diff1", *(f"flow_lag{k}" for k in steps), *(f"occ_lag{k}" for k in steps)]


def kept(raw: DataFrame, config: SeriesConfig = SeriesConfig()) -> DataFrame:
    """Clean rows within the limits, with calendar features. The raw table is read twice: for the counts by detector and day, and for the rows."""
    obs = clean_observations(raw)
    return _calendar(with_days(obs, kept_days(profile(obs, config.row_id), config))).drop("__n", "__period")


def lagged(raw: DataFrame, config: SeriesConfig = SeriesConfig()) -> DataFrame:
    """As kept(), with lags, target and split."""
    obs = clean_observations(raw)
    days = _days_for_lags(kept_days(profile(obs, config.row_id), config), config.lags, config.horizon)
    return _lagged(_calendar(with_days(obs, days)), config.lags, config.horizon, config.row_id)


def prepare(raw: DataFrame, config: SeriesConfig = SeriesConfig()) -> tuple[DataFrame, list[str]]:
    """Feature rows without nulls, and the names of the features in order."""
    names = feature_names(config.lags)
    return lagged(raw, config).na.drop(subset=[*names, "y", "split"]), names


def finite_rows(rows: DataFrame, names: list[str], target: str = "y") -> DataFrame:
    """Rows whose features and target are all finite numbers."""
    good = F.lit(True)
    for c in (*names, target):
        good = good & finite(F.col(c).cast("double")).isNotNull()
    return rows.where(good)


def split_sizes(rows: DataFrame, train: int = 500, val: int = 200, test: int = 200) -> DataFrame:
    """(city, n_train, n_val, n_test, eligible)."""
    n = rows.groupBy("city").agg(*(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")))
    return n.withColumn("eligible", (F.col("n_train") >= train) & (F.col("n_val") >= val) & (F.col("n_test") >= test))
