"""Missing cells of readings filled by a mixture model of Gaussian and categorical variables, fitted by expectation-maximisation.

Model. For a reading of detector d (city and detid), x = ln(flow + 5) - a_d and y = ln(occ + 0.005) - b_d, a_d and b_d being the detector's means.
Given a hidden class k of K, (x, y) is Gaussian with mean m_k and covariance S_k, the hour of the day and weekday/weekend
are categorical, and so is the detector: its classes have weights w_d(k), drawn towards the common weights. Given the detector, its days and two habits are categorical as well: how its times
fall on whole minutes (ALIGNED), and by what its counts, written as vehicles per hour, can be divided (PARTS).

Fitting. All rows are reduced once to cells: detector, hour, weekend, and narrow bins of flow and occ (a bin for "missing" too), with
counts and sums. A detector's cells form one row of a table in the shared folder, bounded by the number of bins however many rows the detector
has. Each EM step is one job over that table: its tasks find w_d of their detectors and return the expected
sufficient statistics of the classes and the log-likelihood, a fixed number of sums; only those reach the driver, which stops once the likelihood hardly rises any more. The categories given the detector
need no steps: they are counts, added up by detector and day.

Filling. Missing detid: the detector of the city with the greatest posterior probability (the mode) among those with readings on the row's day, given its own hour,
weekday/weekend, flow, occ and habits. Missing flow and occ: conditional expectation given the detector, the hour, weekday/weekend and the other measurement.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import has_number, has_word
from plumbline.operators.readings import DAY_S
from plumbline.session import drop, scratch

FLOW_OFF, OCC_OFF = 5.0, 0.005
FLOW_BIN, OCC_BIN = 1 / 3, 1 / 2  # widths of the cells' bins, in logarithms
FLOW_MAX, OCC_MAX = 12_000.0, 1.0  # beyond: not used for fitting
HOURS = 24
CELLS_AT_ONCE = 20_000
#: Of the search for missing detectors: rows asked for in a group on an average day, and detectors it holds (more, if else over HEAVY cities would have to be parted).
ASKED, HELD, HEAVY = 20_000, 5_000, 1_000
SCORES_AT_ONCE = 2_000_000
NO_DAY = -(1 << 30)
# Categories of a detector's habits: seconds its times are whole multiples of, and numbers its flows are. The first that fits counts.
ALIGNED = (1800, 300, 60, 1)
PARTS = (60.0, 30.0, 20.0, 15.0, 12.0, 10.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.5)
HABIT = 0.1  # readings' worth of every category in a detector's own
NONE = -1000.0  # no x or y among the keys of that search
PRIOR = 20.0  # readings' worth of the common weights in a detector's own


@dataclass
class Mixture:
    """Parameters of the classes; everything in it has a fixed size."""

    weight: np.ndarray  # K
    hour: np.ndarray  # K x 24
    weekend: np.ndarray  # K x 2
    mean: np.ndarray  # K x 2
    cov: np.ndarray  # K x 2 x 2
    a: float = 0.0  # means over all detectors, for those without known values
    b: float = 0.0
    likelihood: list[float] = field(default_factory=list)  # mean log-likelihood of a reading, before each step
    converged: bool = False

    @classmethod
    def start(cls, k: int, spread: np.ndarray) -> Mixture:
        """Classes along the line from quiet to busy, each with its hours about even."""
        at = np.linspace(-1.8, 1.3, k)
        rng = np.random.default_rng(17)
        hour = np.full((k, HOURS), 1 / HOURS) * rng.uniform(0.9, 1.1, (k, HOURS))
        return cls(np.full(k, 1 / k), hour / hour.sum(1, keepdims=True), np.full((k, 2), 0.5), at[:, None] * spread[None, :], np.tile(np.diag((spread / 2) ** 2 + 0.01), (k, 1, 1)))

    def log_density(self, hour: np.ndarray, weekend: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """n x K, without weights; NaN in x or y and -1 in hour or weekend mean missing and are integrated out."""
        out = np.zeros((x.size, self.weight.size))
        h, e = hour >= 0, weekend >= 0
        out[h] += np.log(self.hour.T[hour[h]] + 1e-12)
        out[e] += np.log(self.weekend.T[weekend[e]] + 1e-12)
        px, py = ~np.isnan(x), ~np.isnan(y)
        dx, dy = x[:, None] - self.mean[:, 0], y[:, None] - self.mean[:, 1]
        sxx, syy, sxy = self.cov[:, 0, 0], self.cov[:, 1, 1], self.cov[:, 0, 1]
        det = sxx * syy - sxy**2
        both, fx, fy = px & py, px & ~py, ~px & py
        if both.any():
            out[both] -= 0.5 * ((syy * dx[both] ** 2 - 2 * sxy * dx[both] * dy[both] + sxx * dy[both] ** 2) / det + np.log(det)) + np.log(2 * np.pi)
        for rows, d, s in ((fx, dx, sxx), (fy, dy, syy)):
            if rows.any():
                out[rows] -= 0.5 * (d[rows] ** 2 / s + np.log(2 * np.pi * s))
        return out

    def calendar(self) -> np.ndarray:
        """K x 75: log probabilities of hour and weekend together, at (hour % 25) * 3 + weekend % 3, so that -1 has a place for unknown."""
        zero = np.zeros((self.weight.size, 1))
        hour, weekend = np.c_[np.log(self.hour + 1e-12), zero], np.c_[np.log(self.weekend + 1e-12), zero]
        return (hour[:, :, None] + weekend[:, None, :]).reshape(zero.size, -1)

    def conditional(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """n x K expectations of x, y and their conditional (co)variances, given what is known."""
        mx, my = self.mean[:, 0], self.mean[:, 1]
        sxx, syy, sxy = self.cov[:, 0, 0], self.cov[:, 1, 1], self.cov[:, 0, 1]
        nx, ny = np.isnan(x)[:, None], np.isnan(y)[:, None]
        ex = np.where(nx, np.where(ny, mx, mx + sxy / syy * (np.nan_to_num(y)[:, None] - my)), x[:, None])
        ey = np.where(ny, np.where(nx, my, my + sxy / sxx * (np.nan_to_num(x)[:, None] - mx)), y[:, None])
        vx = np.where(nx, np.where(ny, sxx, sxx - sxy**2 / syy), 0.0)
        vy = np.where(ny, np.where(nx, syy, syy - sxy**2 / sxx), 0.0)
        return ex, ey, vx, vy, np.where(nx & ny, sxy, 0.0)

    def updated(self, s: np.ndarray) -> Mixture:
        """The next parameters from the expected sufficient statistics."""
        k = self.weight.size
        s = s.reshape(k, -1)
        n = s[:, 0] + 1e-9
        hour, weekend = s[:, 1 : 1 + HOURS] + 0.5, s[:, 1 + HOURS : 3 + HOURS] + 0.5
        sx, sy, sxx, syy, sxy = s[:, 3 + HOURS :].T
        mx, my = sx / n, sy / n
        least = (np.array([FLOW_BIN, OCC_BIN]) ** 2) / 12 + 1e-3
        cov = np.empty((k, 2, 2))
        cov[:, 0, 0], cov[:, 1, 1] = np.maximum(sxx / n - mx**2, 0) + least[0], np.maximum(syy / n - my**2, 0) + least[1]
        cov[:, 0, 1] = cov[:, 1, 0] = np.clip(sxy / n - mx * my, -1, 1) * 0.999
        return Mixture(n / n.sum(), hour / hour.sum(1, keepdims=True), weekend / weekend.sum(1, keepdims=True), np.stack([mx, my], 1), cov, self.a, self.b, self.likelihood)


def _softmax(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass
class _Cells:
    """Cells of whole detectors, one after the other; what is about classes is K x cells, so that all work runs along the cells."""

    density: np.ndarray  # of a cell in each class without weights, divided by the greatest of its classes
    top: np.ndarray  # logarithm of that
    powers: np.ndarray  # 1, x, y, x * x, x * y, y * y; 0 instead of x and y where either is missing
    when: np.ndarray  # place in the calendar
    gaps: np.ndarray  # cells where x or y is missing

    @classmethod
    def of(cls, m: Mixture, hour: np.ndarray, weekend: np.ndarray, x: np.ndarray, y: np.ndarray) -> _Cells:
        gaps = np.flatnonzero(np.isnan(x) | np.isnan(y))
        u, v = x.copy(), y.copy()
        u[gaps] = v[gaps] = 0.0
        powers = np.stack([np.ones(u.size), u, v, u * u, u * v, v * v])
        when = hour.astype(np.intp) % (HOURS + 1) * 3 + weekend % 3
        logs = _scores(m, np.zeros(1), np.zeros(1), True, True).T @ powers
        logs += np.take(m.calendar(), when, 1)
        if gaps.size:
            logs[:, gaps] = m.log_density(hour[gaps], weekend[gaps], x[gaps], y[gaps]).T
        top = logs.max(0)
        logs -= top
        return cls(np.exp(logs, out=logs), top, powers, when, gaps)

    def weighted(self, w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Densities times the weights of each cell's detector. The class with density 1 keeps every sum over classes above 0."""
        out = np.repeat(w + 1e-12, sizes, 1)
        out *= self.density
        return out


def _detector_weights(m: Mixture, cells: _Cells, sizes: np.ndarray, n: np.ndarray, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """K x detectors: w_d of the detectors that have so many cells each (one at least); K x cells: readings of each cell by class."""
    w = np.tile(m.weight[:, None], (1, sizes.size))
    starts = np.cumsum(sizes) - sizes
    for _ in range(turns):
        r = cells.weighted(w, sizes)
        r *= n / r.sum(0)
        held = np.add.reduceat(r, starts, 1) + PRIOR * m.weight[:, None]
        w = held / held.sum(0)
    return w, r


def _unpack(batch: pa.RecordBatch, a0: float, b0: float) -> Iterator[tuple[int, int, np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Pieces of whole detectors: first and last row, how many cells each detector has, the cells, the detectors' means."""
    col = batch.column(batch.schema.get_field_index("cells"))
    ends = np.asarray(col.offsets)
    cells = col.values
    f = {name: np.asarray(cells.field(i)) for i, name in enumerate(("hour", "weekend", "n", "sx", "sy"))}
    means = [np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), float) for c in ("a", "b")]
    start = 0
    while start < batch.num_rows:
        stop = start + 1
        while stop < batch.num_rows and ends[stop + 1] - ends[start] <= CELLS_AT_ONCE:
            stop += 1
        lo, hi = ends[start], ends[stop]
        sizes = np.diff(ends[start : stop + 1])
        a, b = (np.where(np.isnan(x[start:stop]), x0, x[start:stop]) for x, x0 in zip(means, (a0, b0)))
        c = {k: v[lo:hi] for k, v in f.items()}
        n = c["n"].astype(float)
        c["n"], c["x"], c["y"] = n, c["sx"] / n - np.repeat(a, sizes), c["sy"] / n - np.repeat(b, sizes)
        yield start, stop, sizes, c, a, b
        start = stop


def _expect(m: Mixture, turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = m.weight.size
        total, likelihood, count = np.zeros((k, 8 + HOURS)), 0.0, 0.0
        for batch in batches:
            for _, _, sizes, c, _, _ in _unpack(batch, m.a, m.b):
                n, cells = c["n"], _Cells.of(m, c["hour"], c["weekend"], c["x"], c["y"])
                w, r = _detector_weights(m, cells, sizes, n, turns)
                likelihood += float(n @ (cells.top + np.log(cells.weighted(w, sizes).sum(0))))
                count += float(n.sum())
                by = np.stack([np.bincount(cells.when, q, (HOURS + 1) * 3) for q in r]).reshape(k, HOURS + 1, 3)
                total[:, 1 : 1 + HOURS] += by[:, :HOURS].sum(2)
                total[:, 1 + HOURS : 3 + HOURS] += by[:, :, :2].sum(1)
                total[:, [0, *range(3 + HOURS, 8 + HOURS)]] += (r @ cells.powers.T)[:, [0, 1, 2, 3, 5, 4]]
                if cells.gaps.size:
                    q = r[:, cells.gaps].T
                    ex, ey, vx, vy, vxy = m.conditional(c["x"][cells.gaps], c["y"][cells.gaps])
                    total[:, 3 + HOURS :] += np.stack([(q * ex).sum(0), (q * ey).sum(0), (q * (ex**2 + vx)).sum(0), (q * (ey**2 + vy)).sum(0), (q * (ex * ey + vxy)).sum(0)], 1)
        sums = np.r_[total.ravel(), likelihood, count]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums)], names=["i", "v"])

    return run


def _weigh(m: Mixture, turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, sizes, c, a, b in _unpack(batch, m.a, m.b):
                w, _ = _detector_weights(m, _Cells.of(m, c["hour"], c["weekend"], c["x"], c["y"]), sizes, c["n"], turns)
                piece = batch.slice(start, stop - start)
                total = np.add.reduceat(c["n"], np.cumsum(sizes) - sizes).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(total), pa.array(a), pa.array(b), pa.ListArray.from_arrays(np.arange(stop - start + 1, dtype=np.int32) * w.shape[0], pa.array(w.T.ravel()))],
                    names=["city", "detid", "n", "a", "b", "w"],
                )

    return run


def _variables(raw: DataFrame) -> dict[str, Column]:
    """hour, weekend, align, part (-1: unknown), day_no (NO_DAY: unknown), x and y before centring (null: not usable for the model)."""
    known = F.col("day").isNotNull() & has_number(F.col("interval"), ())
    over = F.floor(F.col("interval") / DAY_S)
    sec = F.col("interval") - over * DAY_S
    day_no = (F.unix_date(F.col("day").cast("date")) + over).cast("int")
    good = lambda c, most: has_number(F.col(c)) & (F.col(c) >= 0) & (F.col(c) <= most)

    def first(c: Column, parts: tuple[float, ...]) -> Column:
        out = F.lit(len(parts))
        for i in reversed(range(len(parts))):
            out = F.when(F.pmod(c, F.lit(float(parts[i]))) == 0, F.lit(i)).otherwise(out)
        return out

    return {
        "hour": F.when(known, F.floor(sec / 3600).cast("int")).otherwise(F.lit(-1)),
        "weekend": F.when(known, (F.pmod(day_no + 3, F.lit(7)) >= 5).cast("int")).otherwise(F.lit(-1)),
        "day_no": F.when(known, day_no).otherwise(F.lit(NO_DAY)),
        "align": F.when(known, first(sec, ALIGNED)).otherwise(F.lit(-1)),
        "part": F.when(good("flow", FLOW_MAX) & (F.col("flow") > 0), first(F.col("flow"), PARTS)).otherwise(F.lit(-1)),
        "x": F.when(good("flow", FLOW_MAX), F.log(F.col("flow") + FLOW_OFF)),
        "y": F.when(good("occ", OCC_MAX), F.log(F.col("occ") + OCC_OFF)),
    }


@dataclass
class Fitted:
    """mixture; detectors: city, detid, n, a, b, w; days: city, day_no, detid, n_day, n, a, b, w, align, part, the last two log probabilities of the detector's habits;
    present: the cities' days with named readings; parts: for cities with very many rows to name or detectors, into how many parts either is to be cut."""

    mixture: Mixture
    detectors: DataFrame
    days: DataFrame
    present: DataFrame
    parts: dict[str, tuple[int, int]]


def fit(raw: DataFrame, classes: int = 12, steps: int = 60, turns: int = 3, rise: float = 1e-3) -> Fitted:
    """The classes, fitted until a step raises the mean log-likelihood of a reading by less than a share `rise` of it (or after `steps`, which leaves converged False), and the tables of the detectors, in the shared folder."""
    spark = raw.sparkSession
    folder = scratch(spark, "impute")
    v = _variables(raw)
    named = F.when(has_word(F.col("detid")), F.col("detid")).alias("detid")
    rows = raw.where("city is not null").select("city", named, *(c.alias(k) for k, c in v.items()))
    fb, ob = F.floor(F.col("x") / FLOW_BIN).cast("int"), F.floor(F.col("y") / OCC_BIN).cast("int")
    cells = rows.groupBy("city", "detid", F.col("hour").cast("byte").alias("hour"), F.col("weekend").cast("byte").alias("weekend"), fb.cast("short").alias("fb"), ob.cast("short").alias("ob")).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    nan = F.lit(float("nan"))
    cell = F.struct(F.col("hour").cast("int").alias("hour"), F.col("weekend").cast("int").alias("weekend"), "n", F.coalesce("sx", nan).alias("sx"), F.coalesce("sy", nan).alias("sy"))
    mean = lambda s: F.sum(s) / F.sum(F.when(F.col(s).isNotNull(), F.col("n")))
    cells.groupBy("city", "detid").agg(F.sum("n").alias("n"), mean("sx").alias("a"), mean("sy").alias("b"), F.collect_list(cell).alias("cells")).write.parquet(f"{folder}/cells")
    every = spark.read.parquet(f"{folder}/cells")
    packed = every.where("detid is not null")
    held = packed.agg(F.avg("a"), F.avg("b")).first()
    m = Mixture.start(classes, np.array([1.0, 0.6]))
    m.a, m.b = (float(x) if x is not None else 0.0 for x in held)
    for _ in range(steps):
        got = packed.mapInArrow(_expect(m, turns), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        stats = np.zeros(classes * (8 + HOURS) + 2)
        for r in got:
            stats[r.i] = r.v
        if stats[-1] <= 0:
            break
        m.likelihood.append(float(stats[-2] / stats[-1]))
        if len(m.likelihood) > 1 and m.likelihood[-1] - m.likelihood[-2] < rise * abs(m.likelihood[-1]):
            m.converged = True
            break
        m = m.updated(stats[:-2])
    packed.mapInArrow(_weigh(m, 2 * turns), "city string, detid string, n long, a double, b double, w array<double>").write.parquet(f"{folder}/detectors")
    detectors = spark.read.parquet(f"{folder}/detectors")

    # Detectors by day, with counts of their habits; a row for each habit's category would be many times as many.
    habits = {"align": len(ALIGNED) + 1, "part": len(PARTS) + 1}
    counts = {f"{h}_{i}": F.count_if(F.col(h) == i) for h, n in habits.items() for i in range(n)}
    rows.where("detid is not null").groupBy("city", "detid", "day_no").agg(F.count("*").alias("n_day"), *(c.alias(k) for k, c in counts.items())).write.parquet(f"{folder}/days")
    by_day = spark.read.parquet(f"{folder}/days")
    total = by_day.groupBy("city", "detid").agg(*(F.array(*(F.sum(f"{h}_{i}") for i in range(n))).alias(h) for h, n in habits.items()))
    share = lambda h: F.transform(h, lambda c: F.log((c + HABIT) / (F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + x) + HABIT * habits[h])).cast("float")).alias(h)
    whole = detectors.withColumn("w", F.col("w").cast("array<float>")).join(total.select("city", "detid", *(share(h) for h in habits)), ["city", "detid"])
    undated = detectors.select("city", "detid", F.lit(NO_DAY).alias("day_no"), F.col("n").alias("n_day"))  # for rows without a day: all of its readings
    days = by_day.where(F.col("day_no") != NO_DAY).select("city", "detid", "day_no", "n_day").unionByName(undated).join(whole, ["city", "detid"])

    present = by_day.where(F.col("day_no") != NO_DAY).select("city", "day_no").distinct()
    on = by_day.groupBy("city").agg(F.count_distinct("day_no").alias("on"))
    cities = every.groupBy("city").agg(F.sum(F.when(F.col("detid").isNull(), F.col("n"))).alias("asked"), F.count("detid").alias("held")).join(on, "city").select("city", (F.col("asked") / F.col("on")).cast("long").alias("asked"), "held")
    sums = cities.agg(F.sum("asked"), F.sum("held")).first()
    most_asked, most_held = max(ASKED, (sums[0] or 0) // HEAVY), max(HELD, (sums[1] or 0) // HEAVY)
    heavy = cities.where((F.col("asked") > most_asked) | (F.col("held") > most_held)).collect()  # 2 * HEAVY at most
    parts = {r.city: (1 + (r.asked or 0) // most_asked, 1 + r.held // most_held) for r in heavy}
    drop(spark, f"{folder}/cells")
    return Fitted(m, detectors, days, present, parts)


def _scores(m: Mixture, a: np.ndarray, b: np.ndarray, x: bool, y: bool) -> np.ndarray:
    """6 x (detectors * K): what 1, x, y, x * x, x * y and y * y add to the log density, when x and y are known or not."""
    mx, my = a[:, None] + m.mean[:, 0], b[:, None] + m.mean[:, 1]
    sxx, syy, sxy = m.cov[:, 0, 0], m.cov[:, 1, 1], m.cov[:, 0, 1]
    zero = np.zeros_like(mx)
    if x and y:
        det = sxx * syy - sxy**2
        p, q, r = zero + syy / det, zero - sxy / det, zero + sxx / det
        norm = zero + np.log(det) + 2 * np.log(2 * np.pi)
    else:
        p, q, r = (zero + 1 / sxx if x else zero), zero, (zero + 1 / syy if y else zero)
        norm = zero + (np.log(2 * np.pi * sxx) if x else np.log(2 * np.pi * syy) if y else 0.0)
    parts = (-0.5 * (p * mx**2 + 2 * q * mx * my + r * my**2 + norm), p * mx + q * my, q * mx + r * my, -0.5 * p, -q, -0.5 * r)
    return np.stack([c.ravel() for c in parts])


ASKED_BY = ("city", "day_no", "hour", "weekend", "align", "part", "x", "y")


def _modes(m: Mixture):
    """The likeliest detector of each row asked for, among those of its city with readings on its day (of all its city, if there are none), and how likely it is."""

    def run(key: tuple, asked: pd.DataFrame, dets: pd.DataFrame) -> pd.DataFrame:
        out = asked[list(ASKED_BY)].copy()
        best, score = np.full(len(asked), None, object), np.full(len(asked), -np.inf)
        if len(asked) and len(dets):
            dets = dets.sort_values("detid")
            k, names = m.weight.size, dets["detid"].to_numpy(object)
            prior = np.log(np.stack(dets["w"].to_numpy()) + 1e-12) + np.log(dets["n_day"].to_numpy(float))[:, None]
            # One column for each category, and one of zeros for an unknown one (-1).
            habits = {h: np.c_[np.stack(dets[h].to_numpy()), np.zeros(len(dets))] for h in ("align", "part")}
            hour, weekend = asked["hour"].to_numpy(int), asked["weekend"].to_numpy(int)
            align, part = asked["align"].to_numpy(int), asked["part"].to_numpy(int)
            x, y = asked["x"].to_numpy(float), asked["y"].to_numpy(float)
            calendar = m.log_density(hour, weekend, np.full(x.size, np.nan), np.full(x.size, np.nan))
            has_x, has_y = x != NONE, y != NONE
            most = max(1, SCORES_AT_ONCE // prior.size)
            for px, py in ((True, True), (True, False), (False, True), (False, False)):
                rows = np.flatnonzero((has_x == px) & (has_y == py))
                if not rows.size:
                    continue
                c = _scores(m, dets["a"].to_numpy(float), dets["b"].to_numpy(float), px, py)
                c[0] += prior.ravel()
                c = np.ascontiguousarray(c.reshape(6, -1, k).transpose(2, 0, 1))  # by class, so that all work runs along the detectors
                for at in range(0, rows.size, most):
                    r = rows[at : at + most]
                    u, v = np.where(px, x[r], 0.0), np.where(py, y[r], 0.0)
                    logs = np.stack([np.ones(r.size), u, v, u * u, u * v, v * v], 1) @ c
                    logs += calendar[r].T[:, :, None]
                    top = logs.max(0)
                    logs -= top
                    own = top + np.log(np.exp(logs, out=logs).sum(0)) + habits["align"].T[align[r]] + habits["part"].T[part[r]]
                    j = own.argmax(1)
                    best[r], score[r] = names[j], own[np.arange(r.size), j]
        out["guess"], out["score"] = best, score
        return out

    return run


def _filler(m: Mixture):
    @F.pandas_udf("flow double, occ double")
    def fill(hour: pd.Series, weekend: pd.Series, x: pd.Series, y: pd.Series, a: pd.Series, b: pd.Series, w: pd.Series) -> pd.DataFrame:
        a, b = a.fillna(m.a).to_numpy(float), b.fillna(m.b).to_numpy(float)
        cx, cy = x.to_numpy(float) - a, y.to_numpy(float) - b
        weights = np.stack([m.weight if v is None else np.asarray(v, float) for v in w]) if len(w) else np.zeros((0, m.weight.size))
        r = _softmax(m.log_density(hour.to_numpy(int), weekend.to_numpy(int), cx, cy) + np.log(weights + 1e-12))
        ex, ey, vx, vy, _ = m.conditional(cx, cy)
        flow = (r * np.exp(ex + a[:, None] + vx / 2)).sum(1) - FLOW_OFF
        occ = (r * np.exp(ey + b[:, None] + vy / 2)).sum(1) - OCC_OFF
        return pd.DataFrame({"flow": np.maximum(flow, 0.0), "occ": np.clip(occ, 0.0, 1.0)})

    return fill


FIELDS = ("flow", "occ", "detid")


def filled(raw: DataFrame, classes: int = 12, steps: int = 60) -> DataFrame:
    """All rows and columns of readings, with flow, occ and detid filled where they have no usable value. flow_filled, occ_filled
    and detid_filled mark the cells that hold a filled value; unfilled (array<string>) names those that still have none.

    No usable value: null, not finite, blank, or a code or word for "no value". Impossible but genuine numbers stay as they are. Fitting and filling happen in
    Spark jobs; complete rows take part in no join. The search for a missing detid scores each row with its own values against the detectors of its
    city that have readings on its day; equal rows count once. Groups are (city, day), and cities with more rows to name or more detectors than a group should hold are parted further.

    Rows without city: flow and occ filled from the classes alone, detid stays null. Rows without day or interval: hour and day are integrated
    out. Cities without any known detector: detid stays null. Columns flow_filled, occ_filled, detid_filled and unfilled
    of the input are replaced. Empty input: empty output.
    """
    got = fit(raw, classes, steps)
    m, detectors = got.mixture, got.detectors
    lacks = {f"__no_{c}": ~(has_word if c == "detid" else has_number)(F.col(c)) for c in FIELDS}
    marked = raw.drop("unfilled").withColumns(lacks)
    lacking = F.col("__no_flow") | F.col("__no_occ") | F.col("__no_detid")
    none = F.array().cast("array<string>")
    whole = marked.where(~lacking).withColumns({**{f"{c}_filled": F.lit(False) for c in FIELDS}, "unfilled": none}).drop(*lacks)
    v = {f"__{k}": c for k, c in _variables(raw).items()}
    part = marked.where(lacking).withColumns(v)

    own = {k: F.coalesce(f"__{k}", F.lit(NONE)) if k in "xy" else F.col(f"__{k}") for k in ASKED_BY[1:]}
    nameless = part.where("__no_detid").withColumns({f"__key_{k}": c for k, c in own.items()})
    cut = F.create_map(*(x for c, (s, b) in got.parts.items() for x in (F.lit(c), F.array(F.lit(s), F.lit(b))))) if got.parts else None
    parts = lambda i: F.lit(1) if cut is None else F.coalesce(F.get(F.try_element_at(cut, F.col("city")), F.lit(i)), F.lit(1))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = nameless.where("city is not null").select("city", *(F.col(f"__key_{k}").alias(k) for k in own)).distinct()
    # On a day without any reading of the city that has a name, all its detectors are asked for, as for rows without a day.
    present = got.present.select(F.col("city").alias("__c"), F.col("day_no").alias("__d"))
    asked = asked.join(present, (F.col("city") == F.col("__c")) & (F.col("day_no") == F.col("__d")), "left").withColumn("at", F.coalesce("__d", F.lit(NO_DAY))).drop("__c", "__d")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64(*ASKED_BY), parts(0)).cast("int")).withColumn("block", upto(parts(1)))
    held = got.days.withColumnRenamed("day_no", "at").withColumn("block", F.pmod(F.xxhash64("detid"), parts(1)).cast("int")).withColumn("salt", upto(parts(0)))
    group = ("city", "at", "salt", "block")
    kinds = "city string, day_no int, hour int, weekend int, align int, part int, x double, y double, guess string, score double"
    scored = asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInPandas(_modes(m), kinds)
    guesses = scored.groupBy(*ASKED_BY).agg(F.min(F.struct((-F.col("score")).alias("s"), "guess")).alias("best")).select(*ASKED_BY, F.col("best.guess").alias("__guess"))
    same = [F.col("q.city") == F.col("p.city"), *(F.col(f"q.{k}") == F.col(f"p.__key_{k}") for k in own)]
    named = nameless.alias("p").join(guesses.alias("q"), same, "left").select("p.*", "q.__guess").withColumn("detid", F.col("__guess")).drop("__guess", *(f"__key_{k}" for k in own))
    ready = part.where("not __no_detid").unionByName(named)

    known = detectors.select(F.col("city").alias("__city"), F.col("detid").alias("__detid"), F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("w").alias("__w"))
    met = ready.join(known, (F.col("city") == F.col("__city")) & (F.col("detid") == F.col("__detid")), "left")
    done = met.withColumn("__got", _filler(m)(*(F.col(f"__{c}") for c in ("hour", "weekend", "x", "y", "a", "b", "w"))))
    done = done.withColumns({c: F.when(F.col(f"__no_{c}"), F.col(f"__got.{c}")).otherwise(F.col(c)) for c in ("flow", "occ")})
    marks = {f"{c}_filled": F.col(f"__no_{c}") & F.col(c).isNotNull() for c in FIELDS}
    left = F.array_compact(F.array(*(F.when(F.col(f"__no_{c}") & F.col(c).isNull(), F.lit(c)) for c in FIELDS)))
    return whole.unionByName(done.withColumns({**marks, "unfilled": left}).select(*whole.columns))


def unusable(rows: DataFrame) -> DataFrame:
    """(obs_id, field) of each cell that had no usable value, filled or not."""
    cells = F.concat(F.array_compact(F.array(*(F.when(F.col(f"{c}_filled"), F.lit(c)) for c in FIELDS))), F.col("unfilled"))
    some = F.col("flow_filled") | F.col("occ_filled") | F.col("detid_filled") | (F.size("unfilled") > 0)
    return rows.select("obs_id", F.explode(F.when(some, cells)).alias("field"))  # no arrays are built for complete rows


def held_out(raw: DataFrame, every: int = 25, classes: int = 12, steps: int = 60) -> DataFrame:
    """How well cells are filled whose values are known: (field, n, error, plain_error), over all rows.

    One usable cell in `every`, by a hash of obs_id, is taken away before the fill. flow, occ: median of the absolute difference of logarithms (of flow + 5, occ + 0.005), and that of the city's
    median value. detid: share of wrong names, and that of the city's most frequent name.
    """
    h = F.pmod(F.xxhash64("obs_id"), F.lit(every))
    usable = {c: (has_word if c == "detid" else has_number)(F.col(c)) for c in FIELDS}
    taken = {c: (h == i) & usable[c] & F.col("city").isNotNull() for i, c in enumerate(FIELDS)}
    truth = {f"__true_{c}": F.when(taken[c], F.col(c)) for c in FIELDS}
    got = filled(raw.withColumns(truth).withColumns({c: F.when(~F.coalesce(h == i, F.lit(False)), F.col(c)) for i, c in enumerate(FIELDS)}), classes, steps)
    off = {"flow": FLOW_OFF, "occ": OCC_OFF}
    plain = raw.where("city is not null").groupBy("city").agg(*(F.percentile_approx(F.when(usable[c] & ~taken[c], F.col(c)), 0.5).alias(f"__plain_{c}") for c in off))
    # The most frequent name by counts, so that no city's names come together row by row.
    names = raw.where(usable["detid"] & ~taken["detid"] & F.col("city").isNotNull()).groupBy("city", "detid").agg(F.count("*").alias("n")).groupBy("city").agg(F.max_by("detid", F.struct("n", "detid")).alias("__plain_detid"))
    met = got.where(F.coalesce(*(F.col(c).cast("string") for c in truth)).isNotNull()).join(plain, "city").join(names, "city", "left")
    log = lambda c, f: F.log(F.greatest(c, F.lit(0.0)) + off[f])
    gap = lambda a, f: F.when(F.col(f"__true_{f}") >= 0, F.abs(log(F.col(a), f) - log(F.col(f"__true_{f}"), f)))
    wrong = lambda a: F.when(F.col("__true_detid").isNotNull(), (~F.col(a).eqNullSafe(F.col("__true_detid"))).cast("double"))
    sides = {**{f: (gap(f, f), gap(f"__plain_{f}", f), lambda c: F.percentile_approx(c, 0.5)) for f in off}, "detid": (wrong("detid"), wrong("__plain_detid"), F.avg)}
    one = met.agg(*(F.struct(F.lit(f).alias("field"), F.count(a).alias("n"), agg(a).alias("error"), agg(b).alias("plain_error")).alias(f) for f, (a, b, agg) in sides.items()))
    return one.select(F.inline(F.array(*sides)))
