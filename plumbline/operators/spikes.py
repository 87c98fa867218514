"""Implausible readings: impossible values, sudden spikes, stuck values.

Hampel filter on series with a daily shape. The residual of a reading is its logarithm less the median of its own detector at that time of day (on
weekdays or at weekends). Over the series of residuals runs a window of HALF readings on either side; a residual further from the
window's median than WIDTHS times its scale (1.4826 * MAD, at least a fixed width) is a candidate. An exact check follows: one or two readings that stand
out from those next to them by the fixed width are a spike, a slope is not. Stuck values are runs of one value, which the window leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import NO_VALUE_CODES, has_number
from plumbline.operators.readings import DAY_S, is_reading

HALF, WIDTHS = 5, 3.0
#: Detectors with more readings than this, and than one in MOST_HOT of all, are cut into slices of time of about so many readings.
PIECE_ROWS, MOST_HOT = 50_000, 10_000
#: Instants at a slice's ends that are judged together with the neighbouring slice.
ZONE = 16
BLOCK_ROWS = 150_000
LEVEL_BIN = 0.02


@dataclass(frozen=True)
class Limits:
    """What a measurement can be, and how far it must stand out.

    low, high: beyond them impossible. offset: added before taking logarithms, the size below which differences mean nothing.
    up, down: the fixed width, by which a reading must exceed (fall below) the readings around it; level: below this a rise must be
    as large as a fall, for short queues double or treble a low reading. extreme: a rise to here of one or two readings above level is a spike
    even where too little is known of the detector to compare.
    """

    low: float
    high: float
    offset: float
    up: float
    down: float
    level: float = 0.0
    extreme: float = float("inf")


FLOW = Limits(low=0.0, high=12_000.0, offset=4.0, up=1.15, down=1.9)
OCC = Limits(low=0.0, high=1.0, offset=0.004, up=0.8, down=1.9, level=0.5, extreme=0.75)
#: A run of so many readings of one value is stuck; zeros are a rest where the flow usually is at most REST.
RUN, REST = 8, 15.0
OK, BOUNDS, SPIKE, STUCK = 0, 1, 2, 3
NAMES = (None, "bounds", "spike", "stuck")


def _medians(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and the median and count of x for each."""
    order = np.lexsort((x, keys))
    k, v = keys[order], x[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if k.size else np.zeros(0, int)
    n = np.diff(np.r_[first, k.size])
    return k[first], (v[first + (n - 1) // 2] + v[first + n // 2]) / 2, n


def _usual(levels: list[tuple[np.ndarray, list[np.ndarray], int]], x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each row the median of the known rows around it, by the first level where enough of them are.

    A level has each row's key, the keys a row is known under (several for windows that overlap), and how many rows are enough.
    """
    out = np.full(x.size, np.nan)
    for key, under, least in levels:
        open_ = np.flatnonzero(np.isnan(out))
        if not open_.size:
            break
        wanted = np.unique(key[open_])
        keys = np.concatenate([u[known] for u in under])
        at = np.minimum(np.searchsorted(wanted, keys), wanted.size - 1)
        use = wanted[at] == keys
        k, m, n = _medians(keys[use], np.tile(x[known], len(under))[use])
        if not k.size:
            continue
        at = np.minimum(np.searchsorted(k, key[open_]), k.size - 1)
        good = (k[at] == key[open_]) & (n[at] >= least)
        out[open_[good]] = m[at[good]]
    return out


def _levels(g: np.ndarray, t: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray], int]]:
    """From the half hour of weekdays or weekends to windows around the hour, and at last the whole series."""
    base = g.astype(np.int64)
    half = (t % DAY_S // 1800).astype(np.int64)
    hour = half // 2
    weekend = base * 2 + ((t // DAY_S + 3) % 7 >= 5)  # 1970-01-01 was a Thursday
    day = base * 24
    around = lambda w: [day + (hour + i) % 24 for i in range(-w, w + 1)]
    own = [(weekend * 48 + half, 4), (weekend * 24 + hour, 4), (day + hour, 3)]
    return [*((k, [k], n) for k, n in own), (day + hour, around(1), 3), (day + hour, around(2), 3), (base, [base], 1)]


def _shift(x: np.ndarray, g: np.ndarray, by: int) -> np.ndarray:
    """The value `by` places before (behind, if negative) within the group, else NaN."""
    out = np.full(x.size, np.nan)
    if abs(by) < x.size:
        if by > 0:
            same = g[by:] == g[:-by]
            out[by:][same] = x[:-by][same]
        else:
            same = g[:by] == g[-by:]
            out[:by][same] = x[-by:][same]
    return out


def _runs(g: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's run of one value, and the run's length."""
    new = np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])] if x.size else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    return run, np.bincount(run)[run] if x.size else run


def rolling_scale(g: np.ndarray, x: np.ndarray, half: int = HALF) -> tuple[np.ndarray, np.ndarray]:
    """Median, and 1.4826 times the median absolute deviation from it, of the window of `half` places on either side within the group."""

    def middle(a: np.ndarray) -> np.ndarray:
        a = np.sort(a, axis=1)  # NaN, beyond the group's ends, comes last
        n = np.isfinite(a).sum(1)
        at = np.arange(len(a))
        return (a[at, np.maximum(n - 1, 0) // 2] + a[at, np.minimum(n // 2, a.shape[1] - 1)]) / 2

    w = np.stack([_shift(x, g, k) if k else x for k in range(half, -half - 1, -1)], 1)
    m = middle(w)
    return m, 1.4826 * middle(np.abs(w - m[:, None]))


@dataclass
class Judged:
    """Of each row: its flag, what its detector usually shows at its time, the length of its run of one value, and if the window sees it."""

    flag: np.ndarray
    usual: np.ndarray
    length: np.ndarray
    calm: np.ndarray


def judge_field(g: np.ndarray, t: np.ndarray, v: np.ndarray, lim: Limits, usual_flow: np.ndarray | None, level: np.ndarray | None = None, length: np.ndarray | None = None) -> Judged:
    """One measurement judged.

    Rows must be sorted by group, instant and arrival. usual_flow decides if zeros are a rest; without it the measurement decides itself. level: logarithm of the
    usual value, where it is known beforehand. length: of the run of each row, where rows of it may be out of sight.
    """
    out = Judged(np.zeros(v.size, np.int8), np.full(v.size, np.nan), np.zeros(v.size, np.int64), np.zeros(v.size, bool))
    if level is not None:
        out.usual[:] = np.exp(level) - lim.offset
    held = np.isfinite(v) & ~np.isin(v, NO_VALUE_CODES)
    bad = held & ((v < lim.low) | (v > lim.high))
    out.flag[bad] = BOUNDS
    rows = np.flatnonzero(held & ~bad)
    if not rows.size:
        return out
    flags = out.flag
    rg, rt, rv = g[rows], t[rows], v[rows]
    lead = np.r_[True, (rg[1:] != rg[:-1]) | (rt[1:] != rt[:-1])]  # the first version sent of each instant stands for it
    inst = np.cumsum(lead) - 1
    sg, st, sv = rg[lead], rt[lead], rv[lead]

    run, size = _runs(sg, sv)
    if length is not None:
        longest = np.zeros(run[-1] + 1, np.int64)
        np.maximum.at(longest, run, np.maximum(size, length[rows][lead]))
        size = longest[run]
    frozen = size >= RUN
    lv = np.log(sv + lim.offset)
    if level is None:
        usual = _usual(_levels(sg, st), lv, ~frozen)
        out.usual[rows] = (np.exp(usual) - lim.offset)[inst]
    else:
        usual = level[rows][lead]
    shown = np.exp(usual) - lim.offset

    rest = shown if usual_flow is None else usual_flow[rows][lead]
    most = np.full(run[-1] + 1, -np.inf)
    np.maximum.at(most, run, np.nan_to_num(rest, nan=-np.inf))
    frozen &= (sv != 0) | (most[run] > REST)
    flags[rows[frozen[inst] & (rv == sv[inst])]] = STUCK

    _, high = _runs(sg, (sv >= lim.level).astype(np.int8))
    brief = ~frozen & (sv >= lim.extreme) & (high <= 2)
    hit = rows[brief[inst] & (rv >= lim.extreme)]
    flags[hit[flags[hit] == OK]] = SPIKE
    out.length[rows], out.calm[rows] = size[inst], ~frozen[inst]

    calm = np.flatnonzero(~frozen)
    if calm.size:
        cg, r = sg[calm], (lv - usual)[calm]
        centre, scale = rolling_scale(cg, r)
        p1, p2, n1, n2 = (_shift(r, cg, i) for i in (1, 2, -1, -2))
        at = np.full(sg.size, -1)
        at[calm] = np.arange(calm.size)
        own = at[inst]  # place of each row's instant among the calm ones
        live = own >= 0
        o = own[live]
        mine = np.log(rv[live] + lim.offset) - usual[inst[live]]
        for sign, least in ((1, lim.up), (-1, lim.down)):
            fixed = np.where((sign < 0) | (rv[live] >= lim.level), least, max(lim.up, lim.down))
            hampel = sign * (mine - centre[o]) > WIDTHS * np.maximum(scale[o], fixed / WIDTHS)
            a1, a2, b1, b2, x = sign * p1[o], sign * p2[o], sign * n1[o], sign * n2[o], sign * mine
            alone = x - np.fmax(a1, b1) > fixed
            pair = (np.minimum(x, a1) - np.fmax(a2, b1) > fixed) | (np.minimum(x, b1) - np.fmax(a1, b2) > fixed)
            hit = rows[live][hampel & (alone | pair) & (x > 0.8 * fixed)]
            flags[hit[flags[hit] == OK]] = SPIKE
    return out


def judge(g: np.ndarray, t: np.ndarray, flow: np.ndarray, occ: np.ndarray, levels: tuple[np.ndarray, np.ndarray] | None = None, lengths: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Judged, Judged]:
    """Flow and occ judged; rows sorted by group, instant and arrival."""
    (lf, lo), (nf, no) = levels or (None, None), lengths or (None, None)
    f = judge_field(g, t, flow, FLOW, None, lf, nf)
    usual = f.usual
    if np.isnan(usual).any():  # rows whose flow is missing: the usual flow of their detector then
        usual = np.where(np.isnan(usual), _usual(_levels(g, t), usual, ~np.isnan(usual)), usual)
    return f, judge_field(g, t, occ, OCC, usual, lo, no)


# --- the same on Arrow batches ---

OUT = "h long, k int, slice long, part int, core boolean, pos long, obs_id long, t double, flow double, occ double, flow_level double, occ_level double, flow_run long, occ_run long, flow_flag string, occ_flag string"
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
OUT_KINDS = [KINDS[c.split()[1]] for c in OUT.split(", ")]
HIST_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]


def _groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[list[np.ndarray]]:
    """Whole groups, gathered to blocks of about `rows` rows; the input comes sorted by its first `keys` columns. Every row is copied once."""
    waiting: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        size += b.num_rows
        if size >= rows:
            other = np.zeros(b.num_rows, bool)
            for c in cols[:keys]:
                other |= c != c[-1]
            at = np.flatnonzero(other)
            cut = int(at[-1]) + 1 if at.size else 0
            ended = waiting and any(w[-1] != c[-1] for w, c in zip(waiting[-1][:keys], cols[:keys]))
            if cut or ended:
                yield [np.concatenate(c) for c in zip(*waiting, [c[:cut] for c in cols])]
                waiting, size, cols = [], b.num_rows - cut, [c[cut:] for c in cols]
        waiting.append(cols)
    if size:
        yield [np.concatenate(c) for c in zip(*waiting)]


def _changes(*cols: np.ndarray) -> np.ndarray:
    new = np.ones(cols[0].size, bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _flag_names(x: np.ndarray) -> pa.Array:
    return pa.array(np.array(NAMES, object)[x], pa.string())


def _edge(g: np.ndarray, t: np.ndarray, f: Judged, o: Judged) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of slices: the instant's number; how near the slice's ends it is (core: ZONE instants); if the ends' rows need it beside them.

    Those are twice as many instants, and as many of those the windows see, should a long run lie between.
    """
    first = _changes(g)
    lead = first | (np.r_[True, t[1:] != t[:-1]])
    inst = np.cumsum(lead) - 1
    start = np.maximum.accumulate(np.where(first, inst, 0))
    n = np.bincount(np.cumsum(first) - 1, lead)[np.cumsum(first) - 1].astype(np.int64)
    pos = inst - start
    core = np.minimum(pos, n - 1 - pos) < ZONE
    head, tail = pos < 2 * ZONE, n - 1 - pos < 2 * ZONE
    for calm in (f.calm, o.calm):
        seen = np.cumsum(calm)
        group = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        before = np.r_[0, seen][at][group]
        total = (np.r_[0, seen][np.r_[at[1:], calm.size]] - np.r_[0, seen][at])[group]
        rank = seen - before
        head |= calm & (rank <= 2 * ZONE)
        tail |= calm & (total - rank < 2 * ZONE)
    return pos, core, head + 2 * tail


def _judge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags of whole series and of the insides of slices (part 0), and the rows at the ends of slices."""
    for cols in _groups(batches, 3, BLOCK_ROWS):
        h, k, piece, hot, obs, t, flow, occ, lf, lo = cols
        order = np.lexsort((obs, t, piece, k, h))
        h, k, piece, hot, obs, t, flow, occ, lf, lo = (c[order] for c in (h, k, piece, hot, obs, t, flow, occ, lf, lo))
        hot = hot.astype(bool)
        for own in (~hot, hot):
            if not own.any():
                continue
            a = [c[own] for c in (h, k, piece, obs, t, flow, occ, lf, lo)]
            g = np.cumsum(_changes(*a[:3]))
            f, o = judge(g, a[4], a[5], a[6], (a[7], a[8]) if hot[own][0] else None)
            flagged = (f.flag > OK) | (o.flag > OK)
            pos, core, part = _edge(g, a[4], f, o) if hot[own][0] else (np.zeros(g.size, np.int64), np.zeros(g.size, bool), np.zeros(g.size, np.int64))
            for rows, as_part in ((np.flatnonzero(flagged & ~core), None), (np.flatnonzero(part > 0), part)):
                if rows.size:
                    p = np.zeros(rows.size, np.int64) if as_part is None else as_part[rows]
                    vals = [a[0], a[1], a[2], p, core, pos, a[3], a[4], a[5], a[6], a[7], a[8], f.length, o.length]
                    arrays = [pa.array(v if v is p else v[rows]) for v in vals] + [_flag_names(f.flag[rows]), _flag_names(o.flag[rows])]
                    yield pa.RecordBatch.from_arrays([x.cast(kind) for x, kind in zip(arrays, OUT_KINDS)], names=OUT_NAMES)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends of slices next to each other judged; the input comes sorted by part 0 or not, and detector."""
    names = ["obs_id", "flow_flag", "occ_flag"]

    def ends() -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = np.asarray(b.column(OUT_NAMES.index("part"))) == 0
            if done.any():
                ready.append(b.filter(pa.array(done)).select(names))
            if not done.all():
                yield b.filter(pa.array(~done)).select(OUT_NAMES[:-2])

    ready: list[pa.RecordBatch] = []
    for cols in _groups(ends(), 2, BLOCK_ROWS):
        while ready:
            yield ready.pop()
        h, k, piece, part, core, pos, obs, t, flow, occ, lf, lo, nf, no = cols
        order = np.lexsort((obs, t, k, h))
        h, k, piece, part, core, pos, obs, t, flow, occ, lf, lo, nf, no = (c[order] for c in (h, k, piece, part, core, pos, obs, t, flow, occ, lf, lo, nf, no))
        new = _changes(h, k)
        # Between the head and the tail of one slice lie rows that are settled.
        new[1:] |= (piece[1:] == piece[:-1]) & (part[:-1] == 1) & (part[1:] == 2)
        f, o = judge(np.cumsum(new), t, flow, occ, (lf, lo), (nf, no))
        hit = core.astype(bool) & ((f.flag > OK) | (o.flag > OK))
        yield pa.RecordBatch.from_arrays([pa.array(obs[hit]), _flag_names(f.flag[hit]), _flag_names(o.flag[hit])], names=names)
    while ready:
        yield ready.pop()


def _cell(t: np.ndarray) -> np.ndarray:
    """Weekday or weekend, and half hour: 0 to 95."""
    return (((t // DAY_S + 3) % 7 >= 5) * 48 + t % DAY_S // 1800).astype(np.int64)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of logarithms in narrow bins by cell of the week, runs of one value left out."""
    names = ["h", "k", "width", "field", "cell", "bin", "n"]
    for h, k, piece, width, obs, t, flow, occ in _groups(batches, 3, BLOCK_ROWS):
        order = np.lexsort((obs, t, piece, k, h))
        h, k, piece, width, obs, t, flow, occ = (c[order] for c in (h, k, piece, width, obs, t, flow, occ))
        one = np.flatnonzero(_changes(h, k))  # a row of no count, so that a detector without usable values is known as well
        key = np.stack([h[one], k[one].astype(np.int64), width[one], *np.zeros((3, one.size), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(x) for c, x in zip((*key, np.zeros(one.size, np.int64)), HIST_KINDS)], names=names)
        for which, v, lim in ((0, flow, FLOW), (1, occ, OCC)):
            rows = np.flatnonzero(np.isfinite(v) & ~np.isin(v, NO_VALUE_CODES) & (v >= lim.low) & (v <= lim.high))
            rows = rows[_changes(h[rows], k[rows], piece[rows], t[rows])] if rows.size else rows
            if not rows.size:
                continue
            g = np.cumsum(_changes(h[rows], k[rows], piece[rows]))
            calm = rows[_runs(g, v[rows])[1] < RUN]
            if not calm.size:
                continue
            key = np.stack([h[calm], k[calm].astype(np.int64), width[calm], np.full(calm.size, which), _cell(t[calm]), np.floor(np.log(v[calm] + lim.offset) / LEVEL_BIN).astype(np.int64)])
            u, n = np.unique(key, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(x) for c, x in zip((*u, n), HIST_KINDS)], names=names)


def cell_levels(cell: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The usual value of each of the 96 cells of the week: the median of the first of _levels' circles that holds enough."""
    out = np.full(96, np.nan)
    order = np.argsort(value, kind="stable")
    cell, value, n = cell[order], value[order], n[order]
    weekend, hour = cell // 48, cell % 48 // 2
    for c in range(96):
        e, hr = c // 48, c % 48 // 2
        far = np.minimum((hour - hr) % 24, (hr - hour) % 24)
        for here, least in ((cell == c, 4), ((weekend == e) & (hour == hr), 4), (far == 0, 3), (far <= 1, 3), (far <= 2, 3), (far >= 0, 1)):
            w = np.cumsum(n[here])
            if w.size and w[-1] >= least:
                x = value[here]
                out[c] = (x[np.searchsorted(w, (w[-1] + 1) // 2)] + x[np.searchsorted(w, w[-1] // 2 + 1)]) / 2
                break
    return out


def _level_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        out: tuple[list, list] = ([], [])
        for i in range(b.num_rows):
            s = lists[i].values
            which, cell, at, n = (np.asarray(s.field(c)) for c in ("field", "cell", "bin", "n"))
            for f in (0, 1):
                own = (which == f) & (n > 0)
                out[f].append(cell_levels(cell[own].astype(np.int64), (at[own] + 0.5) * LEVEL_BIN, n[own]).tolist())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out[0], pa.list_(pa.float64())), pa.array(out[1], pa.list_(pa.float64()))], names=["h", "k", "width", "flow_levels", "occ_levels"])


def _hot(series: DataFrame) -> DataFrame:
    """(h, k, width): the detectors with most readings, at most MOST_HOT of those with more than PIECE_ROWS, and the seconds of a slice by the busiest day.

    Any other detector has at most PIECE_ROWS readings, or one in MOST_HOT of all.
    """
    days = series.groupBy("h", "k", F.floor(F.col("t") / DAY_S).alias("day")).agg(F.count("*").alias("n"))
    per = days.groupBy("h", "k").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    width = F.greatest(F.floor(F.lit(float(PIECE_ROWS) * DAY_S) / F.col("most")), F.lit(1)).cast("long")
    return per.where(F.col("n") > PIECE_ROWS).orderBy(F.desc("n"), "h", "k").limit(MOST_HOT).select("h", "k", width.alias("width"))


def implausible(raw: DataFrame) -> DataFrame:
    """(obs_id, flow_flag, occ_flag) of each row of readings whose flow or occ cannot be true; the flag is bounds, spike or stuck, else null.

    A detector's series is judged whole, in one group of at most PIECE_ROWS readings (or one in MOST_HOT of all, if that is more). The few detectors with more, at most MOST_HOT, are cut
    into slices of time: what they usually show comes from counts in bins over all slices, and the ends of each slice are judged once more together with those of its
    neighbours, however long the gap between, so windows and runs know no borders. (Of zeros that reach over the end of a slice each slice decides by itself if they
    are a rest.) Rows have fixed width; two independent hashes stand for the detector, together 96 bits.

    Null, non-finite and coded cells are never flagged. Rows without city, detid, day or interval have no series and are only tested against the
    bounds. Copies of a flagged reading with the same value are flagged as well. Empty input: empty output.
    """
    cells = [F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in ("flow", "occ")]
    series = raw.where(is_reading()).select(
        F.xxhash64("city", "detid").alias("h"), F.hash("detid", "city").alias("k"), "obs_id", (F.unix_date(F.col("day").cast("date")) * float(DAY_S) + F.col("interval")).alias("t"), *cells
    )
    hot = F.broadcast(_hot(series.select("h", "k", "t")))
    piece = F.floor(F.col("t") / F.col("width")).cast("long")
    cut = series.join(hot, ["h", "k"]).select("h", "k", piece.alias("slice"), "width", "obs_id", "t", "flow", "occ").repartition("h", "k", "slice").sortWithinPartitions("h", "k", "slice")
    counts = cut.mapInArrow(_histograms, "h long, k int, width long, field int, cell int, bin int, n long").groupBy("h", "k", "width", "field", "cell", "bin").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("h", "k", "width").agg(F.collect_list(F.struct("field", "cell", "bin", "n")).alias("counts"))
    levels = packed.mapInArrow(_level_rows, "h long, k int, width long, flow_levels array<double>, occ_levels array<double>")

    weekend = F.pmod(F.floor(F.col("t") / DAY_S) + 3, F.lit(7)) >= 5
    cell = (weekend.cast("int") * 48 + F.floor(F.pmod(F.col("t"), F.lit(float(DAY_S))) / 1800)).cast("int")
    known: Column = F.col("width").isNotNull()
    level = lambda c: F.coalesce(F.get(c, cell), F.lit(float("nan"))).alias(c[:-1])
    rows = (
        series.join(F.broadcast(levels), ["h", "k"], "left")
        .select("h", "k", F.when(known, piece).otherwise(F.lit(0)).alias("slice"), known.alias("hot"), "obs_id", "t", "flow", "occ", level("flow_levels"), level("occ_levels"))
        .repartition("h", "k", "slice")
        .sortWithinPartitions("h", "k", "slice")
    )
    judged = rows.mapInArrow(_judge_blocks, OUT)
    end = F.col("part") > 0
    met = judged.withColumns({"__p": F.when(end, F.col("h")).otherwise(F.col("obs_id")), "__q": F.when(end, F.col("k")).otherwise(F.lit(0))}).repartition("__p", "__q").sortWithinPartitions(end, "h", "k").drop("__p", "__q")
    settled = met.mapInArrow(_settle, "obs_id long, flow_flag string, occ_flag string")
    beyond = lambda c, lim: F.when(has_number(F.col(c)) & ((F.col(c) < lim.low) | (F.col(c) > lim.high)), NAMES[BOUNDS])
    loose = raw.where(~is_reading()).select("obs_id", beyond("flow", FLOW).alias("flow_flag"), beyond("occ", OCC).alias("occ_flag")).where("flow_flag is not null or occ_flag is not null")
    return settled.unionByName(loose)
