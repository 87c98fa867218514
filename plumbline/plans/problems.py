"""Queries of the general data problems, p1 and p3 to p7, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.values import NO_VALUE_CODES, NO_VALUE_WORDS
from plumbline.operators.grid import regular_grid
from plumbline.operators.impute import filled, held_out, unusable
from plumbline.operators.keyed import heavy_keys, key_totals
from plumbline.operators.rolling import rolling_totals
from plumbline.operators.spikes import FLOW, OCC, RUN, Limits, implausible
from plumbline.sources.rejects import DATE, FIELD, NUMBER, SOUND_QUOTES, accepted, rejected
from plumbline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
PLACES = 4
WIDE = 2000


def settled(c: Column) -> Column:
    """Rounded to PLACES, halves up even after sums in another order."""
    return F.floor(c * 10**PLACES + 0.500001) / 10**PLACES


def _round(x: str) -> str:
    return f"floor(({x}) * {10**PLACES} + 0.500001) / {10**PLACES}"


def settle_all(t: DataFrame) -> DataFrame:
    return t.select(*(settled(F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes))


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    return filled(table(spark, d, "utd19_u"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unusable(p1_filled(spark, d))


def p1_held_out(spark: SparkSession, d: str) -> DataFrame:
    """How far filled cells are from values that were taken away."""
    return held_out(table(spark, d, "utd19_u"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid_raw(spark, d).where("n_readings = 0").select("city", "detid", "day_key", "slot")


def p3_grid_raw(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "utd19_u"), table(spark, d, "utd19_detectors"))


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return settle_all(p3_grid_raw(spark, d))


def p3_grid_wide(spark: SparkSession, d: str) -> DataFrame:
    """The last observation carried over up to WIDE steps, which is more than a day has."""
    return settle_all(regular_grid(table(spark, d, "utd19_u"), table(spark, d, "utd19_detectors"), max_gap=WIDE))


def p4_rolling_raw(spark: SparkSession, d: str) -> DataFrame:
    return rolling_totals(table(spark, d, "utd19_u"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_rolling_raw(spark, d).where("n_day = 0").select("city", "detid", "day_key")


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    return settle_all(p4_rolling_raw(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(table(spark, d, "utd19_raw"))


def p5_readings(spark: SparkSession, d: str) -> DataFrame:
    """The sound records; day is shown as text here, as everywhere where SQL states the same."""
    return accepted(table(spark, d, "utd19_raw")).withColumn("day", F.col("day").cast("string"))


def p6_flags(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "utd19_u"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_flags(spark, d).select("obs_id")


def p6_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Cells flagged as impossible."""
    return _flagged(spark, d, "bounds")


def p6_stuck(spark: SparkSession, d: str) -> DataFrame:
    """Cells flagged as stuck at another value than 0."""
    return _flagged(spark, d, "stuck").join(table(spark, d, "utd19_u").select("obs_id", F.col("flow").alias("__f"), F.col("occ").alias("__o")), "obs_id").where("case field when 'flow' then __f else __o end <> 0").select("obs_id", "field")


def _flagged(spark: SparkSession, d: str, flag: str) -> DataFrame:
    fields = F.array(*(F.when(F.col(f"{c}_flag") == flag, F.lit(c)) for c in ("flow", "occ")))
    return p6_flags(spark, d).select("obs_id", F.explode(F.array_compact(fields)).alias("field"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "utd19_u"))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    return settle_all(key_totals(table(spark, d, "utd19_u")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_filled, p1_held_out, p3_found, p3_grid, p3_grid_wide, p4_found, p4_rolling, p5_found, p5_readings, p6_found, p6_flags, p6_bounds, p6_stuck, p7_found, p7_totals)}

# --- the same as SQL ---

CODES = ", ".join(f"{c:g}" for c in NO_VALUE_CODES)
WORDS = ", ".join(f"'{w}'" for w in NO_VALUE_WORDS)


def _ok(c: str) -> str:
    return f"coalesce(isfinite({c}) and {c} not in ({CODES}), false)"


_WORD = f"coalesce(lower(regexp_replace(detid, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')) not in ({WORDS}), false)"
_READ = f"""
reads as (
  select city, detid, (day - date '1970-01-01')::int + floor("interval" / 86400)::int as day_no, "interval" - floor("interval" / 86400) * 86400 as sec,
    case when {_ok('flow')} then flow end as flow, case when {_ok('occ')} then occ end as occ, loaded_at, obs_id
  from utd19_u where city is not null and day is not null and coalesce(isfinite("interval"), false) and {_WORD}),
latest as (select * from reads qualify row_number() over (partition by city, detid, day_no, sec order by loaded_at desc, obs_id desc) = 1)"""
_KEY = lambda d: f"(year({d}) * 10000 + month({d}) * 100 + day({d}))::int"
_DATE = lambda n: f"(date '1970-01-01' + {n}::int)"
_GRID = f"""
steps as (select city, detid, step_s, 86400 // step_s as n_slots from utd19_detectors where step_s > 0 and 86400 % step_s = 0),
placed as (select l.*, day_no::bigint * n_slots + floor(sec / step_s)::bigint as pos, n_slots from latest l join steps using (city, detid)),
bucket as (select city, detid, pos, n_slots, count(*) as n, avg(flow) as v from placed group by all),
grid as (select city, detid, n_slots, unnest(range(min(pos), max(pos) + 1)) as pos from bucket group by city, detid, n_slots),
held as (select g.city, g.detid, g.pos, g.n_slots, b.n, b.v,
    last_value(b.v ignore nulls) over w as last_v, last_value(case when b.v is not null then g.pos end ignore nulls) over w as last_pos
  from grid g left join bucket b on b.city = g.city and b.detid = g.detid and b.pos = g.pos
  window w as (partition by g.city, g.detid order by g.pos rows unbounded preceding))"""


def _rolling() -> str:
    one = lambda c, p: f"coalesce(sum({c}) filter (where at_day - day_no < {p}), 0)"
    cols = [f"{one('n', 1)}::bigint as n_day", *(f"{one('n', p)}::bigint as n_{p}d" for p in (7, 30))]
    for v in ("flow", "occ"):
        for p in (7, 30):
            cols += [f"{_round(one(v + '_s', p) + '::double')} as {v}_sum_{p}d", f"{_round(one(v + '_s', p) + ' / nullif(' + one(v + '_n', p) + ', 0)')} as {v}_avg_{p}d"]
    return f"""with {_READ},
daily as (select city, detid, day_no, count(*) as n, count(flow) as flow_n, sum(flow) as flow_s, count(occ) as occ_n, sum(occ) as occ_s from latest group by all),
calendar as (select city, detid, unnest(range(min(day_no), max(day_no) + 1))::int as at_day from daily group by city, detid)
select c.city, c.detid, {_KEY(_DATE('at_day'))} as day_key, {', '.join(cols)}
from calendar c left join daily d on d.city = c.city and d.detid = c.detid and d.day_no between c.at_day - 29 and c.at_day group by c.city, c.detid, at_day"""


def _key_totals() -> str:
    parts = []
    stats = ", ".join(
        f"count({v})::bigint as {v}_n, {_round(f'coalesce(sum({v}), 0.0)::double')} as {v}_sum, {_round(f'avg({v})')} as {v}_avg, {_round(f'min({v})')} as {v}_min, {_round(f'max({v})')} as {v}_max"
        for v in ("flow", "occ")
    )
    for k in ("city", "detid"):
        usable = _WORD.replace("detid", k)
        parts.append(f"select '{k}' as field, {k} as key_value, count(*)::bigint as n_rows, (select count(*) from utd19_u)::bigint as all_rows, {stats} from held where {usable} group by {k}")
    return f"with held as (select city, detid, case when {_ok('flow')} then flow end as flow, case when {_ok('occ')} then occ end as occ from utd19_u) " + " union all ".join(parts)


_LINE = "regexp_replace(coalesce(line, ''), '\\r$', '')"
_field = lambda k: f"regexp_extract(s, '(?s)^{(FIELD + ',') * k}({FIELD})', 1)"
_num = lambda c, least: f"coalesce(regexp_full_match({c}, '{NUMBER}') and isfinite(try_cast(trim({c}, ' \t') as double)) and try_cast(trim({c}, ' \t') as double) >= {least}, false)"
_text_of = lambda x: f"nullif({x}, '')"
_num_of = lambda x: f"try_cast(trim({x}, ' \t') as double)"
_P5 = f"""with l as (select line_id, {_LINE} as s from utd19_raw),
c as (select line_id, s, regexp_full_match(s, '{SOUND_QUOTES}') as quotes, length(regexp_replace(s, '(?s)"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(s, '(?s)"(?:[^"]|"")*"', '', 'g'), ',', '')) + 1 as n,
    list_transform([{', '.join(map(_field, range(8)))}], lambda x: case when x like '"%' then replace(x[2:-2], '""', '"') else x end) as f from l),
r as (select line_id, f, case when not quotes then 'quoting' when n <> 8 then 'columns'
    when not (regexp_full_match(f[1], '{DATE}') and try_cast(f[1] as date) is not null and {_num('f[2]', '0')} and (f[4] = '' or {_num('f[4]', "'-infinity'::double")}) and (f[5] = '' or {_num('f[5]', "'-infinity'::double")})) then 'values' end as reason from c)"""



def _stuck(c: str, lim: Limits) -> str:
    """Runs of one value over RUN or more successive instants, the first version sent of each instant standing for it."""
    return f"""(with v as (select obs_id, city, detid, epoch(day::timestamp) + "interval" as t, {c} as v from utd19_u where city is not null and day is not null and coalesce(isfinite("interval"), false) and {_WORD} and {_ok(c)} and {c} between {lim.low} and {lim.high}),
lead as (select * from v qualify row_number() over (partition by city, detid, t order by obs_id) = 1),
step as (select *, coalesce(v <> lag(v) over w, true)::int as new from lead window w as (partition by city, detid order by t)),
run as (select *, sum(new) over (partition by city, detid order by t rows unbounded preceding) as r from step),
long as (select city, detid, t, v from run qualify count(*) over (partition by city, detid, r) >= {RUN})
select v.obs_id, '{c}' as field from v join long l on l.city = v.city and l.detid = v.detid and l.t = v.t and l.v = v.v where v.v <> 0)"""


def _grid(max_gap: int) -> str:
    return f"""with {_READ}, {_GRID} select city, detid, {_KEY(_DATE('(pos // n_slots)'))} as day_key, (pos % n_slots)::int as slot, coalesce(n, 0)::bigint as n_readings,
  {_round(f'case when v is not null then v when pos - last_pos <= {max_gap} then last_v end')} as flow,
  case when v is not null then 'observed' when pos - last_pos <= {max_gap} then 'carried' else 'missing' end as state from held"""


SQL: dict[str, str] = {
    "p1_found": f"select obs_id, 'flow' as field from utd19_u where not {_ok('flow')} union all select obs_id, 'occ' from utd19_u where not {_ok('occ')} union all select obs_id, 'detid' from utd19_u where not {_WORD}",
    "p3_found": f"with {_READ}, {_GRID} select city, detid, {_KEY(_DATE('(pos // n_slots)'))} as day_key, (pos % n_slots)::int as slot from held where n is null",
    "p3_grid": _grid(3),
    "p3_grid_wide": _grid(WIDE),
    "p4_found": f"""with {_READ}, days as (select distinct city, detid, day_no from latest),
calendar as (select city, detid, unnest(range(min(day_no), max(day_no) + 1))::int as day_no from days group by city, detid)
select city, detid, {_KEY(_DATE('day_no'))} as day_key from calendar anti join days using (city, detid, day_no)""",
    "p4_rolling": _rolling(),
    "p5_found": f"{_P5} select line_id, reason from r where reason is not null",
    "p5_readings": f"""{_P5} select r.line_id, file_name, line_no, strftime(try_cast(f[1] as date), '%Y-%m-%d') as day, {_num_of('f[2]')} as "interval", {_text_of('f[3]')} as detid, {_num_of('f[4]')} as flow, {_num_of('f[5]')} as occ, {_num_of('f[6]')} as error, {_text_of('f[7]')} as city, {_num_of('f[8]')} as speed
  from r join utd19_raw using (line_id) where reason is null""",
    "p6_bounds": " union all ".join(f"select obs_id, '{c}' as field from utd19_u where {_ok(c)} and ({c} < {lim.low} or {c} > {lim.high})" for c, lim in (("flow", FLOW), ("occ", OCC))),
    "p6_stuck": " union all ".join(_stuck(c, lim) for c, lim in (("flow", FLOW), ("occ", OCC))),
    "p7_found": " union all ".join(f"select '{k}' as field, {k} as key_value from utd19_u where {_WORD.replace('detid', k)} group by {k} having count(*) * 20 >= (select count(*) from utd19_u)" for k in ("city", "detid")),
    "p7_totals": _key_totals(),
}
