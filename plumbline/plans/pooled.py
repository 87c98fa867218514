"""SQL that searches eight pooled models on its own: every face of every kept set solved by elimination, the searches replayed over a table of all sets."""

from __future__ import annotations

POOLS = 8
ALL = (1 << POOLS) - 1


def eliminated(source: str, key: str, pivots: int, prefix: str) -> tuple[str, str]:
    """CTEs that solve many linear systems at once by Gauss-Jordan steps, and the name of the last.

    source has rows (key, i, j, v), j from 100 on being right-hand sides; a system without row p skips that step.
    """
    steps, last = [], source
    for p in range(pivots):
        now = f"{prefix}{p}"
        steps.append(
            f"{now} as materialized (select m.{key}, m.i, m.j, case when d.v is null then m.v when m.i = {p} then m.v / d.v else m.v - c.v * r.v / d.v end as v from {last} m "
            f"left join {last} d on d.{key} = m.{key} and d.i = {p} and d.j = {p} left join {last} r on r.{key} = m.{key} and r.i = {p} and r.j = m.j left join {last} c on c.{key} = m.{key} and c.i = m.i and c.j = {p})"
        )
        last = now
    return ",\n".join(steps), last


def pooled_searches(gammas: tuple[float, ...], settle) -> str:
    steps, solved = eliminated("m", "f", POOLS, "gj")
    has = lambda s, i: f"(({s} >> {i}) & 1) = 1"
    g = lambda a, b, n: f"join g {n} on {n}.i = {a} and {n}.j = {b}"
    listed = lambda s: f"array_to_string(list_filter(range({POOLS}), lambda i: (({s} >> i) & 1) = 1), ',')"
    return f"""with recursive
y as materialized (select split, query_id, (model_idx % {POOLS})::int as i, avg(y) as y from responses group by all),
g as materialized (select a.i, b.i as j, sum(a.y * b.y) as g from y a join y b using (split, query_id) where split = 'fit' group by all),
b8 as (select unnest(range({POOLS}))::int as i),
faces as (select f::int as f, list_min(list_filter(range({POOLS}), lambda i: ((f >> i) & 1) = 1))::int as b from range(1, {ALL + 1}) t(f)),
inner_ as (select f, b, i from faces, b8 where {has('f', 'i')} and i <> b),
m as materialized (
  select x.f, x.i, z.i as j, ij.g - ib.g - bj.g + bb.g as v from inner_ x join inner_ z on z.f = x.f {g('x.i', 'z.i', 'ij')} {g('x.i', 'x.b', 'ib')} {g('x.b', 'z.i', 'bj')} {g('x.b', 'x.b', 'bb')}
  union all select x.f, x.i, 100 + t.i, it.g - ib.g - bt.g + bb.g from inner_ x join b8 t on not ({has('x.f', 't.i')}) {g('x.i', 't.i', 'it')} {g('x.i', 'x.b', 'ib')} {g('x.b', 't.i', 'bt')} {g('x.b', 'x.b', 'bb')}),
{steps},
wt as materialized (
  select f, i, j - 100 as t, v as w from {solved} where j >= 100
  union all select f, b, t.i, 1 - coalesce((select sum(v) from {solved} s where s.f = faces.f and s.j = 100 + t.i), 0) from faces join b8 t on not ({has('f', 't.i')})),
good as (select f, t from wt group by f, t having min(w) >= -1e-9),
left_ as (select a.f, a.t, any_value(tt.g) - 2 * any_value(l.s) + sum(a.w * b.w * ab.g) as v from good join wt a using (f, t) join wt b on b.f = a.f and b.t = a.t {g('a.i', 'b.i', 'ab')} {g('a.t', 'a.t', 'tt')}
  join (select f, t, sum(w * it.g) as s from wt {g('wt.i', 'wt.t', 'it')} group by f, t) l on l.f = a.f and l.t = a.t group by a.f, a.t),
best as materialized (select s::int as s, t, min_by(f, (v, f)) as f from range(1, {ALL}) q(s) join left_ on (f & s) = f and not ({has('s', 't')}) group by s, t),
mixed as (select a.f, a.t, e.query_id, sum(a.w * e.y) as y from wt a join (select distinct f, t from best) using (f, t) join y e on e.split = 'eval' and e.i = a.i group by all),
u as (select m.f, m.t, avg(abs(m.y - e.y)) as u from mixed m join y e on e.split = 'eval' and e.query_id = m.query_id and e.i = m.t group by m.f, m.t),
es as materialized (select s, max(u) as e, sum(u) as su from best join u using (f, t) group by s union all select {ALL}, 0, 0 union all select 0, 'inf'::double, 'inf'::double),
gam as (select unnest([{', '.join(map(str, gammas))}])::double as gamma),
adds as materialized (select a.s, min_by(i, (b.e, i)) as j from es a join b8 on not ({has('a.s', 'i')}) join es b on b.s = (a.s | (1 << i)) group by a.s),
cuts as materialized (select a.s, min_by(i, (b.e, i)) as j from es a join b8 on {has('a.s', 'i')} join es b on b.s = (a.s - (1 << i)) group by a.s),
fw(gamma, k, j, s) as (select gamma, 0, null::int, 0 from gam union all
  select gamma, k + 1, a.j, fw.s | (1 << a.j) from fw join es on es.s = fw.s join adds a on a.s = fw.s where fw.s = 0 or es.e > gamma),
bw(gamma, k, j, s) as (select gamma, 0, null::int, {ALL} from gam union all
  select gamma, k + 1, c.j, bw.s - (1 << c.j) from bw join cuts c on c.s = bw.s join es on es.s = bw.s - (1 << c.j) where es.e <= gamma and es.e < 'inf'::double),
first as (select gamma, a.j, (1 << a.j) as s, es.e from gam join adds a on a.s = 0 join es on es.s = (1 << a.j)),
heap0 as (select gamma, first.j, first.s, first.e, list({{'g': b.e - first.e, 't': t, 'j': i, 'st': 0}}) as h
  from first join (select gamma as g2, i, row_number() over (partition by gamma order by i) - 1 as t from first join b8 on i <> j) o on o.g2 = gamma join es b on b.s = (first.s | (1 << i)) group by all),
lz(gamma, n, k, j, s, rnd, tick, h, done) as (select gamma, 0, 1, j, s, 0, {POOLS - 1}, h, e <= gamma from heap0 union all
  select gamma, n + 1, case when top.st = rnd then k + 1 else k end, case when top.st = rnd then top.j end, case when top.st = rnd then (cur | (1 << top.j)) else cur end, case when top.st = rnd then rnd + 1 else rnd end,
    case when top.st = rnd then tick else tick + 1 end, case when top.st = rnd then rest else list_append(rest, {{'g': b.e - a.e, 't': tick::bigint, 'j': top.j, 'st': rnd}}) end, case when top.st = rnd then b.e <= gamma else false end
  from (select gamma, n, k, s as cur, rnd, tick, list_sort(h)[1] as top, list_sort(h)[2:] as rest from lz where not done and len(h) > 0) x join es a on a.s = cur join es b on b.s = (cur | (1 << top.j))),
grown as (select gamma, max(k) as k, max_by(s, n) as s from lz group by gamma),
cl(gamma, k, j, s) as (select gamma, k, null::int, s from grown union all
  select gamma, k + 1, d.j, s - (1 << d.j) from (select cl.gamma, cl.k, cl.s, (select min(i) from b8 join es on es.s = cl.s - (1 << i) where {has('cl.s', 'i')} and es.e <= cl.gamma) as j from cl) d where d.j is not null),
told as (
  select gamma, 'forward_selection' as algorithm, k as iteration, 'add' as action, j, s from fw where k > 0
  union all select gamma, 'forward_selection', max(k) + 1, 'stop', null, max_by(s, k) from fw group by gamma
  union all select gamma, 'backward_elimination', k, 'remove', j, s from bw where k > 0
  union all select gamma, 'backward_elimination', max(k) + 1, 'stop', null, max_by(s, k) from bw group by gamma
  union all select gamma, 'priority_queue', k, 'add', j, s from lz where j is not null
  union all select gamma, 'priority_queue', k, 'remove', j, s from cl where j is not null
  union all select gamma, 'priority_queue', max(k) + 1, 'stop', null, max_by(s, k) from cl group by gamma)
select gamma, algorithm, iteration::int as iteration, action, j::int as model_idx, {listed('told.s')} as kept, {settle('e')} as coverage, {settle('su')} as sum_uniqueness from told join es on es.s = told.s"""
