"""DuckDB SQL with the results of the queries, written on its own: nested-loop joins and windows."""

from __future__ import annotations

from sphaera.catalog.queries import ATOM_NAMES, PLACES, RESIDUES

E, TAU, PI = "1e-10", "(2 * pi())", "pi()"

BALLS = """
base as (select cast(floor(p_partkey / 500) as bigint) as structure_id, p_partkey % 500 as ball_id, cast(p_partkey * 7919 % 997 as double) / 50 as x,
                cast(p_partkey * 104729 % 991 as double) / 50 as y, cast(p_partkey * 1299709 % 983 as double) / 50 as z, 1.2e0 + cast(p_size % 10 as double) / 10e0 as r from part),
balls as materialized (select * from base union all select structure_id, ball_id + 500, x + 1e-1, y, z, r * 3e-1 from base where ball_id % 50 = 0)"""


def _sq(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in "xyz") + ")"


def _contains(d2: str, outer: str, inner: str) -> str:
    return f"({outer} + {E} > {inner} and {d2} < ({outer} - {inner}) * ({outer} - {inner}) + {E})"


def geometry(select: str, box: float | tuple = 0, groups: bool | str = False, balls: str = BALLS, moved: bool = False, probe: str = "1.4e0") -> str:
    """Common table expressions of the whole computation, followed by a select."""
    x = "case when ball_id % 100 = 7 then x + 5e-1 else x end" if moved else "x"
    group = groups if isinstance(groups, str) else "cast(floor(ball_id / 10) as bigint)" if groups else "cast(null as bigint)"
    if box and not isinstance(box, tuple):
        box = ((box, 0, 0), (0, box, 0), (0, 0, box))
    shifted = ", ".join(f"{c} + i * {box[0][n]} + j * {box[1][n]} + k * {box[2][n]} as {c}" for n, c in enumerate("xyz")) if box else ""
    cube = "(select * from range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k))"
    images = (
        f"img as materialized (select s.structure_id, id, {shifted}, r, g, image from s, shift)"
        if box
        else "img as (select *, 0 as image from s)"
    )
    return f"""
with {balls},
s as materialized (select structure_id, ball_id as id, {x} as x, y, z, r + {probe} as r, {group} as g from balls),
shift as (select i, j, k, case when i = 0 and j = 0 and k = 0 then 0 else row_number() over (order by case when i = 0 and j = 0 and k = 0 then 1 else 0 end, i, j, k) end as image from {cube}),
{images},
o as materialized (select a.structure_id, a.id as a, a.x as ax, a.y as ay, a.z as az, a.r as ar, a.g as ag, b.id as b, b.x as b_x, b.y as b_y, b.z as b_z, b.r as br, b.g as bg, b.image,
      {_sq('a.', 'b.')} as d2 from s a join img b on a.structure_id = b.structure_id and (a.id <> b.id or b.image <> 0) and {_sq('a.', 'b.')} + {E} < (a.r + b.r) * (a.r + b.r)),
hid as materialized (select distinct structure_id, a from o where {_contains('d2', 'br', 'ar')}
      and (not (abs(ax - b_x) <= {E} and abs(ay - b_y) <= {E} and abs(az - b_z) <= {E} and abs(ar - br) <= {E}) or (image = 0 and a > b))),
n as materialized (select o.*, sqrt(d2) as d, (d2 + ar * ar - br * br) / (2 * sqrt(d2)) as h from o where not {_contains('d2', 'ar', 'br')} and (structure_id, a) not in (select structure_id, a from hid)),
pr as (select * from n where (image <> 0 or a < b) and not coalesce(ag = bg, false)),
u as (select *, ar * sqrt(greatest(0, 1 - (h / ar) * (h / ar))) as rr, (b_x - ax) / d as ux, (b_y - ay) / d as uy, (b_z - az) / d as uz from pr),
w as (select *, ax + ux * h as mx, ay + uy * h as my, az + uz * h as mz,
      case when abs(ux) <= abs(uy) and abs(ux) <= abs(uz) then 0.0::double when abs(uy) <= abs(uz) then -uz else uy end as qx,
      case when abs(ux) <= abs(uy) and abs(ux) <= abs(uz) then uz when abs(uy) <= abs(uz) then 0.0::double else -ux end as qy,
      case when abs(ux) <= abs(uy) and abs(ux) <= abs(uz) then -uy when abs(uy) <= abs(uz) then ux else 0.0::double end as qz from u where rr > 0),
e as (select *, qx / sqrt(qx * qx + qy * qy + qz * qz) as e1x, qy / sqrt(qx * qx + qy * qy + qz * qz) as e1y, qz / sqrt(qx * qx + qy * qy + qz * qz) as e1z from w),
disc as materialized (select *, uy * e1z - uz * e1y as e2x, uz * e1x - ux * e1z as e2y, ux * e1y - uy * e1x as e2z from e),
near as (select p.structure_id, p.a, p.b, p.image, p.rr, p.h, c.b as c, c.image as cimage, c.h as ch, {_contains('((c.b_x - p.b_x) * (c.b_x - p.b_x) + (c.b_y - p.b_y) * (c.b_y - p.b_y) + (c.b_z - p.b_z) * (c.b_z - p.b_z))', 'c.br', 'p.br')}
         or {_contains('c.d2', 'c.br', 'p.ar')} as swallowed,
      ((c.b_x - p.ax) * ux + (c.b_y - p.ay) * uy + (c.b_z - p.az) * uz) / c.d as k, ((c.b_x - p.ax) * e1x + (c.b_y - p.ay) * e1y + (c.b_z - p.az) * e1z) / c.d as v1,
      ((c.b_x - p.ax) * e2x + (c.b_y - p.ay) * e2y + (c.b_z - p.az) * e2z) / c.d as v2
      from disc p join n c on p.structure_id = c.structure_id and p.a = c.a and (p.b <> c.b or p.image <> c.image)
      and (c.b_x - p.b_x) * (c.b_x - p.b_x) + (c.b_y - p.b_y) * (c.b_y - p.b_y) + (c.b_z - p.b_z) * (c.b_z - p.b_z) + {E} < (p.br + c.br) * (p.br + c.br)
      and (c.b_x - p.mx) * (c.b_x - p.mx) + (c.b_y - p.my) * (c.b_y - p.my) + (c.b_z - p.mz) * (c.b_z - p.mz) + {E} < (p.rr + c.br) * (p.rr + c.br)),
lin as materialized (select *, h * k - ch as ss, case when sqrt(v1 * v1 + v2 * v2) >= 1e-12 then -(h * k - ch) / sqrt(v1 * v1 + v2 * v2) end as dist,
      case when sqrt(v1 * v1 + v2 * v2) >= 1e-12 then v1 / sqrt(v1 * v1 + v2 * v2) end as n1, case when sqrt(v1 * v1 + v2 * v2) >= 1e-12 then v2 / sqrt(v1 * v1 + v2 * v2) end as n2 from near),
dead as (select distinct structure_id, a, b, image from lin where swallowed or case when dist is null then ss > {E} else dist <= -rr end),
live as materialized (select disc.* from disc anti join dead using (structure_id, a, b, image)),
cut as materialized (select lin.* from lin semi join live using (structure_id, a, b, image) where dist < rr),
met as (select i.structure_id, i.a, i.b, i.image, i.c, i.cimage, i.ch, j.ch as jh, i.dist, i.n1, i.n2, sqrt(greatest(i.rr * i.rr - i.dist * i.dist, 0)) as half, j.c as jc, j.cimage as jimage,
      i.n1 * j.n2 - i.n2 * j.n1 as kappa, i.n1 * j.n1 + i.n2 * j.n2 as along, j.dist - (i.n1 * j.n1 + i.n2 * j.n2) * i.dist as gamma
      from cut i join cut j on i.structure_id = j.structure_id and i.a = j.a and i.b = j.b and i.image = j.image),
bnd as (select structure_id, a, b, image, c, cimage, ch, any_value(dist) as dist, any_value(n1) as n1, any_value(n2) as n2, any_value(half) as half,
      max(case when kappa <= -1e-11 then gamma / kappa end) as t_lo, min(case when kappa >= 1e-11 then gamma / kappa end) as t_hi,
      arg_max(jc, case when kappa <= -1e-11 then gamma / kappa end) as c_lo, arg_min(jc, case when kappa >= 1e-11 then gamma / kappa end) as c_hi,
      bool_or((c <> jc or cimage <> jimage) and abs(kappa) < 1e-11 and (gamma < -1e-11 or (gamma <= 1e-11 and along > 0 and (jh, jimage, jc) < (ch, cimage, c)))) as gone from met group by all),
piece as materialized (select *, greatest(-half, t_lo) as lo, least(half, t_hi) as hi, case when t_lo > -half then c_lo end as lo_by, case when t_hi < half then c_hi end as hi_by
      from bnd where not gone and least(half, t_hi) - greatest(-half, t_lo) > 1e-9),
span as (select structure_id, a, b, image, (atan2(n2, n1) - acos(dist / rr)) - {TAU} * floor((atan2(n2, n1) - acos(dist / rr)) / {TAU}) as st, 2 * acos(dist / rr) as wd from cut),
rel as (select *, st - min(st) over p as pos, st - min(st) over p + wd as en from span window p as (partition by structure_id, a, b, image)),
swp as (select *, max(en) over (partition by structure_id, a, b, image) as most, max(en) over (partition by structure_id, a, b, image order by pos, wd rows between unbounded preceding and 1 preceding) as before from rel),
gap as (select structure_id, a, b, image, pos - greatest(coalesce(before, wd), most - {TAU}) as len from swp union all select structure_id, a, b, image, {TAU} - max(most) from swp group by all),
arc as materialized (select structure_id, a, b, image, len from gap where len > 1e-9
      union all select structure_id, a, b, image, {TAU} from live anti join cut using (structure_id, a, b, image)),
arcs as (select structure_id, a, b, image, sum(len) as arc_sum from arc group by all),
pieces as (select structure_id, a, b, image, sum(dist * (hi - lo)) as inside, bool_and(dist >= 0) as central, count(*) as np from piece group by all),
wa as (select p.structure_id, p.a, p.b, p.image, p.dist, p.lo, p.hi, abs(l.h) as ha, abs(l.d - l.h) as hb from piece p join live l using (structure_id, a, b, image)),
wedge as (select structure_id, a, b, image,
      sum(2 * atan2(dist * (hi - lo), sqrt(dist * dist + lo * lo + ha * ha) * sqrt(dist * dist + hi * hi + ha * ha) + ha * (sqrt(dist * dist + lo * lo + ha * ha) + sqrt(dist * dist + hi * hi + ha * ha)) + dist * dist + lo * hi + ha * ha)) as wedge_a,
      sum(2 * atan2(dist * (hi - lo), sqrt(dist * dist + lo * lo + hb * hb) * sqrt(dist * dist + hi * hi + hb * hb) + hb * (sqrt(dist * dist + lo * lo + hb * hb) + sqrt(dist * dist + hi * hi + hb * hb)) + dist * dist + lo * hi + hb * hb)) as wedge_b
      from wa group by all),
con as materialized (select l.*, coalesce(arc_sum, 0) as arc_sum, coalesce(central, true) as central, 0.5 * (rr * rr * coalesce(arc_sum, 0) + coalesce(inside, 0)) as area,
      coalesce(wedge_a, 0) as wedge_a, coalesce(wedge_b, 0) as wedge_b from live l left join arcs using (structure_id, a, b, image) left join pieces using (structure_id, a, b, image) left join wedge using (structure_id, a, b, image)
      where 0.5 * (rr * rr * coalesce(arc_sum, 0) + coalesce(inside, 0)) > 1e-12 and (np is not null or arc_sum is not null)),
ful as (select structure_id, a, b, image, h, d, ar, br, area, rr * arc_sum as arc_length, central,
      sign(case when h < 0 then -1 else 1 end) * (arc_sum * (1 - abs(h) / ar) + wedge_a) as solid_angle_a, case when d - h < 0 then -1 else 1 end * (arc_sum * (1 - abs(d - h) / br) + wedge_b) as solid_angle_b,
      h * area / 3 as pyramid_volume_a, (d - h) * area / 3 as pyramid_volume_b from con),
half as (select structure_id, a as id, ar as r, area, arc_length, solid_angle_a as so, pyramid_volume_a as vo from ful union all
      select structure_id, b, br, area, arc_length, solid_angle_b, pyramid_volume_b from ful where image = 0),
sums as (select structure_id, id, sum(arc_length) as al, sum(so) as net, sum(vo) as inn from half group by all),
cell as materialized (select s.structure_id, s.id as index, case when sums.id is null then 4 * {PI} * r * r when seen then op else 0 end as sas_area,
      case when sums.id is null then 4 * {PI} * r * r * r / 3 when seen then op * r / 3 + inn else inn end as volume
      from s left join (select t.*, s2.r as rad, case when net > 0 then (4 * {PI} - net) * s2.r * s2.r else -net * s2.r * s2.r end as op,
           al > 0 and abs(net) > 1e-10 and case when net > 0 then (4 * {PI} - net) * s2.r * s2.r else -net * s2.r * s2.r end * s2.r / 3 + inn <= 4 * {PI} / 3 * s2.r * s2.r * s2.r as seen
           from sums t join s s2 on t.structure_id = s2.structure_id and t.id = s2.id) sums on s.structure_id = sums.structure_id and s.id = sums.id
      where sums.id is not null or (s.structure_id, s.id) not in (select structure_id, a from n))
{select}"""


def _r(*names: str, places: int = PLACES) -> str:
    return ", ".join(f"round({n}, {places}) + 0 as {n.split('.')[-1]}" for n in names)


_ATOMS = f"""
p as (select p_partkey as k, cast(floor(p_partkey / 500) as bigint) as structure_id, p_partkey % 500 as ball_id, cast(floor((p_partkey % 500) / 10) as bigint) as res from part),
atoms as materialized (select structure_id, ball_id, case when res % 11 = 9 then 'HETATM' else 'ATOM' end as record_name, list_extract({list(ATOM_NAMES)}, cast(ball_id % 10 + 1 as bigint)) as name,
      list_extract({list(RESIDUES)}, cast(res % 11 + 1 as bigint)) as res_name, chr(cast(65 + floor(ball_id / 100) as int)) as chain_id, cast(res + 1 as int) as res_seq,
      case when res % 7 = 0 then 'B' else '' end as i_code, cast(k * 7919 % 997 as double) / 50 as x, cast(k * 104729 % 991 as double) / 50 as y, cast(k * 1299709 % 983 as double) / 50 as z from p)"""
_PROTEIN = "res_name in ('ALA','GLY','HIS','ASP','LYS','SER','PHE','CYX')"
_SELECTIONS = {
    "sel_protein": _PROTEIN, "sel_backbone": f"{_PROTEIN} and name in ('C','CA','N','O')", "sel_sidechain": f"{_PROTEIN} and name not in ('C','CA','N','O')", "sel_nucleic": "res_name = 'DA'",
    "sel_hetatm": "record_name = 'HETATM'", "sel_charged": "res_name in ('ASP','LYS','HIS')", "sel_hydrophobic": "res_name in ('ALA','PHE','GLY')", "sel_aromatic": "res_name in ('PHE','HIS')",
    "sel_acidic": "res_name = 'ASP'", "sel_basic": "res_name in ('LYS','HIS')", "sel_polar": "res_name in ('SER','CYX')", "sel_all": "true", "sel_none": "false",
    "sel_glob": "(name like 'C%' or regexp_matches(name, '^[NO].+$')) and (res_name in ('LYS', 'CYX') or regexp_matches(res_name, '^[A-D].*$'))",
    "sel_resid": "res_seq between 3 and 9 or res_seq between 20 and 25 or res_seq = 44", "sel_bool": "not (chain_id in ('A','B') or res_name = 'ALA') and name = 'CA' or record_name = 'HETATM'",
}
#: Radii of the atoms that the queries have, written out: exact names before patterns, residues before any.
_RADIUS = """case when name = 'N' then 1.70 when name = 'CA' then 1.90 when name = 'C' then 1.75 when name = 'O' then 1.49
     when name = 'CB' then case res_name when 'ALA' then 1.92 when 'ASP' then 1.91 when 'HIS' then 1.91 when 'LYS' then 1.91 when 'PHE' then 1.91 when 'SER' then 1.91 else 1.80 end
     when name = 'CG1' then case res_name when 'ASP' then 1.76 when 'HIS' then 1.80 when 'LYS' then 1.92 when 'PHE' then 1.74 else 1.80 end
     when name = 'OD1' then case res_name when 'ASP' then 1.49 else 1.50 end when name = 'SG' then 1.90 when name = 'ZN' and res_name = 'ZN' then 0.74 else 1.80 end"""
_ACCEPTED = """
kept as (select *, row_number() over (partition by structure_id order by ball_id) - 1 as n from atoms where record_name = 'ATOM' and res_name <> 'HOH' and not regexp_matches(regexp_replace(name, '^(\\d+)(\\D.*)$', '\\2\\1'), '^H'))
select structure_id, n as ball_id, cast(ball_id + 1 as int) as serial, regexp_replace(name, '^(\\d+)(\\D.*)$', '\\2\\1') as name, res_name, chain_id, res_seq, i_code, round(x, 3) + 0 as x, round(y, 3) + 0 as y, round(z, 3) + 0 as z from kept"""
_TURNED = "regexp_replace(name, '^(\\d+)(\\D.*)$', '\\2\\1')"
_GROUP = (
    "case when res_name = 'ALA' and name in ('C','CA','N','O') then 0 when chain_id = 'A' and record_name <> 'HETATM' then 1 "
    "when res_seq between 10 and 40 or name like 'C%' then 2 else 3 + ball_id end"
)
_EXCLUDED = BALLS  # an excluded ball keeps cutting others, so only its own contacts go

_CONTACTS = f"select structure_id, least(a, b) as id_a, greatest(a, b) as id_b, {_r('area')} from con"
_PERIODIC_ORDER = "order by a, h, image, b"

_SKEW = ((20, 0, 0), (5, 19, 0), (-4, 3, 21))
_UNEVEN = BALLS.replace("balls as materialized", "even as materialized") + """,
balls as materialized (select structure_id, ball_id, x, y, z, case when ball_id % 100 = 13 then r * (2 + ball_id % 19) when ball_id % 10 = 4 then r * 1e-1 else r end as r from even)"""

_FIRST = geometry("select 'cell' as kind, structure_id, index as i, cast(null as bigint) as j, sas_area as v from cell union all select 'contact', structure_id, a, b, area from con")
_GOLDEN = "with t as (select (1 + sqrt(5)) / 2 as t), v as (select a * t as x, b * 1.0 as y, 0.0 as z from t, (values (1), (-1)) p(a), (values (1), (-1)) q(b) union all select a * 1.0, 0.0, b * t from t, (values (1), (-1)) p(a), (values (1), (-1)) q(b) union all select 0.0, a * t, b * 1.0 from t, (values (1), (-1)) p(a), (values (1), (-1)) q(b))"


def _corners(depth: int) -> str:
    """The corners of an icosahedron as unit vectors (ux, uy, uz, k), and after each split the middles of all edges."""
    unit = "select {0} / n as ux, {1} / n as uy, {2} / n as uz, row_number() over () - 1 as k from (select *, sqrt({0} * {0} + {1} * {1} + {2} * {2}) as n from {3})"
    steps = [f"c0 as materialized ({unit.format('x', 'y', 'z', f'({_GOLDEN} select * from v)')})"]
    for i, edge in enumerate((1.06, 0.65, 0.33, 0.17)[:depth]):
        middles = f"(select a.ux + b.ux as x, a.uy + b.uy as y, a.uz + b.uz as z from c{i} a join c{i} b on a.k < b.k and (a.ux - b.ux) * (a.ux - b.ux) + (a.uy - b.uy) * (a.uy - b.uy) + (a.uz - b.uz) * (a.uz - b.uz) < {edge * edge})"
        steps.append(f"c{i + 1} as materialized (select ux, uy, uz, row_number() over () - 1 as k from (select ux, uy, uz from c{i} union all select ux, uy, uz from ({unit.format('x', 'y', 'z', middles)})))")
    return ", ".join(steps) + f", corner as materialized (select * from c{depth})"


def _solvated(depth: int) -> str:
    """Balls without their probe, and solvent on the points around each exposed one that no contact is nearer to."""
    return f"""
first as materialized ({_FIRST}),
atom as materialized (with {BALLS} select *, max(ball_id) over (partition by structure_id) + 1 as n from balls),
{_corners(depth)},
halves as (select structure_id, i, j from first where kind = 'contact' union all select structure_id, j, i from first where kind = 'contact'),
tried as materialized (select a.structure_id, a.ball_id as parent, a.n + a.ball_id * (select count(*) from corner) + k as id, a.x + ux * (a.r + 1.4e0) as x, a.y + uy * (a.r + 1.4e0) as y, a.z + uz * (a.r + 1.4e0) as z, a.x as c_x, a.y as c_y, a.z as c_z, a.r as c_r
      from atom a join first f on f.kind = 'cell' and f.v > 0 and f.structure_id = a.structure_id and f.i = a.ball_id, corner),
beaten as (select distinct t.structure_id, t.id from tried t join halves h on h.structure_id = t.structure_id and h.i = t.parent join atom o on o.structure_id = h.structure_id and o.ball_id = h.j
      where sqrt({_sq('t.', 'o.')}) - o.r <= sqrt({_sq('t.', 't.c_')}) - t.c_r),
drop_ as materialized (select * from tried anti join beaten using (structure_id, id)),
balls as materialized (select structure_id, ball_id, x, y, z, greatest(r - 1.4e0, 1e-2) as r from atom union all select structure_id, id, x, y, z, 1.4e0 from drop_)"""


def solvent_sql(depth: int) -> str:
    """Solvent spheres with their weights."""
    return geometry(
        f"select d.structure_id, {_r('d.x', 'd.y', 'd.z', places=3)}, 1.4e0 as radius, round(coalesce(volume, 0), 3) + 0 as weight, parent as parent_index from drop_ d left join cell on cell.structure_id = d.structure_id and cell.index = d.id",
        balls=_solvated(depth), probe="0")


ORACLE_SQL = {
    "overlap_pairs": geometry(f"select structure_id, a, b, round(sqrt(d2), {PLACES}) + 0 as d from o"),
    "hidden_balls": geometry("select structure_id, a as ball_id from hid"),
    "neighbour_lists": geometry(f"select structure_id, a as ball_id, b as neighbour, round(h, {PLACES}) + 0 as offset from n"),
    "pair_groups": geometry("select structure_id, a, b from pr", groups=True),
    "contact_discs": geometry(f"select structure_id, a, b, round(h, {PLACES}) + 0 as offset, round(rr, {PLACES}) + 0 as radius, round(pi() * rr * rr, {PLACES}) + 0 as uncut_area from disc"),
    "clip_lines": geometry(f"select structure_id, a, b, c, {_r('dist')} from cut"),
    "contacts_area_arc": geometry(f"select structure_id, a as id_a, b as id_b, {_r('area')}, round(rr * arc_sum, {PLACES}) + 0 as arc_length from con"),
    "contact_central": geometry("select structure_id, a as id_a, b as id_b, central from con"),
    "contacts_full": geometry(f"select structure_id, a, b, {_r('d', 'area', 'arc_length', 'solid_angle_a', 'solid_angle_b', 'pyramid_volume_a', 'pyramid_volume_b')} from ful"),
    "grouped_contacts": geometry(_CONTACTS, groups=True),
    "cells": geometry(f"select structure_id, index, {_r('sas_area', 'volume', places=3)} from cell"),
    "totals": geometry(
        "select b.structure_id, num_balls, coalesce(num_contacts, 0) as num_contacts, coalesce(num_cells, 0) as num_cells, round(coalesce(sa, 0), 2) + 0 as total_sas_area, round(coalesce(vo, 0), 2) + 0 as total_volume, "
        "round(coalesce(ca, 0), 2) + 0 as total_contact_area from (select structure_id, count(*) as num_balls from balls group by 1) b left join (select structure_id, count(*) as num_contacts, sum(area) as ca from con group by 1) c "
        "on b.structure_id = c.structure_id left join (select structure_id, count(*) as num_cells, sum(sas_area) as sa, sum(volume) as vo from cell group by 1) l on b.structure_id = l.structure_id"
    ),
    "per_ball": geometry(f"select b.structure_id, b.ball_id, {_r('sas_area', 'volume', places=3)} from balls b left join cell c on b.structure_id = c.structure_id and b.ball_id = c.index"),
    "network_edges": geometry(
        f"select structure_id, l[1] as ball_0, l[2] as ball_1, coalesce(l[3], -1) as ball_2, l[3] is null as is_on_sas, round(min(length), {PLACES}) + 0 as length from (select structure_id, list_sort([a, b, c], 'asc', 'nulls last') as l, "
        "hi - lo as length from piece semi join con using (structure_id, a, b, image) union all select structure_id, list_sort([a, b, cast(null as bigint)], 'asc', 'nulls last'), len * rr from arc join con using (structure_id, a, b, image)) group by structure_id, l"
    ),
    "network_vertices": geometry(
        f"select structure_id, l[1] as ball_0, l[2] as ball_1, coalesce(l[3], -1) as ball_2, coalesce(l[4], -1) as ball_3, l[4] is null as is_on_sas, {_r('spot.x', 'spot.y', 'spot.z', places=2)} from (select structure_id, l, min(spot) as spot from ("
        "select structure_id, list_sort([a, b, c, by_c], 'asc', 'nulls last') as l, {'x': mx + p1 * e1x + p2 * e2x, 'y': my + p1 * e1y + p2 * e2y, 'z': mz + p1 * e1z + p2 * e2z} as spot "
        "from (select structure_id, a, b, image, c, by_c, dist * n1 - t * n2 as p1, dist * n2 + t * n1 as p2 from (select *, lo_by as by_c, lo as t from piece union all select *, hi_by, hi from piece)) "
        "join con using (structure_id, a, b, image)) group by structure_id, l)"
    ),
    "periodic_images": geometry(
        f"select img.structure_id, id as ball_id, cast(image as bigint) as image, {_r('x', 'y', 'z')} from img join (select structure_id, " + ", ".join(f"min({c}) as l{c}, max({c}) as h{c}" for c in "xyz")
        + ", max(r) as m from s group by 1) e on img.structure_id = e.structure_id where image = 0 or (" + " and ".join(f"{c} between l{c} - 2 * m and h{c} + 2 * m" for c in "xyz") + ")", box=20),
    "periodic_overlaps": geometry("select structure_id, a, b, cast(image as bigint) as image from o", box=20),
    "periodic_contacts": geometry(
        f"select structure_id, least(a, b) as id_a, greatest(a, b) as id_b, {_r('area')} from con qualify row_number() over (partition by structure_id, least(a, b), greatest(a, b), image <> 0 {_PERIODIC_ORDER}) = 1", box=20),
    "periodic_contacts_only": geometry(
        f"select structure_id, least(a, b) as id_a, greatest(a, b) as id_b, {_r('area')} from con qualify row_number() over (partition by structure_id, least(a, b), greatest(a, b) {_PERIODIC_ORDER}) = 1", box=20),
    "periodic_cells": geometry(f"select structure_id, index, {_r('sas_area', 'volume', places=3)} from cell", box=20),
    "skew_overlaps": geometry("select structure_id, a, b, cast(image as bigint) as image from o", box=_SKEW),
    "skew_contacts": geometry(
        f"select structure_id, least(a, b) as id_a, greatest(a, b) as id_b, {_r('area')} from con qualify row_number() over (partition by structure_id, least(a, b), greatest(a, b), image <> 0 {_PERIODIC_ORDER}) = 1", box=_SKEW),
    "uneven_overlaps": geometry(f"select structure_id, a, b, round(sqrt(d2), {PLACES}) + 0 as d from o", balls=_UNEVEN),
    "incremental_update": geometry(_CONTACTS, moved=True),
    # Of the balls that an update reaches, those with neighbours but without a contact keep a whole cell.
    "incremental_cells": geometry(
        f"select structure_id, index, {_r('sas_area', 'volume', places=3)} from cell anti join (select structure_id, a as index from hid) using (structure_id, index) union all "
        f"select structure_id, id, round(4 * {PI} * r * r, 3) + 0, round(4 * {PI} * r * r * r / 3, 3) + 0 from s semi join (select structure_id, id from s where id % 100 = 7 union select structure_id, b from o where a % 100 = 7 "
        f"union select p.structure_id, q.ball_id from balls p join balls q on p.structure_id = q.structure_id and p.ball_id % 100 = 7 and {_sq('p.', 'q.')} < (p.r + q.r + 2.8e0) * (p.r + q.r + 2.8e0)) using (structure_id, id) "
        "anti join (select structure_id, index as id from cell) using (structure_id, id) anti join (select structure_id, a as id from hid) using (structure_id, id)", moved=True),
    "restore": geometry(_CONTACTS),
    "solvent": solvent_sql(2),
    "solvent_corners": solvent_sql(0),
    "solvent_points": f"with {_solvated(2).lstrip()} select structure_id, parent as parent_index, {_r('x', 'y', 'z')} from drop_",
    # Around the centre of the disc, a piece of a line and a chord of an arc each span a triangle.
    "face_polygons": geometry(
        f"select structure_id, a, b, cast(sum(points) as bigint) as points, round(sum(area), {PLACES}) + 0 as area, round(sum(length), {PLACES}) + 0 as boundary from ("
        "select structure_id, a, b, 1 as points, 0.5 * dist * (hi - lo) as area, hi - lo as length from piece semi join con using (structure_id, a, b, image) union all "
        "select structure_id, a, b, n, n * 0.5 * rr * rr * sin(len / n), n * 2 * rr * sin(len / n / 2) from (select structure_id, a, b, len, rr, "
        "case when np is null then 13 else greatest(floor(len / 0.5), 1) end as n from arc join con using (structure_id, a, b, image) left join (select structure_id, a, b, count(*) as np from piece group by all) using (structure_id, a, b))"
        ") group by all having sum(points) >= 3"
    ),
    "json_document": geometry(
        "select b.structure_id, num_balls, coalesce(num_contacts, 0) as num_contacts, coalesce(num_central, 0) as num_central, coalesce(num_cells, 0) as num_cells, num_balls - coalesce(num_cells, 0) as num_without, "
        "round(coalesce(ca, 0), 2) + 0 as contact_area, round(coalesce(al, 0), 2) + 0 as arc_length, round(coalesce(sa, 0), 2) + 0 as sas_area, round(coalesce(vo, 0), 2) + 0 as volume "
        "from (select structure_id, count(*) as num_balls from balls group by 1) b left join (select structure_id, count(*) as num_contacts, count(*) filter (where central) as num_central, sum(area) as ca, sum(rr * arc_sum) as al from con group by 1) c "
        "on b.structure_id = c.structure_id left join (select structure_id, count(*) as num_cells, sum(sas_area) as sa, sum(volume) as vo from cell group by 1) l on b.structure_id = l.structure_id"
    ),
    "exclusion": geometry(f"{_CONTACTS} where not (structure_id = 0 and (a = 5 or b = 5))"),
    "group_chain": f"with {_ATOMS} select structure_id, ball_id, cast(floor(ball_id / 100) as bigint) as grp from atoms",
    "group_residue": f"with {_ATOMS} select structure_id, ball_id, cast(floor(ball_id / 10) as bigint) as grp from atoms",
    "group_selection": f"with {_ATOMS} select structure_id, ball_id, {_GROUP} as grp from atoms",
    "radii_lookup": f"with {_ATOMS} select structure_id, ball_id, cast({_RADIUS} as double) as radius from atoms",
    "selected_contacts": geometry(_CONTACTS, groups="grp", balls=f"{_ATOMS}, balls as materialized (select structure_id, ball_id, x, y, z, cast({_RADIUS} as double) as r, {_GROUP} as grp from atoms)"),
    "pdb_first_model": f"with {_ATOMS}, kept as (select *, row_number() over (partition by structure_id order by ball_id) - 1 as n from atoms where ball_id < 250 and res_name <> 'HOH') "
    f"select structure_id, n as ball_id, cast(ball_id + 1 as int) as serial, {_TURNED} as name, res_name, chain_id from kept",
    "pdb_assembly": f"with {_ATOMS}, kept as (select *, row_number() over (partition by structure_id order by ball_id) - 1 as n from atoms where (ball_id < 250 or structure_id % 2 = 1) and res_name <> 'HOH') "
    f"select structure_id, n as ball_id, cast(ball_id + 1 as int) as serial, {_TURNED} as name, res_name, chain_id || case when ball_id < 250 then '' else '2' end as chain_id from kept",
    "mmcif_first_model": f"with {_ATOMS}, kept as (select *, row_number() over (partition by structure_id order by ball_id) - 1 as n from atoms where ball_id < 100 and res_name <> 'HOH') "
    f"select structure_id, n as ball_id, cast(ball_id + 1 as int) as serial, {_TURNED} as name, res_name, chain_id, res_seq from kept",
    "mmcif_assembly": f"with {_ATOMS}, kept as (select *, cast(floor(ball_id / 100) as bigint) + 1 as m, row_number() over (partition by structure_id order by ball_id) - 1 as n from atoms where res_name <> 'HOH') "
    f"select structure_id, n as ball_id, cast(ball_id + 1 as int) as serial, {_TURNED} as name, res_name, chain_id || case when m = 1 then '' else cast(m as varchar) end as chain_id, res_seq from kept",
    "xyzr_parse": f"with {BALLS} select structure_id, row_number() over (partition by structure_id order by ball_id) - 1 as ball_id, {_r('x', 'y', 'z', 'r', places=3)} from balls where ball_id % 7 <> 3",
    "pdb_parse": f"with {_ATOMS}, {_ACCEPTED}",
    "mmcif_parse": f"with {_ATOMS}, {_ACCEPTED}",
    "icosahedron_points": f"with {BALLS}, corner as materialized ({_GOLDEN} select x / sqrt(x * x + y * y + z * z) as ux, y / sqrt(x * x + y * y + z * z) as uy, z / sqrt(x * x + y * y + z * z) as uz from v) "
    "select structure_id, ball_id, round(x + ux * r, 4)::double + 0 as x, round(y + uy * r, 4)::double + 0 as y, round(z + uz * r, 4)::double + 0 as z from balls, corner",
} | {name: f"with {_ATOMS} select structure_id, ball_id from atoms where {where}" for name, where in _SELECTIONS.items()}
