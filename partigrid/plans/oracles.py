"""DuckDB SQL that finds the rows of the graph queries in other ways: by sets of bits, recursion and closed forms."""

from __future__ import annotations


def cells(size: int) -> str:
    """Common table expression ``cell(v, x, y, district, weight)`` of the nation grid."""
    return f"""cell as (
  select (x * {size} + y)::int as v, x, y, district, weight from (
    select n_nationkey % 5 as x, n_nationkey // 5 as y, n_regionkey as district,
      (select count(*) from customer where c_nationkey = n_nationkey) as weight from nation
  ) where x < {size} and y < {size}
)"""


def plain_cells(size: int) -> str:
    """The same columns for a grid of weight 1 of any size, from no table."""
    return f"cell as (select v::int as v, (v // {size})::int as x, (v % {size})::int as y, 0 as district, 1::bigint as weight from range({size * size}) t(v))"


def edges(size: int, queen: bool = False) -> str:
    near = "greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1" if queen else "abs(a.x - b.x) + abs(a.y - b.y) = 1"
    return f"edge as (select a.v as src, b.v as dst, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from cell a join cell b on a.v < b.v and {near})"


ORDER_KEYS = {
    # (sort keys for an edge from (ax, ay) to (bx, by_), ids ascending; vertical: same x)
    "diagonal": "case when ax = bx then ax + by_ when ay = {m} then ax + 1 + {m} else ax + ay + 1 end, case when ax <> bx and ay = {m} then -1 else ax end, case when ax = bx then 0 else 1 end",
    "lines": "ax, case when ax = bx then 0 else 1 end, ay",
    "boxes_after_side": "case when ax = bx then ax else ax + 1 end, case when ax = bx and ax > 0 then ay + 1 else ay end, case when ax = bx and ax > 0 then 1 else 0 end",
    "boxes_from_corner": "case when ax = bx then greatest(ax - 1, 0) else ax end, case when ax = bx then ay + 1 else ay end, case when ax <> bx then case when ax = 0 and ay > 0 then 1 else 0 end when ax = 0 then 0 when ax = 1 then 2 else 1 end",
    "native": "src, dst",
    "queen": "case when ax = bx then greatest(ax - 1, 0) else ax end, case when ax <> bx and by_ < ay then by_ else ay end, case when ax = bx then case when ax = 0 then 0 else 4 end when ay = by_ then 1 when by_ < ay then 2 else 3 end",
}


def order(kind: str, size: int = 5, plain: bool = False) -> str:
    keys = ORDER_KEYS[kind].replace("{m}", str(size - 1))
    return f"{plain_cells(size) if plain else cells(size)}, {edges(size, kind == 'queen')}, ord as (select (row_number() over (order by {keys}))::int as pos, src, dst from edge)"


def frontier(kind: str = "diagonal", size: int = 5) -> str:
    return f"""{order(kind, size)}, ends as (
  select v, min(pos) as first, max(pos) as last from (select src as v, pos from ord union all select dst, pos from ord) group by v
), front as (select o.pos, e.v from ord o join ends e on e.first < o.pos and o.pos <= e.last)"""


def grown(r: str, size: int, queen: bool) -> str:
    """The set ``r`` of grid cells (bits) with its neighbours."""
    n = size * size
    full = (1 << n) - 1
    first = sum(1 << v for v in range(n) if v % size == 0)
    last = sum(1 << v for v in range(n) if v % size == size - 1)
    in_, out = f"({r} & {full - first})", f"({r} & {full - last})"
    parts = [r, f"({out} << 1)", f"({in_} >> 1)", f"({r} << {size})", f"({r} >> {size})"]
    if queen:
        parts += [f"({out} << {size + 1})", f"({in_} << {size - 1})", f"({out} >> {size - 1})", f"({in_} >> {size + 1})"]
    return f"(({' | '.join(parts)}) & {full})"


def plans(size: int, queen: bool, most: int, lower: str = "0", upper: str = "9223372036854775807", weight: str = "1") -> str:
    """``plan(blocks, k)``: every partition into at most ``most`` connected blocks (sets of bits, by smallest cell)."""
    n = size * size
    full = (1 << n) - 1
    g = grown("r", size, queen)
    return f"""{cells(size)}, flood(s, r) as (
  select s, s & -s from (select range::bigint as s from range(1, {full + 1}))
  union all
  select s, s & {g} from flood where (s & {g}) <> r
), conn as (
  select f.s, f.s & -f.s as low from (select s from flood group by s having max(r) = s) f
  join (select q.s, sum({weight}) as w from flood q join cell on (q.s >> cell.v) & 1 = 1 where q.r = q.s & -q.s group by q.s) t on t.s = f.s
  where w >= {lower} and w <= {upper}
), part(cover, blocks) as (
  select 0::bigint, []::bigint[]
  union all
  select p.cover | c.s, list_append(p.blocks, c.s) from part p join conn c on c.low = ({full} & ~p.cover) & -({full} & ~p.cover) and (c.s & p.cover) = 0
  where p.cover <> {full} and len(p.blocks) < {most}
), plan as (select blocks, len(blocks) as k from part where cover = {full})"""


def plan_text(size: int) -> str:
    """A plan's districts by cell as text, from its blocks."""
    return f"array_to_string(list_transform(range({size * size}), lambda v: list_position(list_transform(blocks, lambda b: (b >> v) & 1), 1) - 1), ',')"


def forests(size: int) -> str:
    """``forest(mask, labels)``: sets of rook edges (bits in native order) without a cycle, and each cell's smallest mate."""
    n = size * size
    return f"""{cells(size)}, {edges(size)}, numbered as (
  select (row_number() over (order by src, dst) - 1)::int as i, src, dst from edge
), grow(i, mask, labels) as (
  select 0, 0::bigint, list_transform(range({n}), lambda v: v::int)
  union all
  select g.i + 1, case when keep then g.mask | (1::bigint << g.i) else g.mask end,
    case when keep then list_transform(g.labels, lambda l: case when l = greatest(g.labels[e.src + 1], g.labels[e.dst + 1]) then least(g.labels[e.src + 1], g.labels[e.dst + 1]) else l end) else g.labels end
  from grow g join numbered e on e.i = g.i, (values (true), (false)) t(keep)
  where not keep or g.labels[e.src + 1] <> g.labels[e.dst + 1]
), forest as (select mask, labels from grow where i = (select count(*) from numbered)),
tree as (select mask, (row_number() over (order by mask) - 1) as rank_by_mask from forest where list_max(labels) = 0)"""


def _leaves(rows: str, x: str, n: int, lower: str, upper: str, most: int) -> str:
    """States of ``rows`` after vertex ``x`` (u or v) has gone, if no later edge has it; its district closes or takes a new label."""
    return f"""select * exclude (own, stays, ends) replace (
    case when ends and stays is null then cc + 1 else cc end as cc,
    case when ends then list_transform(comp, lambda c, k: case when k - 1 = {x} then -1 when c = {x} then stays else c end) else comp end as comp,
    case when not ends then wts when stays is null then list_transform(wts, lambda w, k: case when k - 1 = own then 0 else w end)
      when own = {x} then list_transform(wts, lambda w, k: case when k - 1 = stays then wts[{x} + 1] when k - 1 = {x} then 0 else w end) else wts end as wts,
    case when not ends then bad when stays is null then list_filter(bad, lambda p: p // 1000 <> own and p % 1000 <> own)
      when own = {x} then list_sort(list_transform(bad, lambda p: least(case when p // 1000 = {x} then stays else p // 1000 end, case when p % 1000 = {x} then stays else p % 1000 end) * 1000
        + greatest(case when p // 1000 = {x} then stays else p // 1000 end, case when p % 1000 = {x} then stays else p % 1000 end))) else bad end as bad
  ) from (
    select *, comp[{x} + 1] as own, list_max(list_filter(range({n}), lambda w: w <> {x} and comp[w + 1] = comp[{x} + 1])) as stays, {x}_ends as ends from ({rows})
  ) where not ends or stays is not null or (wts[own + 1] between {lower} and {upper} and cc < {most})"""


def _decided(rows: str, n: int, lower: str, upper: str, most: int) -> str:
    """What both decisions on the next edge make of the states ``rows``: their columns, ``bit``, and i one higher."""
    new = "(k - 1 = u and u_new) or (k - 1 = v and v_new)"
    opened = f"""select s.*, t.u, t.v, t.u_ends, t.v_ends, bit,
      list_transform(comp, lambda c, k: case when {new} then k - 1 else c end) as comp_, list_transform(wts, lambda w, k: case when {new} then ws.weight[k] else w end) as wts_
      from ({rows}) s join step t on t.pos = s.i, (select list(w order by v) as weight from weights) ws, (values (0), (1)) b(bit)"""
    named = f"select *, least(comp_[u + 1], comp_[v + 1]) as lo, greatest(comp_[u + 1], comp_[v + 1]) as hi from ({opened})"
    chosen = f"""select * exclude (comp_, wts_) replace (
      case when bit = 1 then list_transform(comp_, lambda c: case when c = lo then hi else c end) else comp_ end as comp,
      case when bit = 1 and lo <> hi then list_transform(wts_, lambda w, k: case when k - 1 = hi then wts_[lo + 1] + wts_[hi + 1] when k - 1 = lo then 0 else w end) else wts_ end as wts,
      case when bit = 0 then list_sort(list_distinct(list_append(bad, lo * 1000 + hi))) when lo = hi then bad
        else list_sort(list_distinct(list_transform(bad, lambda p: least(case when p // 1000 = lo then hi else p // 1000 end, case when p % 1000 = lo then hi else p % 1000 end) * 1000
          + greatest(case when p // 1000 = lo then hi else p // 1000 end, case when p % 1000 = lo then hi else p % 1000 end)))) end as bad,
      i + 1 as i
    ) from ({named})
    where case when bit = 0 then lo <> hi else (lo = hi or not list_contains(bad, lo * 1000 + hi)) and case when lo <> hi then wts_[lo + 1] + wts_[hi + 1] else wts_[hi + 1] end <= {upper} end"""
    return _leaves(_leaves(chosen, "u", n, lower, upper, most), "v", n, lower, upper, most)


def states(kind: str, size: int, k: int, lower: str = "0", upper: str = "1000000000", weight: str = "0", plain: bool = False) -> str:
    """``state(i, cc, comp, bad, wts, paths)``: what decisions on the edges before position i come to, with their number.

    ``comp`` holds each open cell's component (its largest open cell, -1 for others), ``bad`` pairs of components that must
    stay apart, ``wts`` component weights.
    """
    n = size * size
    nothing = f"select 1 as i, 0 as cc, list_transform(range({n}), lambda v: (-1)::bigint) as comp, []::bigint[] as bad, list_transform(range({n}), lambda v: 0::bigint) as wts, 1::hugeint as paths"
    return f"""{order(kind, size, plain)}, ends as (
  select v, min(pos) as first, max(pos) as last from (select src as v, pos from ord union all select dst, pos from ord) group by v
), step as materialized (
  select pos, src as u, dst as v, a.first = pos as u_new, b.first = pos as v_new, a.last = pos as u_ends, b.last = pos as v_ends from ord join ends a on a.v = src join ends b on b.v = dst
), weights as (select v, ({weight})::bigint as w from cell),
state as (
  {nothing}
  union all
  select i, cc, comp, bad, wts, sum(paths)::hugeint from ({_decided("select * from state", n, lower, upper, k)}) group by i, cc, comp, bad, wts
)"""


_KEY = "i || ':' || cc || ':' || array_to_string(comp, ' ') || ':' || array_to_string(bad, ' ') || ':' || array_to_string(wts, ' ')"


def diagram(kind: str, size: int, k: int, lower: str = "0", upper: str = "1000000000", weight: str = "0") -> str:
    """``node(key, ..)``: the states before an edge; ``arc(parent, bit, child)`` by keys (child ``yes`` or ``no`` at the ends)
    and ``below(key, paths)``: plans below each node that has any."""
    n, last = size * size, "(select count(*) from ord)"
    columns = "i, cc, comp, bad, wts"
    return f"""{states(kind, size, k, lower, upper, weight)}, node as materialized (
  select {_KEY} as key, {columns}, paths from state where i <= {last}
), made as (
  select parent, bit, case when i > {last} then case when cc = {k} then 'yes' else 'no' end else {_KEY} end as child
  from ({_decided(f"select key as parent, {columns} from node", n, lower, upper, k)})
), arc as materialized (
  select key as parent, b.bit, coalesce(child, 'no') as child from node cross join (values (0), (1)) b(bit) left join made on made.parent = key and made.bit = b.bit
), below as (
  select 'yes' as key, 1::hugeint as paths
  union all
  select parent, sum(below.paths)::hugeint from arc join below on arc.child = below.key group by parent
)"""


def node_text() -> str:
    """A node's state as text: ``level src - dst cc [cell:component ..] {{pair ..}} (weight ..)``, of the open cells in order."""
    open_ = "list_filter(range(len(comp)), lambda v: comp[v + 1] >= 0)"
    return f"""n.i || ' ' || ord.src || ' - ' || ord.dst || ' ' || cc || ' [' || array_to_string(list_transform({open_}, lambda v: v || ':' || comp[v + 1]), ' ') || '] {{'
  || array_to_string(list_transform(bad, lambda p: (p // 1000) || '/' || (p % 1000)), ', ') || '}} (' || array_to_string(list_transform({open_}, lambda v: wts[v + 1]), ' ') || ')'"""
