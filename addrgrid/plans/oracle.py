"""Oracle SQL (DuckDB dialect) for every registered query.

Each string is self-contained: the fixture CTEs of FIXTURES.md are prefixed
(only those a query needs), so DuckDB runs it against the pre-registered
driver tables. The logic is written independently of the Spark side (plain
relational SQL, brute force where Spark uses a grid or a prefix filter).
"""

from __future__ import annotations

from ..functions.geo import ALPHA, BETA, DELTA, NZTM_FE, NZTM_FN, NZTM_LON0, _E, _KA
from ..functions.text import ASCII_FROM, ASCII_TO, ROAD_TYPES
from ..operators.hierarchy import MAJOR_SUBURBS
from ..sources.fixtures import ROAD_BASES, ROAD_TYPES as FX_RTYPES, SUBURB_NAMES, TOWNS

# ---------------------------------------------------------------------------
# fixture CTEs (dependency order)
# ---------------------------------------------------------------------------


def _values(rows):
    return ",".join("(" + ",".join(repr(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _sql_list(vals):
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in vals) + "]"


FX = {}
FX["fx_region_vertex"] = """
select cast(r_regionkey as varchar) region_id, v.seq,
       1100000.0e0+200000.0e0*(r_regionkey+v.ox) x, 4750000.0e0+1450000.0e0*v.oy y
from region cross join (values (0,0,0),(1,1,0),(2,1,1),(3,0,1)) v(seq,ox,oy)"""
FX["fx_district_vertex"] = """
select cast(n_nationkey as varchar) district_id, v.seq,
       1100000.0e0+200000.0e0*((n_nationkey%5)+v.ox) x,
       4750000.0e0+290000.0e0*(floor(n_nationkey/5)+v.oy) y
from nation cross join (values (0,0,0),(1,1,0),(2,1,1),(3,0,1)) v(seq,ox,oy)"""
FX["fx_suburb"] = f"""
select cast(k as varchar) suburb_id, cast(nk as varchar) district_id, nk, k % grid gx, k // grid gy, grid,
       case when k % 4 = 3 then ({_sql_list(SUBURB_NAMES)})[cast(floor(k/4) as bigint) % 6 + 1]
            else 'Locality ' || cast(k % 97 as varchar) end name,
       case when k % 5 = 0 then 'Northport' when k % 5 = 1 then '' end major_name
from (select s_suppkey k, s_nationkey nk, greatest(10, cast(floor(sqrt(max(s_suppkey) over ())) as bigint) + 1) grid
      from supplier)"""
FX["fx_suburb_vertex"] = """
select suburb_id, v.seq,
       1100000.0e0+200000.0e0*(nk%5)+200000.0e0/grid*(gx+v.ox/100.0e0) x,
       4750000.0e0+290000.0e0*floor(nk/5)+290000.0e0/grid*(gy+v.oy/100.0e0) y
from fx_suburb cross join
 (values (0,5,50),(1,30,5),(2,75,10),(3,95,55),(4,60,95),(5,45,60),(6,15,90)) v(seq,ox,oy)"""
FX["fx_point"] = """
select o_orderkey address_id,
       1100000.0e0+1000000.0e0*(((o_orderkey*7919+104729)%1000003)/1000003.0e0) x,
       4750000.0e0+1450000.0e0*(((o_orderkey*6271+15485863)%999983)/999983.0e0) y
from orders"""
FX["fx_road"] = f"select * from (values {_values(list(enumerate(ROAD_BASES)))}) v(rid,base)"
FX["fx_rtype"] = f"select * from (values {_values(list(enumerate(FX_RTYPES)))}) v(tid,rt)"
FX["fx_town"] = f"select * from (values {_values(list(enumerate(TOWNS)))}) v(wid,town_city)"
FX["fx_address"] = """
select o_orderkey address_id, cast(o_orderkey%120+1 as int) address_number,
 concat(base,' ',rt) full_road_name,
 concat('Locality ',cast(o_custkey%97 as varchar)) suburb_locality, town_city,
 concat(cast(o_orderkey%120+1 as varchar),' ',base,' ',rt,', Locality ',
        cast(o_custkey%97 as varchar),', ',town_city) full_address,
 case when o_orderkey%53=0 then null else
   166.5e0+12.0e0*(((o_orderkey*7919+104729)%1000003)/1000003.0e0) end x_coord,
 case when o_orderkey%53=0 then null else
   -47.2e0+12.8e0*(((o_orderkey*6271+15485863)%999983)/999983.0e0) end y_coord,
 case when o_orderkey%41=0 then 'Retired' else 'Current' end address_lifecycle
from orders join fx_road on rid=(o_orderkey*31+7)%14
 join fx_rtype on tid=(o_orderkey*17+3)%5 join fx_town on wid=o_orderkey%5"""
FX["fx_raw"] = """
select c_custkey raw_id, case c_custkey%8
  when 0 then full_address
  when 1 then lower(concat(cast(address_number as varchar),' ',full_road_name))
  when 2 then concat(cast(address_number as varchar),' ',split_part(full_road_name,' ',1),' ',town_city)
  when 3 then concat('  ',upper(replace(full_address,', ',',  ')),'. ')
  when 4 then replace(full_address,concat(cast(address_number as varchar),' '),
                      concat(cast(address_number as varchar),'A '))
  when 5 then '   '
  when 6 then cast(address_number as varchar)
  else concat('zzqx ',cast(90000+c_custkey as varchar)) end raw_address
from customer join fx_address on address_id=(c_custkey*13)%(select count(*) from orders)"""
FX["fx_probe"] = """
select c_custkey point_id,
       166.5e0+12.0e0*(((c_custkey*4099+77)%100003)/100003.0e0) lon,
       -47.2e0+12.8e0*(((c_custkey*2459+131)%99991)/99991.0e0) lat
from customer"""
FX["fx_query"] = """
select c_custkey query_id, case c_custkey%6
  when 0 then split_part(full_road_name,' ',1)
  when 1 then lower(full_road_name)
  when 2 then concat(cast(address_number as varchar),' ',split_part(full_road_name,' ',1))
  when 3 then concat(' ',lower(suburb_locality))
  when 4 then 'ab'
  else concat('zq',cast(c_custkey%10 as varchar)) end query
from customer join fx_address on address_id=(c_custkey*7)%(select count(*) from orders)"""


def _nztm_stage(src: str, lon: str, lat: str, keep: str) -> str:
    """A CTE body that adds gx, gy (Krueger series) to the ``keep`` columns."""
    s1 = (f"select {keep}, "
          f"radians((case when {lon} < 0 then {lon} + 360.0e0 else {lon} end) - {NZTM_LON0!r}) _lam, "
          f"sin(radians({lat})) _sphi from {src}")
    t = f"sinh(atanh(_sphi) - {_E!r} * atanh({_E!r} * _sphi))"
    s2 = (f"select *, atan2({t}, cos(_lam)) _xi1, atanh(sin(_lam) / sqrt(1.0e0 + {t} * {t})) _eta1 from ({s1})")
    xi = "_xi1" + "".join(f" + {a!r} * sin({2 * j}.0e0 * _xi1) * cosh({2 * j}.0e0 * _eta1)"
                          for j, a in enumerate(ALPHA, 1))
    eta = "_eta1" + "".join(f" + {a!r} * cos({2 * j}.0e0 * _xi1) * sinh({2 * j}.0e0 * _eta1)"
                            for j, a in enumerate(ALPHA, 1))
    return (f"select * exclude (_lam, _sphi, _xi1, _eta1), {NZTM_FE!r} + {_KA!r} * ({eta}) gx, "
            f"{NZTM_FN!r} + {_KA!r} * ({xi}) gy from ({s2})")


ADDR = f"""
select address_id, full_address, translate(full_address, '{ASCII_FROM}', '{ASCII_TO}') full_address_ascii,
       full_road_name, translate(full_road_name, '{ASCII_FROM}', '{ASCII_TO}') full_road_name_ascii,
       cast(null as varchar) address_number_prefix, address_number, cast(null as varchar) address_number_suffix,
       suburb_locality, translate(suburb_locality, '{ASCII_FROM}', '{ASCII_TO}') suburb_locality_ascii,
       town_city, 'District ' || cast(address_id % 25 as varchar) territorial_authority, x_coord, y_coord
from fx_address where x_coord is not null and y_coord is not null and address_lifecycle = 'Current'"""
FX["addr0"] = ADDR
FX["addr"] = _nztm_stage("addr0", "x_coord", "y_coord", "*")


def _edges(vertex: str, key: str) -> str:
    return (f"select {key}, x ax, y ay, coalesce(lead(x) over w, first_value(x) over w) bx, "
            f"coalesce(lead(y) over w, first_value(y) over w) bny from {vertex} "
            f"window w as (partition by {key} order by seq rows between unbounded preceding and unbounded following)")


def _bbox(vertex: str, key: str) -> str:
    return f"select {key}, min(x) minx, min(y) miny, max(x) maxx, max(y) maxy from {vertex} group by {key}"


FX["sub_edge"] = _edges("fx_suburb_vertex", "suburb_id")
FX["sub_bbox"] = _bbox("fx_suburb_vertex", "suburb_id")
FX["dis_edge"] = _edges("fx_district_vertex", "district_id")
FX["dis_bbox"] = _bbox("fx_district_vertex", "district_id")
FX["reg_edge"] = _edges("fx_region_vertex", "region_id")
FX["reg_bbox"] = _bbox("fx_region_vertex", "region_id")
FX["fx_districts"] = ("select cast(n_nationkey as varchar) district_id, cast(n_regionkey as varchar) region_id, "
                      "n_name name from nation")

DEPS = {
    "fx_suburb_vertex": ["fx_suburb"], "fx_address": ["fx_road", "fx_rtype", "fx_town"],
    "fx_raw": ["fx_address"], "fx_query": ["fx_address"], "addr0": ["fx_address"], "addr": ["addr0"],
    "sub_edge": ["fx_suburb_vertex"], "sub_bbox": ["fx_suburb_vertex"],
    "dis_edge": ["fx_district_vertex"], "dis_bbox": ["fx_district_vertex"],
    "reg_edge": ["fx_region_vertex"], "reg_bbox": ["fx_region_vertex"],
}
ORDER = list(FX.keys())


def with_fx(names, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    need: set[str] = set()

    def add(n):
        if n in need:
            return
        for d in DEPS.get(n, []):
            add(d)
        need.add(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FX[n]})" for n in ORDER if n in need]
    ctes += [f"{n} AS ({s})" for n, s in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _pip(points: str, key: str, x: str, y: str, poly: str, pkey: str) -> str:
    """Points strictly inside polygons (ray cast, odd crossings)."""
    return (f"select p.{key}, e.{pkey} from {points} p join {poly}_bbox b on p.{x} between b.minx and b.maxx "
            f"and p.{y} between b.miny and b.maxy join {poly}_edge e on e.{pkey} = b.{pkey} "
            f"where ((e.ay > p.{y}) <> (e.bny > p.{y})) and "
            f"p.{x} < (e.bx - e.ax) * (p.{y} - e.ay) / (e.bny - e.ay) + e.ax "
            f"group by p.{key}, e.{pkey} having count(*) % 2 = 1")


def _resolve(points: str, key: str, x: str, y: str) -> list[tuple[str, str]]:
    """CTEs ending in ``rh(key, region_id, district_id, suburb_id)``."""
    return [
        ("sp", _pip(points, key, x, y, "sub", "suburb_id")),
        ("sh", f"select sp.{key}, min(sp.suburb_id) suburb_id, arg_min(s.district_id, sp.suburb_id) s_district_id "
               f"from sp join fx_suburb s on s.suburb_id = sp.suburb_id group by sp.{key}"),
        ("dp", _pip(points, key, x, y, "dis", "district_id")),
        ("dh", f"select dp.{key}, min(dp.district_id) district_id, arg_min(d.region_id, dp.district_id) region_id "
               f"from dp join fx_districts d on d.district_id = dp.district_id group by dp.{key}"),
        ("rh", f"select p.{key}, case when sh.s_district_id is not null then d.region_id else dh.region_id end "
               f"region_id, case when sh.s_district_id is not null then sh.s_district_id else dh.district_id end "
               f"district_id, sh.suburb_id from (select distinct {key} from {points}) p "
               f"left join sh on sh.{key} = p.{key} left join fx_districts d on d.district_id = sh.s_district_id "
               f"left join dh on dh.{key} = p.{key}"),
    ]


RESOLVE_DEPS = ["fx_suburb", "sub_edge", "sub_bbox", "dis_edge", "dis_bbox", "fx_districts"]

# ---------------------------------------------------------------------------
# per-query SQL
# ---------------------------------------------------------------------------

STREETS = ("streets", "select distinct b.suburb_id, a.full_road_name_ascii street_name from ("
           + _pip("addr", "address_id", "gx", "gy", "sub", "suburb_id")
           + ") b join addr a on a.address_id = b.address_id "
             "where a.full_road_name_ascii is not null and a.full_road_name_ascii <> ''")

CLASSIFY = ("subs", "select *, case when lower(name) in (" + ",".join("'" + m + "'" for m in MAJOR_SUBURBS)
            + ") then 'major' when major_name is not null and major_name <> '' then 'medium' else 'minor' end "
              "population_category, lower(name) in (" + ",".join("'" + m + "'" for m in MAJOR_SUBURBS)
            + ") is_major_suburb from fx_suburb")

ALIASES = ("aliases", """select row_number() over (order by src, o, district_id) alias_id, district_id, market_name,
  is_primary from (
  select cast(n_nationkey as varchar) district_id, 'Market ' || n_name market_name,
         n_nationkey % 7 = 0 is_primary, 0 src, n_nationkey o from nation
  where n_nationkey % 7 = 0 or n_nationkey % 11 = 0
  union all
  select cast(n_nationkey as varchar), n_name, true, 1, 0 from nation
  where cast(n_nationkey as varchar) not like '1%')""")

IS_INT = "(regexp_full_match({t}, '[+-]?0*[0-9]{{1,10}}') and try_cast({t} as bigint) between -2147483648 and 2147483647)"


def _is_int(t: str) -> str:
    return IS_INT.format(t=t)


ROADS_SQL = ",".join("'" + r + "'" for r in ROAD_TYPES)

PARSE = [
    ("req", "select raw_id, raw_address, coalesce(regexp_matches(raw_address, '^\\s*$'), true) blank, "
            "coalesce(trim(regexp_replace(translate(lower(raw_address), ',.', '  '), '\\s+', ' ', 'g')), '') norm "
            "from fx_raw"),
    ("tk", "select *, list_filter(string_split(norm, ' '), lambda t: t <> '') toks from req"),
    ("px", f"select *, len(toks) ntok, cast(list_filter(toks, lambda t: {_is_int('t')})[1] as integer) ex_number, "
           f"coalesce(list_filter(toks, lambda t: not {_is_int('t')})[1], '') ex_road, "
           f"list_position(list_transform(toks, lambda t: {_is_int('t')}), true) idx from tk"),
    ("ps", "select *, case when idx is not null then toks[idx+1:] end rest, "
           "cast(case when idx is not null then toks[idx] end as integer) num0 from px"),
    ("pt", f"select *, coalesce(len(rest), 0) n, coalesce(lower(rest[2]) in ({ROADS_SQL}), false) typ from ps"),
    ("pv", "select raw_id, raw_address, blank, norm, ntok, ex_number, ex_road, "
           "case when num0 is not null and n > 0 then num0 end sm_number, "
           "case when num0 is not null and n > 0 then (case when n = 1 then rest[1] when typ then "
           "array_to_string(rest[1:2], ' ') else rest[1] end) end sm_street1, "
           "case when num0 is not null and n > 0 then (case when n = 1 then null when n = 2 and typ then null "
           "when n = 2 then rest[2] when typ then array_to_string(rest[3:], ' ') "
           "else array_to_string(rest[2:], ' ') end) end sm_city1, "
           "case when num0 is not null and n >= 3 and not typ then array_to_string(rest[1:2], ' ') end sm_street2, "
           "case when num0 is not null and n >= 3 and not typ then array_to_string(rest[3:], ' ') end sm_city2 "
           "from pt"),
]


def _trigrams(c: str) -> str:
    return ("list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(" + c
            + "), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), "
              "lambda i: substr('  ' || w || ' ', i, 3)))))")


MATCH = [
    ("pat", "select distinct number, street, city from ("
            "select ex_number number, ex_road street, cast(null as varchar) city from pv where not blank "
            "union all select sm_number, sm_street1, sm_city1 from pv where not blank "
            "union all select sm_number, sm_street2, sm_city2 from pv where not blank) "
            "where number is not null and street is not null"),
    ("mt", "select p.number, p.street, p.city, a.address_id, "
           "case when p.city is null or p.city = '' then 0 when a.suburb_locality ilike '%' || p.city || '%' "
           "or a.town_city ilike '%' || p.city || '%' then 1 else 2 end prio, "
           "case when p.city is null or p.city = '' then 0 when a.full_road_name = p.street then 1 "
           "when a.full_road_name ilike p.street || '%' then 2 else 3 end qual "
           "from pat p join addr a on a.address_number = p.number "
           "where a.full_road_name_ascii ilike '%' || p.street || '%' or a.full_road_name ilike '%' || p.street || '%'"),
    ("mb", "select number, street, city, least(count(*) over (partition by number, street, city), 5) n_match, "
           "address_id best_id from mt qualify row_number() over (partition by number, street, city "
           "order by prio, qual, address_id) = 1"),
    ("ch", "select pv.raw_id, pv.norm, pv.ntok, e.best_id e_id, s1.best_id s1_id, s1.n_match s1_n, "
           "s2.best_id s2_id, s2.n_match s2_n from pv "
           "left join mb e on e.number = pv.ex_number and e.street = pv.ex_road and e.city is null "
           "left join mb s1 on s1.number = pv.sm_number and s1.street = pv.sm_street1 "
           "and s1.city is not distinct from pv.sm_city1 "
           "left join mb s2 on s2.number = pv.sm_number and s2.street = pv.sm_street2 "
           "and s2.city is not distinct from pv.sm_city2 where not pv.blank"),
    ("hit", "select raw_id, norm, case when ntok >= 3 then coalesce(case when s1_id is not null then 's1' end, "
            "case when s2_id is not null then 's2' end, case when e_id is not null then 'e' end) "
            "else coalesce(case when e_id is not null then 'e' end, case when s1_id is not null then 's1' end, "
            "case when s2_id is not null then 's2' end) end src, e_id, s1_id, s1_n, s2_id, s2_n from ch"),
    ("rg", "select raw_id, " + _trigrams("norm") + " g from hit where src is null"),
    ("ag", "select address_id, " + _trigrams("full_address_ascii") + " g from addr "
           "where full_address_ascii is not null"),
    ("fs", "select rg.raw_id, ag.address_id, cast(cast(len(list_intersect(rg.g, ag.g)) as double) / "
           "len(list_distinct(list_concat(rg.g, ag.g))) as float) sim from rg, ag "
           "where len(rg.g) > 0 and len(ag.g) > 0 "
           # sizes alone bound Jaccard by min/max: a loose, exact pre-check
           "and len(ag.g) >= 0.59e0 * len(rg.g) and 0.59e0 * len(ag.g) <= len(rg.g)"),
    ("fb", "select raw_id, address_id f_id, sim f_sim from fs where cast(sim as double) > 0.6 "
           "qualify row_number() over (partition by raw_id order by sim desc, address_id) = 1"),
    ("chosen", "select h.raw_id, case h.src when 'e' then e_id when 's1' then s1_id when 's2' then s2_id "
               "else fb.f_id end address_id, case when h.src = 'e' then 'exact' when h.src is not null then 'smart' "
               "when fb.f_id is not null then 'fuzzy' end strategy, "
               "case h.src when 'e' then 'Match found' when 's1' then (case when s1_n = 1 then 'Unique match found' "
               "else 'Match found (' || cast(s1_n as varchar) || ' matches)' end) when 's2' then (case when s2_n = 1 "
               "then 'Unique match found' else 'Match found (' || cast(s2_n as varchar) || ' matches)' end) end msg, "
               "fb.f_sim sim from hit h left join fb on fb.raw_id = h.raw_id"),
    ("cpts", "select distinct c.address_id, a.gx, a.gy from chosen c join addr a on a.address_id = c.address_id"),
]

VERIFY_BODY = """
, vres AS (
select c.raw_id, c.address_id is not null exists_in_source, c.address_id, a.full_address, a.x_coord x, a.y_coord y,
  rh.region_id, rh.district_id, rh.suburb_id,
  case when c.address_id is null then 'Address not found in LINZ data'
       when c.strategy = 'fuzzy' then 'Fuzzy match found (similarity: ' || printf('%.2f', cast(c.sim as double)) || ')'
       else c.msg end message,
  coalesce(c.strategy, 'none') strategy
from chosen c left join addr a on a.address_id = c.address_id left join rh on rh.address_id = c.address_id
union all
select raw_id, false, cast(null as bigint), cast(null as varchar), cast(null as double), cast(null as double),
  cast(null as varchar), cast(null as varchar), cast(null as varchar), 'Address cannot be empty', 'blank'
from pv where blank)
"""


def _verify_sql(select: str) -> str:
    extra = PARSE + MATCH + _resolve("cpts", "address_id", "gx", "gy")
    body = with_fx(["fx_raw", "addr"] + RESOLVE_DEPS, "", extra)
    return body.rstrip() + VERIFY_BODY + select


ORACLE: dict[str, str] = {}

ORACLE["regions_browse"] = with_fx(["fx_suburb"], """
select r.region_id, printf('R%02d', cast(r.region_id as int)) code, r.name,
  count(distinct d.district_id) district_count, count(distinct s.suburb_id) suburb_count
from (select cast(r_regionkey as varchar) region_id, r_name name from region) r
left join (select cast(n_nationkey as varchar) district_id, cast(n_regionkey as varchar) region_id from nation) d
  on d.region_id = r.region_id
left join fx_suburb s on s.district_id = d.district_id
group by r.region_id, r.name""")

ORACLE["districts_browse"] = with_fx(["fx_suburb"], """
select d.district_id, d.region_id, printf('D%04d', cast(d.district_id as int)) code, d.name official_name,
  coalesce((select market_name from aliases a where a.district_id = d.district_id and a.is_primary
            order by alias_id limit 1), d.name) display_name,
  count(distinct s.suburb_id) suburb_count,
  count(distinct s.suburb_id) filter (where s.is_major_suburb) major_suburb_count
from (select cast(n_nationkey as varchar) district_id, cast(n_regionkey as varchar) region_id, n_name name
      from nation) d
left join subs s on s.district_id = d.district_id
group by d.district_id, d.region_id, d.name""", [CLASSIFY, ALIASES])

ORACLE["suburbs_browse"] = with_fx(["fx_suburb", "addr", "sub_edge", "sub_bbox"], """
select s.suburb_id, s.district_id, s.name, s.major_name, s.is_major_suburb, s.population_category,
  count(distinct st.street_name) street_count, case when s.is_major_suburb then 0 else 1 end sort_priority
from subs s left join streets st on st.suburb_id = s.suburb_id
group by s.suburb_id, s.district_id, s.name, s.major_name, s.is_major_suburb, s.population_category""",
                                   [CLASSIFY, STREETS])

WS = "'[\\t\\n\\v\\f\\r\\x{85}\\pZ]+'"
ORACLE["normalize_documents"] = """
select doc_id, norm, len(list_filter(string_split(norm, ' '), lambda t: t <> '')) n_tokens from (
  select doc_id, coalesce(trim(regexp_replace(translate(lower(text), ',.', '  '), WS, ' ', 'g')), '') norm
  from documents)""".replace("WS", WS)

ORACLE["to_ascii_documents"] = f"""
select doc_id, ascii, length(ascii) n_chars from (
  select doc_id, translate(text, '{ASCII_FROM}', '{ASCII_TO}') ascii from documents)"""

ORACLE["parse_requests"] = with_fx(["fx_raw"], """
select raw_id, norm, ntok, ex_number, ex_road, sm_number, sm_street1, sm_city1, sm_street2, sm_city2 from pv""",
                                   PARSE)

ORACLE["request_similarity"] = with_fx(["fx_raw", "addr"], f"""
select raw_id, address_id, round(cast(cast(case when len(a) = 0 or len(b) = 0 then 0.0 else
  cast(len(list_intersect(a, b)) as double) / len(list_distinct(list_concat(a, b))) end as float) as double), 6) sim
from (select r.raw_id, x.address_id,
   {_trigrams("coalesce(trim(regexp_replace(translate(lower(r.raw_address), ',.', '  '), '\\s+', ' ', 'g')), '')")} a,
   {_trigrams("x.full_address_ascii")} b
  from fx_raw r join addr x on x.address_id = (r.raw_id * 13) % (select count(*) from orders))""")

ORACLE["load_addresses"] = with_fx(["addr"], """
select address_id, full_address, full_address_ascii, full_road_name, full_road_name_ascii, address_number_prefix,
  address_number, address_number_suffix, suburb_locality, suburb_locality_ascii, town_city, territorial_authority,
  x_coord, y_coord, round(gx, 2) gx, round(gy, 2) gy from addr""")

ORACLE["upsert_addresses"] = with_fx(["fx_address"], f"""
select address_id, full_road_name, translate(full_road_name, '{ASCII_FROM}', '{ASCII_TO}') full_road_name_ascii
from fx_address where (address_id % 3 = 0 or address_id % 2 = 1) and x_coord is not null and y_coord is not null
  and address_lifecycle = 'Current'
union all
select address_id, full_road_name, translate(full_road_name, '{ASCII_FROM}', '{ASCII_TO}') from fx_address
where address_id % 2 = 0 and x_coord is not null and y_coord is not null and address_lifecycle = 'Current'
  and address_id not in (select address_id from fx_address where (address_id % 3 = 0 or address_id % 2 = 1) and x_coord is not null
                         and y_coord is not null and address_lifecycle = 'Current')""").replace(
    "select address_id, full_road_name, translate(full_road_name", "select address_id, full_road_name || ' Extension' "
    "full_road_name, translate(full_road_name || ' Extension'", 1)

ORACLE["insert_absent_aliases"] = """
select district_id, market_name from nation_x where cast(district_id as int) % 3 = 0
union all
select district_id, market_name from (
  select district_id, market_name, row_number() over (partition by district_id order by market_name) rn from (
    select district_id, market_name from nation_x
    union all select district_id, market_name || ' B' from nation_x)) where rn = 1
  and district_id not in (select district_id from nation_x where cast(district_id as int) % 3 = 0)""".replace(
    "nation_x", "(select cast(n_nationkey as varchar) district_id, n_name market_name from nation)")

ORACLE["classify_suburbs"] = with_fx(["fx_suburb"], """
select suburb_id, name, major_name, population_category, is_major_suburb from subs""", [CLASSIFY])

ORACLE["population_breakdown"] = with_fx(["fx_suburb"], """
select population_category, count(*) count, round(100.0e0 * count(*) / sum(count(*)) over (), 1) percentage,
  case population_category when 'major' then 1 when 'medium' then 2 when 'minor' then 3 else 4 end sort_order
from subs group by population_category""", [CLASSIFY])

ORACLE["project_nztm"] = with_fx(["fx_address"], """
select address_id, round(gx, 2) gx, round(gy, 2) gy from p""",
                                 [("p", _nztm_stage("fx_address", "x_coord", "y_coord", "address_id"))])


def _inverse_sql() -> str:
    xi = "((y - 10000000.0e0) / " + repr(_KA) + ")"
    eta = "((x - 1600000.0e0) / " + repr(_KA) + ")"
    s1 = f"select address_id, {xi} _xi, {eta} _eta from fx_point"
    xi1 = "_xi" + "".join(f" - {b!r} * sin({2 * j}.0e0 * _xi) * cosh({2 * j}.0e0 * _eta)"
                          for j, b in enumerate(BETA, 1))
    eta1 = "_eta" + "".join(f" - {b!r} * cos({2 * j}.0e0 * _xi) * sinh({2 * j}.0e0 * _eta)"
                            for j, b in enumerate(BETA, 1))
    s2 = f"select address_id, {xi1} _xi1, {eta1} _eta1 from ({s1})"
    s3 = f"select *, asin(sin(_xi1) / cosh(_eta1)) _chi from ({s2})"
    phi = "_chi" + "".join(f" + {d!r} * sin({2 * j}.0e0 * _chi)" for j, d in enumerate(DELTA, 1))
    lon = f"({NZTM_LON0!r} + degrees(atan2(sinh(_eta1), cos(_xi1))))"
    return (f"select address_id, round(case when {lon} > 180.0e0 then {lon} - 360.0e0 else {lon} end, 7) lon, "
            f"round(degrees({phi}), 7) lat from ({s3})")


ORACLE["unproject"] = with_fx(["fx_point"], _inverse_sql())


def _area_sql(vertex: str, key: str, kind: str) -> str:
    e = _edges(vertex, key)
    return (f"select '{kind}' kind, e.{key} id, round(abs(sum(ax * bny - bx * ay)) / 2.0e0, 0) area, "
            f"min(b.minx) minx, min(b.miny) miny, max(b.maxx) maxx, max(b.maxy) maxy "
            f"from ({e}) e join ({_bbox(vertex, key)}) b on b.{key} = e.{key} group by e.{key}")


ORACLE["polygon_area"] = with_fx(["fx_suburb_vertex", "fx_district_vertex", "fx_region_vertex"],
                                 _area_sql("fx_suburb_vertex", "suburb_id", "suburb") + " union all "
                                 + _area_sql("fx_district_vertex", "district_id", "district") + " union all "
                                 + _area_sql("fx_region_vertex", "region_id", "region"))

ORACLE["pip_join"] = with_fx(["fx_point", "sub_edge", "sub_bbox"],
                             _pip("fx_point", "address_id", "x", "y", "sub", "suburb_id"))

ORACLE["resolve_hierarchy"] = with_fx(["fx_point"] + RESOLVE_DEPS, """
select address_id, region_id, district_id, suburb_id from rh""", _resolve("fx_point", "address_id", "x", "y"))

ORACLE["streets_by_suburb"] = with_fx(["addr", "sub_edge", "sub_bbox"], "select suburb_id, street_name from streets",
                                      [STREETS])

ORACLE["nearest_address"] = with_fx(["addr", "fx_probe"] + RESOLVE_DEPS, """
select q.point_id, nn.address_id is not null exists_in_source, nn.address_id, a.full_address, a.x_coord x,
  a.y_coord y, rh.region_id, rh.district_id, rh.suburb_id, round(nn.d, 2) distance,
  case when nn.address_id is null then 'No address found near the specified coordinates'
       when nn.d > 100 then 'Nearest address found (Warning: Nearest address is ' || printf('%.0f', nn.d) || 'm away)'
       else 'Nearest address found' end message
from q left join nn on nn.point_id = q.point_id left join addr a on a.address_id = nn.address_id
left join rh on rh.address_id = nn.address_id""", [
    ("q", _nztm_stage("fx_probe", "lon", "lat", "point_id")),
    ("nn", "select q.point_id, a.address_id, sqrt((a.gx - q.gx) * (a.gx - q.gx) + (a.gy - q.gy) * (a.gy - q.gy)) d "
           "from q, addr a qualify row_number() over (partition by q.point_id order by "
           "sqrt((a.gx - q.gx) * (a.gx - q.gx) + (a.gy - q.gy) * (a.gy - q.gy)), a.address_id) = 1"),
    ("npts", "select distinct nn.address_id, a.gx, a.gy from nn join addr a on a.address_id = nn.address_id"),
] + _resolve("npts", "address_id", "gx", "gy"))

# districts and regions are axis-parallel rectangles in the fixture: the
# overlap area is the product of the interval overlaps.
ORACLE["region_by_overlap"] = with_fx(["dis_bbox", "reg_bbox"], """
select district_id, region_id, round(ov, 0) overlap_area from (
  select d.district_id, r.region_id,
    (least(d.maxx, r.maxx) - greatest(d.minx, r.minx)) * (least(d.maxy, r.maxy) - greatest(d.miny, r.miny)) ov
  from dis_bbox d left join reg_bbox r on least(d.maxx, r.maxx) >= greatest(d.minx, r.minx)
   and least(d.maxy, r.maxy) >= greatest(d.miny, r.miny))
qualify row_number() over (partition by district_id order by ov desc, region_id) = 1""")

# rectangle: the point on surface is the bbox centre; intersects = inside or on the boundary.
ORACLE["district_by_point"] = with_fx(["dis_bbox", "reg_bbox"], """
select d.district_id, coalesce(min(r.region_id), '99') region_id, n.n_name name
from dis_bbox d join nation n on cast(n.n_nationkey as varchar) = d.district_id
left join reg_bbox r on (d.minx + d.maxx) / 2 between r.minx and r.maxx and (d.miny + d.maxy) / 2 between r.miny and r.maxy
group by d.district_id, n.n_name""")

ORACLE["verify"] = _verify_sql("select * from vres")

ORACLE["coordinates_for_address"] = _verify_sql("""
select raw_id, exists_in_source and x is not null and y is not null success,
  case when exists_in_source and x is not null and y is not null then y end latitude,
  case when exists_in_source and x is not null and y is not null then x end longitude,
  case when exists_in_source and x is not null and y is not null then 'Coordinates found successfully'
       else message end message, address_id
from vres""")

ORACLE["autocomplete"] = with_fx(["fx_query", "addr"], """
select query_id, rank, address_id, full_address, street_name, suburb, city, postal_code from (
  select q.query_id, row_number() over (partition by q.query_id order by
      case when a.full_address_ascii ilike q.q || '%' then 0 else 1 end, a.full_address_ascii, a.address_id) rank,
    a.address_id, a.full_address, a.full_road_name street_name, a.suburb_locality suburb, a.town_city city,
    cast(null as varchar) postal_code
  from (select query_id, trim(query) q from fx_query
        where query is not null and trim(query) <> '' and length(query) >= 3) q
  join addr a on a.full_address_ascii ilike '%' || q.q || '%')
where rank <= 10""")

LISTINGS = ("lst", "select distinct p[1] suburb from (select string_split(u, '/') p from (select "
                   "unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) u from pages)) where len(p) = 1")

ORACLE["extract_listings"] = with_fx([], "select suburb from lst", [LISTINGS])

ORACLE["compare_localities"] = with_fx(["fx_suburb"], """
select 1 ord, 'Total listing suburbs' metric, cast(count(*) as varchar) count from lk
union all select 2, 'Total reference suburbs', cast(count(*) as varchar) from sk
union all select 3, 'Suburbs in both', cast(count(*) as varchar) from lk join sk on lk.k = sk.k
union all select 4, 'Only in listings', cast(count(*) as varchar) from lk where k not in (select k from sk where k is not null)
union all select 5, 'Only in reference', cast(count(*) as varchar) from sk where k not in (select k from lk where k is not null)
""", [LISTINGS, ("lk", "select lower(trim(replace(suburb, '-', ' '))) k from lst"),
      ("sk", "select lower(trim(name)) k from fx_suburb")])

ORACLE["quality_checks"] = with_fx(["fx_suburb", "addr", "sub_edge", "sub_bbox"], """
select 'regions' table_name, count(*) row_count from region
union all select 'districts', count(*) from nation
union all select 'suburbs', count(*) from fx_suburb
union all select 'addresses', count(*) from addr
union all select 'streets_by_suburb', count(*) from streets""", [STREETS])

ORACLE["top_suburbs_by_streets"] = with_fx(["fx_suburb", "addr", "sub_edge", "sub_bbox"], """
select s.suburb_id, s.name suburb_name, n.n_name district_name, count(distinct st.street_name) street_count
from fx_suburb s left join nation n on cast(n.n_nationkey as varchar) = s.district_id
left join streets st on st.suburb_id = s.suburb_id
group by s.suburb_id, s.name, n.n_name order by street_count desc, s.suburb_id limit 10""", [STREETS])

ORACLE["orphan_checks"] = with_fx(["fx_suburb"], """
select 'districts_without_region' metric, count(*) value from nation
  where cast(n_regionkey as varchar) not in (select cast(r_regionkey as varchar) from region)
union all select 'suburbs_without_district', count(*) from fx_suburb
  where district_id not in (select cast(n_nationkey as varchar) from nation)
union all select 'districts_null_region', count(*) filter (where n_regionkey is null) from nation
union all select 'suburbs_null_district', count(*) filter (where district_id is null) from fx_suburb
union all select 'regions_duplicate_id', count(*) - count(distinct r_regionkey) from region
union all select 'districts_duplicate_id', count(*) - count(distinct n_nationkey) from nation
union all select 'suburbs_duplicate_id', count(*) - count(distinct suburb_id) from fx_suburb
union all select 'regions_null_geometry', 0 from region limit 8""")

ORACLE["entity_report"] = with_fx([], """
select 'Regions' entity, count(*) count, string_agg(r_name, ', ' order by r_name) filter (where regexp_matches(r_name, '^[A-Z]')) sample_names from region
union all select 'Districts', count(*), null from nation
union all select 'District Aliases', count(*), null from aliases
union all select 'Suburbs', (select count(*) from supplier), null""", [ALIASES])

ORACLE["coverage_summary"] = with_fx(["fx_address", "addr"] + RESOLVE_DEPS, """
select (select count(*) from fx_address) feed_rows, (select count(*) from addr) loaded,
  (select count(*) from addr where gx is not null and gy is not null) geocoded,
  (select count(*) from rh where suburb_id is not null) linked_suburb,
  (select count(*) from rh where district_id is not null) linked_district,
  round(100.0e0 * (select count(*) from addr where gx is not null) / (select count(*) from addr), 2) geocoded_pct,
  round(100.0e0 * (select count(*) from rh where suburb_id is not null) / (select count(*) from addr), 2)
    linked_suburb_pct""", _resolve("addr", "address_id", "gx", "gy"))

# ---------------------------------------------------------------------------
# nested documents, centroids
# ---------------------------------------------------------------------------

_SNR = ("supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey")

ORACLE["extract_regions"] = f"select distinct 'R02' region_id, r_name name from {_SNR}"

ORACLE["extract_hierarchy"] = f"""
select printf('S%05d', s_suppkey) suburb_id, printf('D%04d', n_nationkey) district_id, s_name name,
  true is_major_suburb, 'high' population_category, printf('R%02d', r_regionkey + 1) region_id
from {_SNR} where r_regionkey <> 4 and s_suppkey % 9 <> 4"""

_GAZ = (f"select case when s_suppkey % 3 = 0 then 'Locality ' || cast(s_suppkey % 97 as varchar) || ', ' || n_name "
        f"when s_suppkey % 3 = 1 then 'Mount Eden, ' || r_name else 'Saint Heliers, ' || n_name end "
        f"|| ', New Zealand' query_text, -47.0e0 + (s_suppkey % 100) / 10.0e0 lat, "
        f"167.0e0 + (s_suppkey % 70) / 10.0e0 lon from {_SNR}")


def _variant(rank: int, expr: str) -> str:
    return f"select suburb_id, {rank} rank, {expr} query_text from s2 where x1 is null and x2 is null"


_CENTROIDS = [
    ("s", "select f.suburb_id, f.name, n.n_name district_name, r.r_name region_name, "
          "regexp_replace(regexp_replace(f.name, '\\bMt\\b', 'Mount', 'g'), '\\bSt\\b', 'Saint', 'g') expanded "
          "from fx_suburb f join nation n on cast(n.n_nationkey as varchar) = f.district_id "
          "left join region r on r.r_regionkey = n.n_regionkey"),
    ("bn", "select lower(trim(suburb_locality)) k, arg_min(gx, address_id) ax, arg_min(gy, address_id) ay "
           "from addr group by 1"),
    ("s2", "select s.*, b1.ax x1, b1.ay y1, b2.ax x2, b2.ay y2 from s left join bn b1 on b1.k = lower(s.name) "
           "left join bn b2 on s.expanded <> s.name and b2.k = lower(s.expanded)"),
    ("qv", "select * from (" + " union all ".join([
        _variant(1, "case when name = 'City Centre' then district_name || ', New Zealand' "
                    "else name || ', ' || district_name || ', New Zealand' end"),
        _variant(2, "case when name <> 'City Centre' and expanded <> name then "
                    "expanded || ', ' || district_name || ', New Zealand' end"),
        _variant(3, "case when district_name like '% City' then expanded || ', ' || "
                    "regexp_replace(district_name, ' City$', '') || ', New Zealand' end"),
        _variant(4, "case when district_name like '% Island' then expanded || ', ' || "
                    "regexp_replace(district_name, ' Island$', '') || ', New Zealand' end"),
        _variant(5, "case when district_name in ('Manukau City', 'North Shore City', 'Waitakere City', 'Rodney', "
                    "'Franklin') then expanded || ', Auckland, New Zealand' end"),
        _variant(6, "case when region_name is not null and region_name <> district_name then "
                    "expanded || ', ' || region_name || ', New Zealand' end"),
    ]) + ") where query_text is not null"),
    ("gz", "select query_text, lat, lon from (" + _GAZ + ") qualify row_number() over "
           "(partition by query_text order by lat, lon) = 1"),
    ("gh", "select qv.suburb_id, qv.query_text, gz.lat, gz.lon from qv join gz on gz.query_text = qv.query_text "
           "qualify row_number() over (partition by qv.suburb_id order by qv.rank, qv.query_text) = 1"),
    ("gp", _nztm_stage("gh", "lon", "lat", "suburb_id, query_text")),
    ("cres", "select s2.suburb_id, case when x1 is not null then 'address' when x2 is not null then "
             "'address_expanded' when gp.gx is not null then 'gazetteer' end source, gp.query_text, "
             "coalesce(x1, x2, gp.gx) cx, coalesce(y1, y2, gp.gy) cy from s2 left join gp on gp.suburb_id = s2.suburb_id"),
]

ORACLE["fill_centroids"] = with_fx(["fx_suburb", "addr"], """
select suburb_id, source, query_text, round(cx, 2) centroid_x, round(cy, 2) centroid_y from cres""", _CENTROIDS)

ORACLE["centroid_coverage"] = with_fx(["fx_suburb", "addr"], """
select count(*) total, count(*) filter (where cx is not null) with_centroid,
  count(*) filter (where cx is null) without_centroid,
  round(100.0e0 * count(*) filter (where cx is not null) / count(*), 1) percentage from cres""", _CENTROIDS)

ORACLE["centroid_job_summary"] = with_fx(["fx_suburb", "addr"], """
select count(*) processed, count(*) filter (where source is not null) ok,
  count(*) filter (where source is null) failed,
  round(100.0e0 * count(*) filter (where source is not null) / count(*), 1) success_pct from cres""", _CENTROIDS)

# ---------------------------------------------------------------------------
# suburb -> district cascade, polygon distance (brute force over vertex x edge)
# ---------------------------------------------------------------------------

FX["mv_vertex"] = ("select v.suburb_id, v.seq, case when cast(v.suburb_id as bigint) % 7 = 0 then "
                   "v.x - 200000.0e0 * (s.nk % 5) - 250000.0e0 else v.x end x, v.y "
                   "from fx_suburb_vertex v join fx_suburb s on s.suburb_id = v.suburb_id")
DEPS["mv_vertex"] = ["fx_suburb_vertex", "fx_suburb"]
FX["mv_edge"] = _edges("mv_vertex", "suburb_id")
DEPS["mv_edge"] = ["mv_vertex"]
ORDER[:] = list(FX.keys())


def _pseg(px, py, e):
    t = (f"greatest(0.0e0, least(1.0e0, (({px} - {e}.ax) * ({e}.bx - {e}.ax) + ({py} - {e}.ay) * ({e}.bny - {e}.ay)) / "
         f"(({e}.bx - {e}.ax) * ({e}.bx - {e}.ax) + ({e}.bny - {e}.ay) * ({e}.bny - {e}.ay))))")
    return (f"sqrt(({px} - ({e}.ax + {t} * ({e}.bx - {e}.ax))) * ({px} - ({e}.ax + {t} * ({e}.bx - {e}.ax))) + "
            f"({py} - ({e}.ay + {t} * ({e}.bny - {e}.ay))) * ({py} - ({e}.ay + {t} * ({e}.bny - {e}.ay))))")


_PD = [
    # districts are rectangles and no suburb crosses or holds one, so a suburb
    # meets a district if one of its vertices lies in it
    ("pd", "select suburb_id, district_id, min(d) distance from ("
           "select v.suburb_id, e.district_id, " + _pseg("v.x", "v.y", "e") + " d from mv_vertex v "
           "join dis_edge e on true "
           "union all select e.suburb_id, v.district_id, " + _pseg("v.x", "v.y", "e") + " d from fx_district_vertex v "
           "join mv_edge e on true "
           "union all select v.suburb_id, b.district_id, 0.0e0 from mv_vertex v join dis_bbox b "
           "on v.x between b.minx and b.maxx and v.y between b.miny and b.maxy) group by suburb_id, district_id"),
]

ORACLE["polygon_distance"] = with_fx(["mv_vertex", "mv_edge", "dis_edge", "dis_bbox", "fx_district_vertex"], """
select suburb_id, district_id, round(distance, 1) distance from pd where distance <= 300000.0e0""", _PD)

ORACLE["suburb_district_cascade"] = with_fx(["mv_vertex", "mv_edge", "dis_edge", "dis_bbox", "fx_district_vertex"], """
select suburb_id, district_id, case when distance = 0 then 'contains' else 'nearest' end as method,
  round(distance, 1) distance from pd
qualify row_number() over (partition by suburb_id order by distance, district_id) = 1""", _PD)

ORACLE["addresses_per_suburb"] = with_fx(["fx_point"] + RESOLVE_DEPS, """
select rh.suburb_id, s.name suburb_name, count(*) address_count from rh join fx_suburb s on s.suburb_id = rh.suburb_id
where rh.suburb_id is not null group by rh.suburb_id, s.name order by address_count desc, rh.suburb_id limit 10""",
                                        _resolve("fx_point", "address_id", "x", "y"))
