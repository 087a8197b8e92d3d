"""Oracle SQL (DuckDB) of the road-network queries, on the same fixture views."""

from __future__ import annotations

from wayforge.functions.tags import ARROWS, ROAD_CLASSES, ROAD_CLASSES_LIVING
from wayforge.sources.fixtures import VIEWS

PI = "3.141592653589793"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def mod(a: str, n: str) -> str:
    return f"(({a}) - ({n}) * floor(({a}) / ({n})))"


def azimuth(x1, y1, x2, y2) -> str:
    return mod(f"degrees(atan2({x2} - {x1}, {y2} - {y1})) + 360e0", "360e0")


def adiff(a, b) -> str:
    return f"abs({mod(f'{b} - {a} + 180e0', '360e0')} - 180e0)"


def mx(lon) -> str:
    return f"(radians({lon}) * 6378137e0)"


def my(lat) -> str:
    return f"(ln(tan({PI}/4 + radians({lat})/2)) * 6378137e0)"


def geo(lon1, lat1, lon2, lat2) -> str:
    w = f"sqrt(1 - 0.00669437999014e0 * pow(sin(radians(({lat1} + {lat2})/2)), 2))"
    return (f"sqrt(pow(radians({lat2} - {lat1}) * (6378137e0 * (1 - 0.00669437999014e0)) / pow({w}, 3), 2) + "
            f"pow(radians({lon2} - {lon1}) * 6378137e0 / {w} * cos(radians(({lat1} + {lat2})/2)), 2))")


def seg_t(px, py, ax, ay, bx, by) -> str:
    return (f"(case when pow({bx}-{ax},2)+pow({by}-{ay},2) > 0 then least(greatest((({px}-{ax})*({bx}-{ax}) + ({py}-{ay})*({by}-{ay})) / (pow({bx}-{ax},2)+pow({by}-{ay},2)), 0e0), 1e0) else 0e0 end)")


def seg_d(px, py, ax, ay, bx, by) -> str:
    t = seg_t(px, py, ax, ay, bx, by)
    return f"sqrt(pow({px} - ({ax} + {t}*({bx}-{ax})), 2) + pow({py} - ({ay} + {t}*({by}-{ay})), 2))"


def q(body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{VIEWS}{body}"


TRAVERSABLE = "junction is null and coalesce(oneway not in ('yes','-1','1'), true)"
LOOP_START = "not (coalesce(junction in ('roundabout','circular'), false) or coalesce(oneway in ('yes','-1','1'), false))"
STATE = ("case when lower(trim(coalesce({0}, ''))) in ('yes','true','1','forward') then 'forward' "
         "when lower(trim(coalesce({0}, ''))) in ('-1','reverse','backward') then 'reverse' else 'bidirectional' end")

MLINES = f""", ml as (select way_id, oneway, highway, {mx('lon1')} as x1, {my('lat1')} as y1, {mx('lon2')} as x2, {my('lat2')} as y2 from fx_way_lines),
ms as (select event_id, cast(angle as double) as angle, {mx('lon')} as x, {my('lat')} as y from fx_signs)"""
PAIRS = MLINES + f""", sp as (select s.event_id, s.angle, l.way_id, l.oneway, l.highway, l.x1, l.y1, l.x2, l.y2,
 {seg_t('s.x', 's.y', 'l.x1', 'l.y1', 'l.x2', 'l.y2')} as t, {seg_d('s.x', 's.y', 'l.x1', 'l.y1', 'l.x2', 'l.y2')} as d
 from ms s join ml l on s.x between least(l.x1,l.x2)-30 and greatest(l.x1,l.x2)+30 and s.y between least(l.y1,l.y2)-30 and greatest(l.y1,l.y2)+30)"""

LOOPS = f""", le as (select way_id, a, b, {geo('lon1', 'lat1', 'lon2', 'lat2')} as cost from fx_way_lines where {TRAVERSABLE}),
step as (select way_id, a as src, b as dst, cost from le union all select way_id, b, a, cost from le where a <> b),
starts as (select distinct a as node from fx_ways where {LOOP_START}),
walk(start, cur, path, cost) as (
 select src, dst, [way_id], s.cost from starts join step s on src = node where s.cost <= 200
 union all
 select w.start, s.dst, list_append(w.path, s.way_id), w.cost + s.cost from walk w join step s on s.src = w.cur
 where w.cur <> w.start and w.cost + s.cost <= 200 and not list_contains(w.path, s.way_id)),
loops as (select path from walk where cur = start)"""

W8 = ", w8 as (select node_id, sum(case when seq = 1 then 2 else 1 end) as weight from fx_way_nodes group by 1)"

NET = f""", na as (select way_id as id, {mx('lon1')} as x1, {my('lat1')} as y1, {mx('lon2')} as x2, {my('lat2')} as y2 from fx_way_lines),
nb as (select way_id as id, {mx('lon1')} as x1, {my('lat1')} as y1, {mx('lon2')} as x2, {my('lat2')} as y2 from fx_roads_b),
nc as (select a.id as i, b.id as j, a.x1, a.y1, a.x2, a.y2, b.x1 as u1, b.y1 as v1, b.x2 as u2, b.y2 as v2,
 {seg_d('a.x1', 'a.y1', 'b.x1', 'b.y1', 'b.x2', 'b.y2')} as d1, {seg_d('a.x2', 'a.y2', 'b.x1', 'b.y1', 'b.x2', 'b.y2')} as d2,
 {seg_d('b.x1', 'b.y1', 'a.x1', 'a.y1', 'a.x2', 'a.y2')} as d3, {seg_d('b.x2', 'b.y2', 'a.x1', 'a.y1', 'a.x2', 'a.y2')} as d4,
 ((a.x2-a.x1)*(b.y1-a.y1)-(a.y2-a.y1)*(b.x1-a.x1))*((a.x2-a.x1)*(b.y2-a.y1)-(a.y2-a.y1)*(b.x2-a.x1)) < 0 and
 ((b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1))*((b.x2-b.x1)*(a.y2-b.y1)-(b.y2-b.y1)*(a.x2-b.x1)) < 0 as crossing
 from na a join nb b on greatest(least(a.x1,a.x2)-20, least(b.x1,b.x2)) <= least(greatest(a.x1,a.x2)+20, greatest(b.x1,b.x2)) and greatest(least(a.y1,a.y2)-20, least(b.y1,b.y2)) <= least(greatest(a.y1,a.y2)+20, greatest(b.y1,b.y2))),
nd as (select *, case when crossing then 0e0 else least(d1, d2, d3, d4) end as distance, greatest(d1, d2, d3, d4) as hausdorff,
 sqrt(pow(x2-x1,2)+pow(y2-y1,2)) as la, sqrt(pow(u2-u1,2)+pow(v2-v1,2)) as lb from nc),
nm as (select *, least(la,lb)/greatest(la,lb) as ratio, abs(((x2-x1)*(u2-u1)+(y2-y1)*(v2-v1))/(la*lb)) as similarity,
 (select count(*) from range(0, 21) t(k) where {seg_d('(x1 + k/20e0*(x2-x1))', '(y1 + k/20e0*(y2-y1))', 'u1', 'v1', 'u2', 'v2')} <= 10)/21e0 as overlap from nd where distance <= 20),
ns as (select *, 0.3e0*(1-least(hausdorff/40e0,1e0)) + 0.25e0*ratio + 0.25e0*overlap + 0.2e0*(similarity+1)/2 as score from nm),
good as (select i, j, round(score, 6) as score, round(distance, 3) as distance from ns where ratio >= 0.3 and overlap >= 0.3 and similarity >= 0.7)"""
DIRECTIONS = f""", a as (select way_id, {STATE.format('oneway')} as s, lon1, lat1, lon2, lat2 from fx_way_lines where coalesce(junction not in ('roundabout', 'circular'), true)),
b as (select way_id, {STATE.format('oneway')} as s, lon1, lat1, lon2, lat2 from fx_roads_b),
g as (select i, j, a.s <> 'bidirectional' as one_a, b.s <> 'bidirectional' as one_b,
 (case when a.s = 'reverse' then -1 else 1 end) * (case when b.s = 'reverse' then -1 else 1 end) * ((a.lon2-a.lon1)*(b.lon2-b.lon1)+(a.lat2-a.lat1)*(b.lat2-b.lat1)) / (sqrt(pow(a.lon2-a.lon1,2)+pow(a.lat2-a.lat1,2))*sqrt(pow(b.lon2-b.lon1,2)+pow(b.lat2-b.lat1,2))) as cosine
 from best join a on a.way_id = i join b on b.way_id = j),
k as (select *, case when cosine > 0.7 then 'same' when cosine < -0.7 then 'opposite' else 'mixed' end as kind from g)
select i, j, case when one_a and one_b then concat(kind, '_direction') when one_a then concat('oneway_to_bidirectional_', kind) else concat('bidirectional_to_oneway_', kind) end as status from k where one_a or one_b"""

PROJ = f""", pa as (select way_id as id, {mx('lon1')} as x1, {my('lat1')} as y1, {mx('lon2')} as x2, {my('lat2')} as y2 from fx_way_lines),
pb as (select way_id as id, {mx('lon1')} as x1, {my('lat1')} as y1, {mx('lon2')} as x2, {my('lat2')} as y2 from fx_roads_b),
pc as (select a.id as i, b.id as j, abs(((a.x2-a.x1)*(b.x2-b.x1)+(a.y2-a.y1)*(b.y2-b.y1))/(sqrt(pow(a.x2-a.x1,2)+pow(a.y2-a.y1,2))*sqrt(pow(b.x2-b.x1,2)+pow(b.y2-b.y1,2)))) as similarity,
 k, {seg_d('(a.x1 + k/4e0*(a.x2-a.x1))', '(a.y1 + k/4e0*(a.y2-a.y1))', 'b.x1', 'b.y1', 'b.x2', 'b.y2')} as d
 from pa a join pb b on greatest(least(a.x1,a.x2)-15, least(b.x1,b.x2)) <= least(greatest(a.x1,a.x2)+15, greatest(b.x1,b.x2)) and greatest(least(a.y1,a.y2)-15, least(b.y1,b.y2)) <= least(greatest(a.y1,a.y2)+15, greatest(b.y1,b.y2)),
 range(0, 5) t(k)),
pp as (select i, j, max(similarity) as similarity, round(avg(d), 4) as distance, count(*) filter (where d <= 15)/5e0 as coverage from pc group by all),
pm as (select i, j, distance, coverage from pp where similarity > 0.7 and coverage >= 0.6 and distance <= 15 qualify row_number() over (partition by i order by distance, j) = 1)"""

CHAINS = f""", cw as (select way_id, {STATE.format('oneway')} as s, concat(a, '/', highway) as a, concat(b, '/', highway) as b from fx_ways),
ends as (select way_id, s <> 'bidirectional' as oneway, case when s = 'reverse' then b else a end as node_id, true as is_start from cw
 union all select way_id, s <> 'bidirectional', case when s = 'reverse' then a else b end, false from cw),
links as (select distinct x.way_id as a, y.way_id as b from ends x join ends y on x.node_id = y.node_id and x.way_id < y.way_id and x.oneway = y.oneway and (not x.oneway or x.is_start <> y.is_start)
 where x.node_id not in (select node_id from ends group by 1 having count(*) >= 3)),
cl(node, root) as (select a, a from links union select b, b from links union select case when l.a = c.node then l.b else l.a end, c.root from cl c join links l on l.a = c.node or l.b = c.node),
chains as (select node, min(root) as root from cl group by 1)"""

PIX = """, pl as (select image, line_idx, cast(x1 as double) x1, cast(y1 as double) y1, cast(x2 as double) x2, cast(y2 as double) y2, cast(x2-x1 as double) dx, cast(y2-y1 as double) dy,
 sqrt(pow(x2-x1,2)+pow(y2-y1,2)) as length, floor((x1+x2)/2e0) as mx, floor((y1+y2)/2e0) as my,
 case when abs(x2-x1) < 0.001 then 90e0 else degrees(atan((y2-y1)/cast(x2-x1 as double))) end as an from fx_lines),
pa as (select *, case when an < 0 then an + 180 else an end as angle from pl),
pj as (select a.image, a.line_idx as i, b.line_idx as j, least(abs(a.angle-b.angle), 180-abs(a.angle-b.angle)) as angle_diff,
 abs(a.dy*(b.mx-a.x1) - a.dx*(b.my-a.y1))/a.length as distance, least(a.length,b.length)/greatest(a.length,b.length) as length_ratio, least(a.length,b.length) as shorter,
 (a.dx*b.dx+a.dy*b.dy)/(a.length*b.length) as cosine,
 a.x1*cos(radians(a.angle))+a.y1*sin(radians(a.angle)) as p, a.x2*cos(radians(a.angle))+a.y2*sin(radians(a.angle)) as q,
 b.x1*cos(radians(a.angle))+b.y1*sin(radians(a.angle)) as s, b.x2*cos(radians(a.angle))+b.y2*sin(radians(a.angle)) as t
 from pa a join pa b on a.image = b.image and a.line_idx < b.line_idx and least(abs(a.angle-b.angle), 180-abs(a.angle-b.angle)) <= 12),
pk as (select *, greatest(0e0, least(greatest(p,q),greatest(s,t)) - greatest(least(p,q),least(s,t))) as both_ from pj where distance between 8 and 25 and cosine > 0.7),
pairs as (select *, greatest(case when abs(p-q) > 0 then both_/abs(p-q) else 0 end, case when abs(s-t) > 0 then both_/abs(s-t) else 0 end) as overlap from pk),
good as (select *, 0.3e0*(1-abs(distance-16.5e0)/16.5e0) + 0.3e0*overlap + 0.2e0*length_ratio + 0.2e0*(1-angle_diff/12e0) as score from pairs where overlap >= 0.6)"""

SQL = {
    "sign_direction": q(f""", wn as (select n.*, lead(lon) over w as nlon, lead(lat) over w as nlat, lag(lon) over w as plon, lag(lat) over w as plat
 from fx_way_nodes n join fx_ways y using (way_id) where y.highway in {_in(ROAD_CLASSES)} window w as (partition by n.way_id order by n.seq)),
g as (select wn.*, cast(s.angle as double) as direction,
 coalesce({azimuth('wn.lon', 'wn.lat', 'nlon', 'nlat')}, {azimuth('plon', 'plat', 'wn.lon', 'wn.lat')}) as to_next,
 coalesce({azimuth('wn.lon', 'wn.lat', 'plon', 'plat')}, {azimuth('nlon', 'nlat', 'wn.lon', 'wn.lat')}) as to_prev
 from wn join fx_signs s on s.event_id = wn.node_id)
select way_id, node_id, seq, direction, case when {adiff('direction', 'to_next')} > {adiff('direction', 'to_prev')} then 'forward' else 'backward' end as alt_dir from g"""),
    "highway_filter": q(f"select way_id, highway from fx_ways where highway in {_in(ROAD_CLASSES)}"),
    "traversable_edges": q(f"select way_id, a, b from fx_ways where {TRAVERSABLE}"),
    "loop_start_edges": q(f"select way_id, a from fx_ways where {LOOP_START}"),
    "oneway_normalize": q(f"select way_id, oneway, {STATE.format('oneway')} as state from fx_ways"),
    "tag_text_parse": q("""select way_id, array_to_string(list_sort(e), ';') as tags, len(e) as n from (select way_id, list_filter([
 concat('highway=', highway), case when maxspeed is not null then concat('maxspeed=', maxspeed) end, case when junction is not null then concat('junction=', junction) end,
 case when way_id % 9 = 1 then 'surface=0' end, concat('oneway=', coalesce(oneway, 'no'))], lambda x: x is not null) as e from fx_ways)"""),
    "arrow_case_remap": q(f"""select event_id, 'turn_lanes' as feature_type, case detection_type {' '.join(f"when '{k}' then '{v}'" for k, v in ARROWS.items())} else detection_type end as arrow_type
 from fx_signs where lon > -1.25e0 and lon < -1.235e0 and lat > 37.72e0 and lat < 37.729e0"""),
    "array_quadkey_filter": q(f"select way_id, concat(way_id % 7, ',', way_id % 5 + 10) as qks from fx_ways where (way_id % 7 = 3 or way_id % 5 = 2) and highway in {_in(ROAD_CLASSES)}"),
    "quadkey_children": q("""select distinct concat(p, x, y) as child from (select distinct concat(cast(floor(node_id % 64 / 16) as int), cast(floor(node_id % 16 / 4) as int), node_id % 4) as p from fx_nodes), range(0,4) t(x), range(0,4) u(y)"""),
    "non_osm_segments": q(f"select way_id, highway from fx_ways where way_id % 10 <> 9 and way_id % 3 = 1 and highway in {_in(ROAD_CLASSES_LIVING)}"),
    "intersection_weights": q("select node_id, cast(sum(case when seq = 1 then 2 else 1 end) as bigint) as weight from fx_way_nodes group by 1"),
    "true_intersections": q("""select node_id, cast(count(distinct case when seq <> 1 then concat(way_id, '/', seq) end) + 2 * count(distinct case when seq = 1 then way_id end) as bigint) as weight
 from fx_way_nodes group by 1 having count(distinct case when seq <> 1 then concat(way_id, '/', seq) end) + 2 * count(distinct case when seq = 1 then way_id end) >= 3"""),
    "adjacency_lists": q("select node_id, string_agg(way_id, ',' order by way_id) as ways from fx_way_nodes group by 1"),
    "mercator_project": q(f"""select node_id, round({mx('lon')}, 4) as x, round({my('lat')}, 4) as y, round(degrees({mx('lon')}/6378137e0), 6) as lon_back, round(degrees(atan(sinh({my('lat')}/6378137e0))), 6) as lat_back from fx_nodes"""),
    "tile_bbox": q(f""", t as (select node_id, 65000 + node_id % 50 as x, 50500 + node_id % 37 as y from fx_nodes)
select node_id, round({mx('(x/131072e0*360-180)')}, 4) as minx, round({my(f'degrees(atan(sinh({PI}*(1-2*(y+1)/131072e0))))')}, 4) as miny,
 round({mx('((x+1)/131072e0*360-180)')}, 4) as maxx, round({my(f'degrees(atan(sinh({PI}*(1-2*y/131072e0))))')}, 4) as maxy from t"""),
    "pixel_to_lonlat": q(f""", t as (select line_idx, x1, y1, 65000 + image % 50 as x, 50500 + image % 37 as y from fx_lines),
b as (select *, {mx('(x/131072e0*360-180)')} as minx, {my(f'degrees(atan(sinh({PI}*(1-2*(y+1)/131072e0))))')} as miny, {mx('((x+1)/131072e0*360-180)')} as maxx, {my(f'degrees(atan(sinh({PI}*(1-2*y/131072e0))))')} as maxy from t)
select line_idx, round(degrees((minx + x1/256e0*(maxx-minx))/6378137e0), 8) as lon, round(degrees(atan(sinh((maxy - y1/256e0*(maxy-miny))/6378137e0))), 8) as lat from b"""),
    "way_chord_length": q(f"select way_id, round({geo('lon1', 'lat1', 'lon2', 'lat2')}, 4) as metres, round({geo('lat1', 'lon1', 'lat2', 'lon2')}, 4) as metres_swapped from fx_way_lines"),
    "polyline_length": q(f""", s as (select way_id, seq, lon, lat, lead(lon) over w as nlon, lead(lat) over w as nlat from fx_way_nodes window w as (partition by way_id order by seq))
select way_id, round(sum({geo('lon', 'lat', 'nlon', 'nlat')}), 4) as metres, round(sum(sqrt(pow(nlon-lon,2)+pow(nlat-lat,2))), 9) as degrees from s where nlon is not null group by 1"""),
    "bearing": q(f"""select way_id, round({mod("degrees(atan2(sin(radians(lon2-lon1))*cos(radians(lat2)), cos(radians(lat1))*sin(radians(lat2)) - sin(radians(lat1))*cos(radians(lat2))*cos(radians(lon2-lon1)))) + 360e0", "360e0")}, 6) as bearing,
 round({azimuth('lon1', 'lat1', 'lon2', 'lat2')}, 6) as azimuth from fx_way_lines"""),
    "nearest_road": q(PAIRS + f""", g as (select *, round(d, 4) as dd, {azimuth('x1', 'y1', 'x2', 'y2')} as road from sp where d <= 30),
h as (select *, round(case when coalesce(oneway, 'no') = 'no' then least({mod('road - angle', '180e0')}, 180 - {mod('road - angle', '180e0')}) else {adiff('angle', 'road')} end, 6) as diff from g),
b as (select event_id, way_id, diff, dd from h qualify row_number() over (partition by event_id order by diff, dd, way_id) = 1)
select s.event_id, b.way_id, b.diff as angle_diff, b.dd as distance from fx_signs s left join b using (event_id)"""),
    "split_way": q(PAIRS + """, f as (select * from (select *, round(d, 4) as dd from sp where d <= 30) qualify row_number() over (partition by way_id order by dd, event_id) = 1)
select concat(way_id, '_a') as half_id, round(t*sqrt(pow(x2-x1,2)+pow(y2-y1,2)), 3) as length from f where t > 0 and t < 1
union all select concat(way_id, '_b'), round((1-t)*sqrt(pow(x2-x1,2)+pow(y2-y1,2)), 3) from f where t > 0 and t < 1"""),
    "proximity_thinning": q(f""", p as (select event_id, lon, lat from fx_signs)
select event_id from p j where not exists (select 1 from p i where i.event_id < j.event_id and abs(i.lat - j.lat) < 1e-4 and {geo('i.lon', 'i.lat', 'j.lon', 'j.lat')} <= 6)"""),
    "detections_near_network": q(PAIRS + "select distinct event_id from sp where highway not in ('service', 'track', 'unclassified', 'residential') and d <= 12.8e0"),
    "detections_unmatched": q(PAIRS + "select event_id from fx_signs where event_id not in (select event_id from sp where highway <> 'service' and d <= 30)"),
    "closed_loops": q(LOOPS + "select distinct array_to_string(list_sort(path), ',') as ways, len(path) as n from loops", True),
    "untagged_roundabouts": q(LOOPS + W8 + f""", d as (select distinct path from loops), e as (select path, unnest(path) as way_id from d),
v as (select e.path, n.node_id, n.lon, n.lat, w.weight from e join fx_way_nodes n using (way_id) join w8 w using (node_id)),
m as (select path, avg(lon) as cx, avg(lat) as cy, count(*) as n, count(distinct case when weight >= 3 then node_id end) as heavy from v group by 1),
k as (select v.path, min({geo('cx', 'cy', 'lon', 'lat')}) as lo, max({geo('cx', 'cy', 'lon', 'lat')}) as hi from v join m using (path) group by 1)
select array_to_string(path, ',') as path, heavy, n >= 8 and hi <= 1.8e0 * lo as is_round from m join k using (path) where heavy >= 2""", True),
    "triangles": q(LOOPS + """, d as (select distinct list_sort(path) as path from loops where len(path) = 3), e as (select path, unnest(path) as way_id from d),
v as (select path, highway, a as id, lon1 as x, lat1 as y from e join fx_way_lines using (way_id) union all select path, highway, b, lon2, lat2 from e join fx_way_lines using (way_id)),
u as (select path, list_sort(list_distinct(list({'id': id, 'x': x, 'y': y}))) as p, bool_or(highway not in ('residential', 'unclassified')) as main from v group by 1),
s as (select path, main, p[1].x as x1, p[1].y as y1, p[2].x as x2, p[2].y as y2, p[3].x as x3, p[3].y as y3 from u where len(p) = 3),
t as (select *, sqrt(pow(x1-x2,2)+pow(y1-y2,2)) as c, sqrt(pow(x2-x3,2)+pow(y2-y3,2)) as a, sqrt(pow(x1-x3,2)+pow(y1-y3,2)) as b,
 abs(x1*y2-x2*y1 + x2*y3-x3*y2 + x3*y1-x1*y3)/2 * (111111e0*111111e0) * cos(radians((2*y1+y2+y3)/4)) as area from s),
g as (select *, degrees(acos(least(greatest((b*b+c*c-a*a)/(2*b*c),-1e0),1e0))) as g1, degrees(acos(least(greatest((a*a+c*c-b*b)/(2*a*c),-1e0),1e0))) as g2, degrees(acos(least(greatest((a*a+b*b-c*c)/(2*a*b),-1e0),1e0))) as g3 from t)
select array_to_string(path, ',') as ways, main as has_non_residential, round(area, 2) as area_m2 from g where area >= 50 and least(g1,g2,g3) >= 5 and greatest(g1,g2,g3) <= 175""", True),
    "speed_reachability": q(f""", e as (select way_id, a, b, maxspeed, {geo('lon1', 'lat1', 'lon2', 'lat2')} as cost from fx_way_lines),
st as (select a as src, b as dst, cost from e where maxspeed is not null union all select b, a, cost from e where maxspeed is not null),
walk(seed, node, left_m) as (select node_id, node_id, 50e0 from fx_nodes union select w.seed, s.dst, w.left_m - s.cost from walk w join st s on s.src = w.node where w.left_m - s.cost >= 0),
ok as (select distinct w.seed from walk w join e on (e.a = w.node or e.b = w.node) where e.maxspeed in ('30', '50'))
select node_id from fx_nodes where node_id not in (select seed from ok)""", True),
    "prolongation": q(""", t as (select way_id, a, b from fx_ways), e as (select way_id, a as src, b as dst from t union all select way_id, b, a from t where a <> b),
stop as (select src as node from e group by 1 having count(distinct way_id) >= 3),
fl(seed, node) as (select node_id, node_id from fx_nodes union select f.seed, e.dst from fl f join e on e.src = f.node where f.node = f.seed or f.node not in (select node from stop))
select distinct f.seed, e.way_id from fl f join e on e.src = f.node where f.node = f.seed or f.node not in (select node from stop)""", True),
    "connected_components": q(""", e as (select a, b from fx_ways union all select b, a from fx_ways),
cc(node, root) using key (node) as (select distinct a, a from e
 union select e.b, min(c.root) from cc c join e on e.a = c.node join recurring.cc r on r.node = e.b where c.root < r.root group by 1)
select node, root from cc""", True),
    "chain_merge": q(CHAINS + "select node as way_id, root as chain from chains", True),
    "chain_lines": q(CHAINS + "select root, count(*) as n_ways, round(sum(sqrt(pow(lon2-lon1,2)+pow(lat2-lat1,2))), 7) as degrees from chains join fx_way_lines on way_id = node group by 1", True),
    "split_segments": q("""select concat(way_id, '_', p) as segment_id, 2::bigint as n_nodes from fx_ways, range(0, 2) t(p) where way_id % 3 = 0
union all select concat(way_id, '_0'), 3 from fx_ways where way_id % 3 <> 0"""),
    "network_candidates": q(NET + "select i, j, round(distance, 3) as distance from nd where distance <= 20"),
    "match_scores": q(NET + "select i, j, round(hausdorff, 3) as hausdorff, round(ratio, 5) as length_ratio, round(overlap, 5) as overlap, round(score, 5) as score from ns"),
    "projection_match": q(PROJ + "select i, j, distance, round(coverage, 4) as coverage from pm"),
    "parallel_pairs": q(PIX + "select image, i, j, round(distance, 4) as distance, round(overlap, 3) as overlap, round(angle_diff, 3) as angle_diff from good"),
    "pair_score": q(PIX + "select image, i, j, round(score, 5) as score from good where shorter >= 20 and length_ratio > 0.6"),
    "image_summary": q(PIX + """select n.image, n.lines, coalesce(p.pairs, 0) as pairs, p.mean_score from (select image, count(*) as lines from fx_lines group by 1) n
 left join (select image, count(*) as pairs, round(avg(score), 4) as mean_score from good group by 1) p using (image)"""),
    "geohash12": q(""", b as (select node_id, cast(floor((lon+180)/360*1073741824) as bigint) as fx, cast(floor((lat+90)/180*1073741824) as bigint) as fy from fx_nodes),
l as (select node_id, k, sum((case when (5*k+m) % 2 = 0 then (fx >> (29 - (5*k+m)//2)) & 1 else (fy >> (29 - (5*k+m)//2)) & 1 end) << (4-m)) as v from b, range(0,12) t(k), range(0,5) u(m) group by all)
select node_id, string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz', cast(v as int)+1, 1), '' order by k) as geohash from l group by 1"""),
    "wkt_hash_id": q("select node_id, ('0x' || substr(sha256(concat('POINT (', node_id, ' ', node_id * 7 % 1000, ')')), 1, 8))::bigint as hash_id from fx_nodes"),
    "tag_regex_exclude": q("""select way_id, not (highway in ('service', 'track', 'unclassified', 'residential')) as major from fx_ways where highway not in ('service', 'track') and way_id % 6 <> 0 and way_id % 8 <> 0"""),
    "snap_nodes": q(f"select node_id, cast(round_even({mx('lon')}/0.1e0, 0) as bigint) as kx, cast(round_even({my('lat')}/0.1e0, 0) as bigint) as ky from fx_nodes"),
    "project_tags": q("""select way_id, array_to_string(list_sort(list_filter(['string:highway', case when maxspeed is not null then 'string:maxspeed' end, case when oneway is not null then 'string:oneway' end], lambda x: x is not null)), ',') as basic,
 case when junction is not null then 'highway,lanes:turn' else 'highway' end as output from fx_ways"""),
}
_W = 7e-5
SQL["overlap_filter"] = q(f""", det as (select way_id as id, lon1 as x1, lat1 as y1, lon2 as x2, lat2 as y2, {geo('lon1', 'lat1', 'lon2', 'lat2')} as m from fx_roads_b),
kn as (select lon1 as u1, lat1 as v1, lon2 as u2, lat2 as v2, sqrt(pow(lon2-lon1,2)+pow(lat2-lat1,2)) as n from fx_way_lines where highway not in ('service', 'track')),
lo as (select id, n, ((x1-u1)*(u2-u1)+(y1-v1)*(v2-v1))/n as s1, ((y1-v1)*(u2-u1)-(x1-u1)*(v2-v1))/n as t1, ((x2-u1)*(u2-u1)+(y2-v1)*(v2-v1))/n as s2, ((y2-v1)*(u2-u1)-(x2-u1)*(v2-v1))/n as t2
 from det join kn on greatest(least(x1,x2)-{_W}, least(u1,u2)) <= least(greatest(x1,x2)+{_W}, greatest(u1,u2)) and greatest(least(y1,y2)-{_W}, least(v1,v2)) <= least(greatest(y1,y2)+{_W}, greatest(v1,v2))),
cl as (select id, greatest(0e0, case when abs(s2-s1) < 1e-15 then (case when s1 between 0 and n then 0 else 2 end) else least((0-s1)/(s2-s1), (n-s1)/(s2-s1)) end, case when abs(t2-t1) < 1e-15 then (case when t1 between -{_W} and {_W} then 0 else 2 end) else least((-{_W}-t1)/(t2-t1), ({_W}-t1)/(t2-t1)) end) as a,
 least(1e0, case when abs(s2-s1) < 1e-15 then (case when s1 between 0 and n then 1 else -1 end) else greatest((0-s1)/(s2-s1), (n-s1)/(s2-s1)) end, case when abs(t2-t1) < 1e-15 then (case when t1 between -{_W} and {_W} then 1 else -1 end) else greatest((-{_W}-t1)/(t2-t1), ({_W}-t1)/(t2-t1)) end) as b from lo),
mg as (select id, a, b, coalesce(max(b) over (partition by id order by a, b rows between unbounded preceding and 1 preceding), 0e0) as seen from cl where b > a),
sh as (select id, sum(greatest(0e0, b - greatest(a, seen))) as share from mg group by 1)
select d.id as way_id, round(m, 3) as length, round(coalesce(share, 0), 4) as share from det d left join sh using (id) where m >= 15 and coalesce(share, 0) < least(0.85e0, m/40*0.85e0)""")
# Greedy matching by rounds over all pairs that are left: those first of both their ends are taken, and pairs of their ends go.
def greedy(src: str, one_sided: bool = True, group: str = "") -> str:
    """Tables rounds and taken of the pairs (i, j, score) of src."""
    g, same = (f"{group}, ", f"b.{group} = t.{group} and ") if group else ("", "")
    order = "order by score desc, j, i"
    if one_sided:
        firsts = f"select *, row_number() over (partition by {g}i {order}) = 1 and row_number() over (partition by {g}j {order}) = 1 as best from open_"
    else:
        firsts = f"""select o.*, not exists (select 1 from open_ b where {same.replace('t.', 'o.')}(b.i in (o.i, o.j) or b.j in (o.i, o.j)) and (b.score > o.score or (b.score = o.score and (b.j < o.j or (b.j = o.j and b.i < o.i))))) as best from open_ o"""
    clash = "(b.i = t.i or b.j = t.j)" if one_sided else "(b.i in (t.i, t.j) or b.j in (t.i, t.j))"
    return f""", rounds({g}i, j, score, taken) as (
 select {g}i, j, score, false from {src}
 union all
 select {g}i, j, score, best from (with open_ as (select * from rounds where not taken), tops as ({firsts})
  select * from tops t where best or not exists (select 1 from tops b where {same}b.best and {clash})) z),
taken as (select {g}i, j, score from rounds where taken)"""


SQL["greedy_match"] = q(NET + greedy("good") + " select i, j, score from taken", True)
SQL["double_lines"] = q(PIX + ", pairs_ok as (select image, i, j, round(score, 6) as score from good where shorter >= 20 and length_ratio > 0.6)" + greedy("pairs_ok", False, "image") + " select image, i, j, score from taken", True)
BEST = NET + greedy("good") + ", best as (select i, j, g.distance from taken join good g using (i, j))"
SQL["combined_match"] = q(BEST + PROJ.replace("pa as", "ppa as").replace("from pa a join pb b", "from ppa a join pb b") + """, u as (select i, j, 'direct' as kind, distance from best union all select i, j, 'projection', distance from pm)
select i, j, kind, distance from u qualify row_number() over (partition by i order by case kind when 'direct' then 0 else 1 end, distance, j) = 1""", True)
SQL["direction_differences"] = q(BEST + DIRECTIONS, True)
