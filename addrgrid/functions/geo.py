"""Geometry as native Spark columns (section I of the survey).

Model
-----
* point: two double columns (or ``struct<x,y>``) in the metric plane (NZTM,
  EPSG:2193) or in degrees (lon/lat, EPSG:4167/4326 -- treated as the same
  datum, as PROJ does).
* polygon / multipolygon: ``geom: array<array<array<struct<x,y>>>>``, i.e.
  parts -> rings -> closed vertex list; ring 0 of a part is its shell, the
  others are holes. A plain polygon is a one-part multipolygon.

All functions return Columns built from built-in expressions (higher-order
``transform``/``filter``/``aggregate`` for per-vertex loops), so they run in
the JVM next to the scan; no Python per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# NZTM2000 (EPSG:2193) projection parameters (public, LINZ).
# GRS80 ellipsoid, transverse Mercator.
# --------------------------------------------------------------------------
NZTM_A = 6378137.0
NZTM_INV_F = 298.257222101
NZTM_LON0 = 173.0
NZTM_LAT0 = 0.0
NZTM_K0 = 0.9996
NZTM_FE = 1600000.0
NZTM_FN = 10000000.0

_F = 1.0 / NZTM_INV_F
_N = _F / (2.0 - _F)
_E = math.sqrt(_F * (2.0 - _F))
# rectifying radius (Krueger / Karney series in n)
_A = NZTM_A / (1.0 + _N) * (1.0 + _N ** 2 / 4.0 + _N ** 4 / 64.0 + _N ** 6 / 256.0)
_KA = NZTM_K0 * _A


def _series(n):
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45 - 2854 * n**6 / 675,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315 + 2323 * n**6 / 945,
        56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105 + 73814 * n**6 / 2835,
        4279 * n**4 / 630 - 332 * n**5 / 35 - 399572 * n**6 / 14175,
        4174 * n**5 / 315 - 144838 * n**6 / 6237,
        601676 * n**6 / 22275,
    ]
    return alpha, beta, delta


ALPHA, BETA, DELTA = _series(_N)


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def lonlat_to_nztm(lon, lat) -> Column:
    """Degrees -> ``struct<x,y>`` NZTM metres (Krueger n-series, 6 terms).

    Longitudes below zero (Chatham Islands side of the antimeridian) are
    shifted by +360 first so the central-meridian offset stays small.
    """
    lon, lat = _c(lon), _c(lat)
    lon = F.when(lon < 0, lon + F.lit(360.0)).otherwise(lon)
    phi = F.radians(lat)
    lam = F.radians(lon - F.lit(NZTM_LON0))
    sphi = F.sin(phi)
    t = F.sinh(F.atanh(sphi) - F.lit(_E) * F.atanh(F.lit(_E) * sphi))
    xi1 = F.atan2(t, F.cos(lam))
    eta1 = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    xi, eta = xi1, eta1
    for j, a in enumerate(ALPHA, start=1):
        xi = xi + F.lit(a) * F.sin(F.lit(2.0 * j) * xi1) * F.cosh(F.lit(2.0 * j) * eta1)
        eta = eta + F.lit(a) * F.cos(F.lit(2.0 * j) * xi1) * F.sinh(F.lit(2.0 * j) * eta1)
    x = F.lit(NZTM_FE) + F.lit(_KA) * eta
    y = F.lit(NZTM_FN) + F.lit(_KA) * xi
    return F.struct(x.alias("x"), y.alias("y"))


def nztm_to_lonlat(x, y) -> Column:
    """NZTM metres -> ``struct<lon,lat>`` degrees (inverse series)."""
    x, y = _c(x), _c(y)
    xi = (y - F.lit(NZTM_FN)) / F.lit(_KA)
    eta = (x - F.lit(NZTM_FE)) / F.lit(_KA)
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi1 = xi1 - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        eta1 = eta1 - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    lon = F.lit(NZTM_LON0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    lon = F.when(lon > 180.0, lon - F.lit(360.0)).otherwise(lon)
    return F.struct(lon.alias("lon"), F.degrees(phi).alias("lat"))


def with_nztm(df: DataFrame, lon: str, lat: str, x: str = "gx", y: str = "gy") -> DataFrame:
    """I2 as a staged transform: the intermediate terms become columns so the
    series does not re-inline them (keeps generated code small)."""
    lonc = F.col(lon)
    d = df.withColumn("_lam", F.radians(F.when(lonc < 0, lonc + F.lit(360.0)).otherwise(lonc) - F.lit(NZTM_LON0)))
    d = d.withColumn("_sphi", F.sin(F.radians(F.col(lat))))
    d = d.withColumn("_t", F.sinh(F.atanh("_sphi") - F.lit(_E) * F.atanh(F.lit(_E) * F.col("_sphi"))))
    d = d.withColumn("_xi1", F.atan2(F.col("_t"), F.cos("_lam")))
    d = d.withColumn("_eta1", F.atanh(F.sin("_lam") / F.sqrt(F.lit(1.0) + F.col("_t") * F.col("_t"))))
    xi, eta = F.col("_xi1"), F.col("_eta1")
    for j, a in enumerate(ALPHA, start=1):
        xi = xi + F.lit(a) * F.sin(F.lit(2.0 * j) * F.col("_xi1")) * F.cosh(F.lit(2.0 * j) * F.col("_eta1"))
        eta = eta + F.lit(a) * F.cos(F.lit(2.0 * j) * F.col("_xi1")) * F.sinh(F.lit(2.0 * j) * F.col("_eta1"))
    d = d.withColumn(x, F.lit(NZTM_FE) + F.lit(_KA) * eta).withColumn(y, F.lit(NZTM_FN) + F.lit(_KA) * xi)
    return d.drop("_lam", "_sphi", "_t", "_xi1", "_eta1")


def with_lonlat(df: DataFrame, x: str, y: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """I3 as a staged transform (see ``with_nztm``)."""
    d = df.withColumn("_xi", (F.col(y) - F.lit(NZTM_FN)) / F.lit(_KA))
    d = d.withColumn("_eta", (F.col(x) - F.lit(NZTM_FE)) / F.lit(_KA))
    xi1, eta1 = F.col("_xi"), F.col("_eta")
    for j, b in enumerate(BETA, start=1):
        xi1 = xi1 - F.lit(b) * F.sin(F.lit(2.0 * j) * F.col("_xi")) * F.cosh(F.lit(2.0 * j) * F.col("_eta"))
        eta1 = eta1 - F.lit(b) * F.cos(F.lit(2.0 * j) * F.col("_xi")) * F.sinh(F.lit(2.0 * j) * F.col("_eta"))
    d = d.withColumn("_xi1", xi1).withColumn("_eta1", eta1)
    d = d.withColumn("_chi", F.asin(F.sin("_xi1") / F.cosh("_eta1")))
    phi = F.col("_chi")
    for j, dd in enumerate(DELTA, start=1):
        phi = phi + F.lit(dd) * F.sin(F.lit(2.0 * j) * F.col("_chi"))
    lo = F.lit(NZTM_LON0) + F.degrees(F.atan2(F.sinh("_eta1"), F.cos("_xi1")))
    d = d.withColumn("_lo", lo)
    d = d.withColumn(lon, F.when(F.col("_lo") > 180.0, F.col("_lo") - F.lit(360.0)).otherwise(F.col("_lo")))
    d = d.withColumn(lat, F.degrees(phi))
    return d.drop("_xi", "_eta", "_xi1", "_eta1", "_chi", "_lo")


def distance(ax, ay, bx, by) -> Column:
    """Planar distance between two points."""
    return F.hypot(_c(ax) - _c(bx), _c(ay) - _c(by))


def point_wkt(x, y) -> Column:
    """``POINT(x y)`` text."""
    return F.concat(F.lit("POINT("), _c(x).cast("string"), F.lit(" "), _c(y).cast("string"), F.lit(")"))


# --------------------------------------------------------------------------
# Polygons. SQL snippets are composed as text because the per-vertex loops
# are higher-order functions; ``g`` is always a SQL expression of type geom.
# --------------------------------------------------------------------------

def _edges_sql(ring: str) -> str:
    return (f"zip_with(slice({ring}, 1, size({ring}) - 1), slice({ring}, 2, size({ring}) - 1), "
            f"(a, b) -> named_struct('ax', a.x, 'ay', a.y, 'bx', b.x, 'by', b.y))")


def edges_sql(g: str) -> str:
    """All edges of all rings of all parts, as ``array<struct<ax,ay,bx,by>>``."""
    return f"flatten(transform(flatten({g}), r -> {_edges_sql('r')}))"


def edges(geom: str = "geom") -> Column:
    return F.expr(edges_sql(geom))


def bbox(geom: str = "geom") -> list[Column]:
    """minx, miny, maxx, maxy of a geometry."""
    pts = f"flatten(flatten({geom}))"
    return [F.expr(f"array_min(transform({pts}, p -> p.x))").alias("minx"),
            F.expr(f"array_min(transform({pts}, p -> p.y))").alias("miny"),
            F.expr(f"array_max(transform({pts}, p -> p.x))").alias("maxx"),
            F.expr(f"array_max(transform({pts}, p -> p.y))").alias("maxy")]


def _ring_area_sql(ring: str) -> str:
    return (f"abs(aggregate({_edges_sql(ring)}, 0D, (acc, e) -> acc + (e.ax * e.by - e.bx * e.ay)) / 2D)")


def _part_area_sql(part: str) -> str:
    return (f"({_ring_area_sql(part + '[0]')} - "
            f"aggregate(slice({part}, 2, greatest(size({part}) - 1, 0)), 0D, (acc, h) -> acc + {_ring_area_sql('h')}))")


def area(geom: str = "geom") -> Column:
    """ST_Area -- shells minus holes, summed over parts (shoelace)."""
    return F.expr(f"aggregate({geom}, 0D, (acc, p) -> acc + {_part_area_sql('p')})")


def _ring_moments_sql(ring: str, sign: str) -> str:
    """Area and first moments of a ring about its first vertex, whatever its
    orientation, times ``sign``; the vertex is added back with the area."""
    e = (f"transform({_edges_sql(ring)}, e -> named_struct("
         f"'c', (e.ax - {ring}[0].x) * (e.by - {ring}[0].y) - (e.bx - {ring}[0].x) * (e.ay - {ring}[0].y), "
         f"'x', e.ax + e.bx - 2D * {ring}[0].x, 'y', e.ay + e.by - 2D * {ring}[0].y))")
    return (f"aggregate({e}, named_struct('a', 0D, 'x', 0D, 'y', 0D), "
            f"(acc, e) -> named_struct('a', acc.a + e.c / 2D, 'x', acc.x + e.c * e.x / 6D, 'y', acc.y + e.c * e.y / 6D), "
            f"acc -> named_struct('a', {sign} * abs(acc.a), 'x', {sign} * (sign(acc.a) * acc.x + abs(acc.a) * {ring}[0].x), "
            f"'y', {sign} * (sign(acc.a) * acc.y + abs(acc.a) * {ring}[0].y)))")


def centroid(geom: str = "geom") -> Column:
    """I16: ST_Centroid -- centre of area of all parts, holes taken out;
    ``struct<x,y>``, null for a geometry without area."""
    rings = (f"flatten(transform({geom}, p -> transform(p, (r, i) -> if(i = 0, {_ring_moments_sql('r', '1D')}, "
             f"{_ring_moments_sql('r', '-1D')}))))")
    total = (f"aggregate({rings}, named_struct('a', 0D, 'x', 0D, 'y', 0D), (acc, m) -> "
             f"named_struct('a', acc.a + m.a, 'x', acc.x + m.x, 'y', acc.y + m.y), "
             f"acc -> if(acc.a > 0D, named_struct('x', acc.x / acc.a, 'y', acc.y / acc.a), null))")
    return F.expr(total)


def largest_part(geom: str = "geom") -> Column:
    """ST_Dump + keep the part of largest area (ties: first part)."""
    return F.expr(
        f"array(element_at(array_sort(transform({geom}, (p, i) -> named_struct('neg', -({_part_area_sql('p')}), 'i', i, 'p', p))), 1).p)")


def flip_coordinates(geom: str = "geom") -> Column:
    """Swap x and y of every vertex."""
    return F.expr(f"transform({geom}, p -> transform(p, r -> transform(r, v -> named_struct('x', v.y, 'y', v.x))))")


def crossing_sql(e: str, px: str, py: str) -> str:
    """Half-open ray cast towards +x, division free."""
    return (f"(({e}.ay > {py}) <> ({e}.by > {py})) AND ("
            f"(({e}.by > {e}.ay) AND ({px} - {e}.ax) * ({e}.by - {e}.ay) < ({e}.bx - {e}.ax) * ({py} - {e}.ay)) OR "
            f"(({e}.by < {e}.ay) AND ({px} - {e}.ax) * ({e}.by - {e}.ay) > ({e}.bx - {e}.ax) * ({py} - {e}.ay)))")


def on_edge_sql(e: str, px: str, py: str) -> str:
    return (f"(({e}.bx - {e}.ax) * ({py} - {e}.ay) - ({e}.by - {e}.ay) * ({px} - {e}.ax) = 0D "
            f"AND {px} BETWEEN least({e}.ax, {e}.bx) AND greatest({e}.ax, {e}.bx) "
            f"AND {py} BETWEEN least({e}.ay, {e}.by) AND greatest({e}.ay, {e}.by))")


def point_within_sql(px: str, py: str, edge_col: str) -> str:
    """I5 ST_Within(point, polygon): odd crossings and not on the boundary."""
    return (f"((size(filter({edge_col}, e -> {crossing_sql('e', px, py)})) % 2 = 1) "
            f"AND NOT exists({edge_col}, e -> {on_edge_sql('e', px, py)}))")


def point_intersects_sql(px: str, py: str, edge_col: str) -> str:
    """I7 ST_Intersects(polygon, point): interior or boundary."""
    return (f"((size(filter({edge_col}, e -> {crossing_sql('e', px, py)})) % 2 = 1) "
            f"OR exists({edge_col}, e -> {on_edge_sql('e', px, py)}))")


def point_within(px: str, py: str, edge_col: str = "edges") -> Column:
    return F.expr(point_within_sql(px, py, edge_col))


def point_intersects(px: str, py: str, edge_col: str = "edges") -> Column:
    return F.expr(point_intersects_sql(px, py, edge_col))


def point_on_surface(geom: str = "geom") -> Column:
    """A point guaranteed inside the (largest-width run of the) polygon.

    Scan line at the midpoint between the two vertex levels that bracket the
    bbox mid-height; intersections with all edges are sorted and paired; the
    midpoint of the widest inside run is returned.
    """
    pts = f"flatten(flatten({geom}))"
    cy = (f"((array_min(transform({pts}, p -> p.y)) + array_max(transform({pts}, p -> p.y))) / 2D)")
    hi = f"coalesce(array_min(filter(transform({pts}, p -> p.y), v -> v > {cy})), {cy})"
    lo = f"coalesce(array_max(filter(transform({pts}, p -> p.y), v -> v <= {cy})), {cy})"
    sy = f"(({hi} + {lo}) / 2D)"
    e = edges_sql(geom)
    xs = (f"array_sort(transform(filter({e}, e -> (e.ay > {sy}) <> (e.by > {sy})), "
          f"e -> e.ax + (e.bx - e.ax) * ({sy} - e.ay) / (e.by - e.ay)))")
    runs = (f"transform(sequence(0, cast(size({xs}) / 2 as int) - 1), "
            f"i -> named_struct('w', element_at({xs}, 2 * i + 2) - element_at({xs}, 2 * i + 1), "
            f"'neg_i', -i, 'm', (element_at({xs}, 2 * i + 2) + element_at({xs}, 2 * i + 1)) / 2D))")
    return F.expr(f"named_struct('x', array_max({runs}).m, 'y', {sy})")


def polygons_from_vertices(df: DataFrame, key: str, seq: str = "seq", x: str = "x", y: str = "y",
                           part: str | None = None, ring: str | None = None) -> DataFrame:
    """Build ``geom`` from a vertex table (one row per vertex), closing rings.

    One aggregation per geometry (its vertex list is one geometry, never a
    whole table); parts and rings are nested with higher-order functions.
    """
    part_c = F.col(part) if part else F.lit(0)
    ring_c = F.col(ring) if ring else F.lit(0)
    v = df.select(F.col(key), F.struct(part_c.alias("p"), ring_c.alias("r"), F.col(seq).alias("s"),
                                       F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("_v"))
    g = v.groupBy(key).agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
    close = "if(rr[0] = rr[size(rr) - 1], rr, concat(rr, array(rr[0])))"
    ring_of = ("transform(filter(_vs, v -> v.p = pp and v.r = ri), v -> named_struct('x', v.x, 'y', v.y))")
    expr = (f"transform(array_distinct(transform(_vs, v -> v.p)), pp -> "
            f"transform(array_distinct(transform(filter(_vs, v -> v.p = pp), v -> v.r)), ri -> "
            f"aggregate(array({ring_of}), cast(null as array<struct<x:double,y:double>>), (acc, rr) -> {close})))")
    return g.select(key, F.expr(expr).alias("geom"))


# --------------------------------------------------------------------------
# WKT (I15, I17)
# --------------------------------------------------------------------------

def geom_from_wkt(wkt) -> Column:
    """POLYGON / MULTIPOLYGON text -> geom (Z/M ordinates dropped, I15).

    Parsed with regex splits inside the JVM; a POINT becomes a one-vertex
    ring so the same type serves.
    """
    w = F.upper(F.trim(_c(wkt)))
    body = F.regexp_replace(w, r"^[A-Z]+\s*(Z|M|ZM)?\s*", "")
    kind = F.regexp_extract(w, r"^([A-Z]+)", 1)
    # normalise separators: parts by '|', rings by ';'
    norm = F.regexp_replace(body, r"\)\s*\)\s*,\s*\(\s*\(", "|")
    norm = F.regexp_replace(norm, r"\)\s*,\s*\(", ";")
    norm = F.regexp_replace(norm, r"[()]", "")
    parsed = F.transform(
        F.split(norm, r"\|"),
        lambda p: F.transform(
            F.split(p, ";"),
            lambda r: F.transform(
                F.split(F.trim(r), r"\s*,\s*"),
                lambda v: F.struct(
                    F.split(F.trim(v), r"\s+").getItem(0).cast("double").alias("x"),
                    F.split(F.trim(v), r"\s+").getItem(1).cast("double").alias("y")))))
    return F.when(kind.isin("POLYGON", "MULTIPOLYGON", "POINT"), parsed)


def geometry_kind(wkt) -> Column:
    """The declared geometry type of a WKT string (for assertions)."""
    return F.regexp_extract(F.upper(F.trim(_c(wkt))), r"^([A-Z]+)", 1)
