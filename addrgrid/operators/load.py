"""Batch loads (J1-J4 and the table-write idioms C11, C12, B2, B4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..sources import schemas
from ..session import cut_lineage
from . import spatial
from .polydist import nearest_polygon, pair_distance

#: Polygons closer than this (metres) touch: the rounding of national coordinates.
TOUCH_M = 1e-6


def varchar(c: str, n: int):
    """B2: cast with silent truncation to n characters."""
    return F.substring(F.col(c).cast("string"), 1, n).alias(c)


def stage_to_addresses(stage: DataFrame) -> DataFrame:
    """J1 transform: keep current rows with both coordinates (B4), fill the
    ASCII columns (H3), keep degrees in x/y_coord and add the NZTM point."""
    s = stage.where(F.col("gd2000_xcoord").isNotNull() & F.col("gd2000_ycoord").isNotNull()
                    & (F.col("address_lifecycle") == "Current"))
    s = geo.with_nztm(s, "gd2000_xcoord", "gd2000_ycoord", "gx", "gy")
    out = s.select(
        F.col("address_id").cast("long").alias("address_id"),
        "full_address",
        F.coalesce("full_address_ascii", text.to_ascii("full_address")).alias("full_address_ascii"),
        "full_road_name",
        F.coalesce("full_road_name_ascii", text.to_ascii("full_road_name")).alias("full_road_name_ascii"),
        "address_number_prefix", F.col("address_number").cast("int").alias("address_number"),
        "address_number_suffix", "suburb_locality",
        F.coalesce("suburb_locality_ascii", text.to_ascii("suburb_locality")).alias("suburb_locality_ascii"),
        "town_city", "territorial_authority",
        F.col("gd2000_xcoord").alias("x_coord"), F.col("gd2000_ycoord").alias("y_coord"),
        "gx", "gy")
    return out.select(*[varchar(c, schemas.VARCHAR_WIDTH[c]) if c in schemas.VARCHAR_WIDTH else F.col(c)
                        for c in schemas.ADDRESS_COLUMNS])


def assert_unique(df: DataFrame, key: str, what: str = "key") -> DataFrame:
    """C11 guard: a key twice in one batch fails the job (as the database
    does for an upsert touching a row twice). Lazy: raises when evaluated.

    Only the keys are shuffled, to be counted; one offending key is enough to
    fail, so what the rows are compared with has one row at most."""
    twice = df.groupBy(F.col(key).alias("_twice")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1)
    check = F.when(F.col("_n").isNotNull(), F.raise_error(F.concat(
        F.lit(f"duplicate {what} in batch: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True))
    # a filter (not a projection) so the optimizer cannot prune the check away
    return (df.join(F.broadcast(twice), F.col(key).eqNullSafe(F.col("_twice")), "left").where(check)
            .drop("_twice", "_n"))


def upsert(existing: DataFrame | None, incoming: DataFrame, key: str, check_unique: bool = True) -> DataFrame:
    """C11 ``INSERT ... ON CONFLICT (key) DO UPDATE`` (all columns): incoming
    rows win; existing rows without a conflicting key stay."""
    inc = assert_unique(incoming, key) if check_unique else incoming
    if existing is None:
        return inc
    keep = existing.join(incoming.select(key), key, "left_anti")
    return inc.unionByName(keep.select(*inc.columns))


def insert_if_absent(existing: DataFrame | None, incoming: DataFrame, key: str | list[str],
                     order_by: list[str] | None = None) -> DataFrame:
    """C12 ``ON CONFLICT DO NOTHING``: first incoming row per key (rule D:
    smallest ``order_by``), skipped if the key exists already."""
    keys = [key] if isinstance(key, str) else list(key)
    order = order_by or keys
    w = Window.partitionBy(*keys).orderBy(*order)
    first = incoming.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    if existing is None:
        return first
    new = first.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def load_addresses(stage: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Stage -> addresses table, upserted on address_id."""
    return upsert(existing, stage_to_addresses(stage), "address_id")


# ---------------------------------------------------------------------------
# Boundary loads
# ---------------------------------------------------------------------------

def load_regions(stage: DataFrame, id_col: str = "id", name_col: str = "name", flip: bool = True) -> DataFrame:
    """regions(region_id varchar(10), name varchar(200), geom): coordinates
    flipped (northing/easting feed order), largest part kept; rows without
    a geometry are dropped."""
    g = geo.flip_coordinates("geom") if flip else F.col("geom")
    s = (stage.where(F.col("geom").isNotNull()).withColumn("geom", g)
         .withColumn("geom", geo.largest_part("geom")))
    return s.select(F.substring(F.col(id_col).cast("string"), 1, 10).alias("region_id"),
                    F.substring(F.col(name_col), 1, 200).alias("name"), "geom")


def load_districts_by_point(stage: DataFrame, regions: DataFrame, id_col: str = "id",
                            name_col: str = "name", flip: bool = True,
                            default_region: str = "99") -> DataFrame:
    """J3 mode 'point' (C6): region = the region containing the district's
    point-on-surface (boundary included), smallest id on ties, else '99'.
    The point is taken of the whole geometry, before the largest part is kept."""
    g = geo.flip_coordinates("geom") if flip else F.col("geom")
    # boundaries are a dimension: materialise once so the per-vertex
    # expressions below read a column instead of re-deriving the part
    s = cut_lineage(stage.withColumn("geom", g)
                    .select(F.substring(F.col(id_col).cast("string"), 1, 10).alias("district_id"),
                            F.substring(F.col(name_col), 1, 200).alias("name"),
                            geo.point_on_surface("geom").alias("p"), geo.largest_part("geom").alias("geom")))
    pos = s.select("district_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    hit = spatial.first_containing(pos, regions.select("region_id", "geom"), "district_id", "region_id",
                                   x="px", y="py", predicate="intersects")
    return (s.join(hit, "district_id", "left")
            .select("district_id", F.coalesce("region_id", F.lit(default_region)).alias("region_id"),
                    "name", "geom"))


def _first_per_id(stage: DataFrame, key: str) -> DataFrame:
    """ON CONFLICT DO NOTHING within a feed: of rows with one id, the one with
    the smallest name stays; rows without id or geometry are not loaded."""
    first = (stage.where(F.col(key).isNotNull() & F.col("geom").isNotNull())
             .withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col("name").asc_nulls_last()))))
    return first.where("_rn = 1").drop("_rn")


def load_districts_by_overlap(stage: DataFrame, regions: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """J3 mode 'overlap': districts(district_id, region_id, name, geom), the
    region being the one that shares the largest area (C8); null if a district
    meets none. The whole geometry is kept and compared."""
    s = stage.select(F.substring(F.col(id_col).cast("string"), 1, 10).alias("district_id"),
                     F.substring(F.col(name_col), 1, 200).alias("name"), "geom")
    s = cut_lineage(_first_per_id(s, "district_id"))
    parent = parent_by_overlap(s, regions.where(F.col("geom").isNotNull()), "district_id", "region_id")
    return s.join(parent.select("district_id", "region_id"), "district_id", "left").select(
        "district_id", "region_id", "name", "geom")


def load_suburbs_by_overlap(stage: DataFrame, districts: DataFrame, id_col: str = "id", name_col: str = "name",
                            ascii_col: str = "name_ascii", major_col: str = "major_name") -> DataFrame:
    """J4 mode 'overlap': suburbs(suburb_id, district_id, name, name_ascii,
    major_name, geom) with the district that shares the largest area, null if
    there is none. ``name_ascii`` is the feed's or else the transliterated name (H3)."""
    s = stage.select(F.substring(F.col(id_col).cast("string"), 1, 50).alias("suburb_id"),
                     F.substring(F.col(name_col), 1, 200).alias("name"),
                     F.substring(F.coalesce(ascii_col, text.to_ascii(name_col)), 1, 200).alias("name_ascii"),
                     F.substring(F.col(major_col), 1, 200).alias("major_name"), "geom")
    s = cut_lineage(_first_per_id(s, "suburb_id"))
    parent = parent_by_overlap(s, districts.where(F.col("geom").isNotNull()), "suburb_id", "district_id")
    return s.join(parent.select("suburb_id", "district_id"), "suburb_id", "left").select(
        "suburb_id", "district_id", "name", "name_ascii", "major_name", "geom")


def parent_by_overlap(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str,
                      cell: float | None = None, strips_per_cell: int = 16) -> DataFrame:
    """Parent with the largest overlap area (ties: smallest parent key);
    one row per child. A child that only touches parents gets the smallest of
    those with area 0; one that meets none gets a null parent.

    Exact overlap of two polygons from their edges: the intersection area is
    the sum over edge pairs of the signed integral of min(f_c, f_p) over their
    shared x-range (no clipping). Candidate polygon pairs come from a grid
    equi-join on bbox cells; edge pairs only from the same vertical strip
    (each pair counted once, in the strip holding the left end of the shared
    x-range), so no polygon pair ever forms all its edge pairs.
    """
    pc = spatial.prepare_polygons(parents.select(parent_key, "geom"))
    cc = spatial.prepare_polygons(children.select(child_key, "geom"))
    if cell is None:
        cell = spatial.choose_cell_size(pc)
    a = spatial.polygon_cells(cc, cell).select(child_key, "cx", "cy", *[F.col(c).alias("c_" + c) for c in
                                                                        ("minx", "miny", "maxx", "maxy")])
    b = spatial.polygon_cells(pc, cell).select(parent_key, "cx", "cy", *[F.col(c).alias("p_" + c) for c in
                                                                         ("minx", "miny", "maxx", "maxy")])
    pairs = (a.join(b, ["cx", "cy"])
             .where((F.col("c_minx") <= F.col("p_maxx")) & (F.col("p_minx") <= F.col("c_maxx"))
                    & (F.col("c_miny") <= F.col("p_maxy")) & (F.col("p_miny") <= F.col("c_maxy")))
             .select(child_key, parent_key, F.greatest("c_miny", "p_miny").alias("y_origin")).distinct())
    strip = cell / strips_per_cell
    ce = _edge_rows(children, child_key, "c", strip)
    pe = _edge_rows(parents, parent_key, "p", strip)
    j = (pairs.join(ce, child_key).join(pe, [parent_key, "strip"])
         .where((F.greatest("c_x0", "p_x0") < F.least("c_x1", "p_x1"))
                & (F.floor(F.greatest("c_x0", "p_x0") / F.lit(strip)) == F.col("strip"))))
    term = _trapezoid_overlap()
    ov = j.groupBy(child_key, parent_key).agg(F.sum(term).alias("overlap"), F.sum(F.abs(term)).alias("scale"))
    # a sum within the rounding of its terms is a touch, not an overlap
    ov = ov.where(F.col("overlap") > 1e-12 * F.col("scale"))
    best = ov.groupBy(child_key).agg(F.min(F.struct((-F.col("overlap")).alias("neg"), F.col(parent_key))).alias("b"))
    best = cut_lineage(best.select(child_key, F.col("b." + parent_key).alias(parent_key),
                                   (-F.col("b.neg")).alias("overlap_area")))
    rest = pairs.select(child_key, parent_key).join(best.select(child_key), child_key, "left_anti")
    touch = (pair_distance(rest, children.select(child_key, "geom"), parents.select(parent_key, "geom"),
                           child_key, parent_key, cell)
             .where(F.col("distance") <= TOUCH_M)
             .groupBy(child_key).agg(F.min(parent_key).alias(parent_key))
             .withColumn("overlap_area", F.lit(0.0)))
    return children.select(child_key).join(best.unionByName(touch), child_key, "left")


def _edge_rows(polys: DataFrame, key: str, p: str, strip: float) -> DataFrame:
    """Edges as rows oriented left->right, each with the sign that makes the
    polygon's indicator a signed sum of "below this edge" terms: +1 for the
    upper boundary of filled area, -1 for the lower one. The sign comes from
    the ring's own orientation (shoelace) and role (shell +, hole -), so any
    ring orientation and holes are handled. Vertical edges contribute
    nothing to the trapezoid sum."""
    rings = (polys.select(key, F.explode("geom").alias("part"))
             .select(key, F.posexplode("part").alias("ri", "ring")))
    ring_edges = F.expr(geo._edges_sql("ring"))
    signed = F.aggregate(ring_edges, F.lit(0.0), lambda acc, e: acc + (e.ax * e.by - e.bx * e.ay))
    rs = F.when(F.col("ri") == 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.signum(signed)
    e = rings.select(key, rs.alias("_rs"), F.explode(ring_edges).alias("e"))
    ax, ay, bx, by = (F.col("e.ax"), F.col("e.ay"), F.col("e.bx"), F.col("e.by"))
    e = e.where(ax != bx)
    fwd = ax < bx
    x0, x1 = F.least(ax, bx), F.greatest(ax, bx)
    return e.select(
        key,
        F.explode(F.sequence(F.floor(x0 / F.lit(strip)), F.floor(x1 / F.lit(strip)))).alias("strip"),
        (F.col("_rs") * F.when(fwd, F.lit(-1.0)).otherwise(F.lit(1.0))).alias(f"{p}_s"),
        F.least(ax, bx).alias(f"{p}_x0"), F.greatest(ax, bx).alias(f"{p}_x1"),
        F.when(fwd, ay).otherwise(by).alias(f"{p}_y0"), F.when(fwd, by).otherwise(ay).alias(f"{p}_y1"))


def _trapezoid_overlap():
    """Signed integral of min(f_c, f_p) over the shared x-range, times the
    product of the edge orientations (both lines are linear there)."""
    x0 = F.greatest("c_x0", "p_x0")
    x1 = F.least("c_x1", "p_x1")

    def at(pfx, x):
        y0, y1 = F.col(f"{pfx}_y0") - F.col("y_origin"), F.col(f"{pfx}_y1") - F.col("y_origin")
        return y0 + (y1 - y0) * (x - F.col(f"{pfx}_x0")) / (F.col(f"{pfx}_x1") - F.col(f"{pfx}_x0"))

    c0, c1, p0, p1 = at("c", x0), at("c", x1), at("p", x0), at("p", x1)
    d0, d1 = c0 - p0, c1 - p1
    w = x1 - x0
    # integral of min of two lines over [x0, x1]; they cross when d0*d1 < 0
    same = F.least(c0, p0) + F.least(c1, p1)
    t = d0 / (d0 - d1)
    xm = t * w
    ym = c0 + (c1 - c0) * t
    crossed = (F.least(c0, p0) + ym) * xm / 2 + (ym + F.least(c1, p1)) * (w - xm) / 2
    integral = F.when(d0 * d1 < 0, crossed).otherwise(same * w / 2)
    # areas are relative to the pair's own origin (the terms stay small beside
    # national coordinates); the orientation product gives the sign.
    return F.col("c_s") * F.col("p_s") * integral


def project_geometry(df: DataFrame, key: str, geom: str = "geom", flip: bool = False) -> DataFrame:
    """I2 on every vertex (degrees -> NZTM), optionally after swapping
    lat/lon order (I14): vertices become rows, are projected with the staged
    column expressions and regrouped per geometry."""
    p = df.select(key, F.posexplode(geom).alias("part", "rings"))
    r = p.select(key, "part", F.posexplode("rings").alias("ring", "verts"))
    v = r.select(key, "part", "ring", F.posexplode("verts").alias("seq", "v"))
    lon, lat = (F.col("v.y"), F.col("v.x")) if flip else (F.col("v.x"), F.col("v.y"))
    v = geo.with_nztm(v.select(key, "part", "ring", "seq", lon.alias("_lon"), lat.alias("_lat")),
                      "_lon", "_lat", "x", "y")
    return geo.polygons_from_vertices(v, key, "seq", "x", "y", part="part", ring="ring")


def load_suburbs_cascade(stage: DataFrame, districts: DataFrame, id_col: str = "id", name_col: str = "name",
                         major_col: str = "major_name", flip: bool = True, project: bool = True,
                         default_district: str = "99") -> DataFrame:
    """J4 mode 'cascade' (C7): district containing the suburb's point on
    surface (boundary excluded, smallest id); else the district at the
    smallest polygon distance (the within-10-km step and the absolute
    nearest step pick the same district). Output adds ``method`` and the
    distance used."""
    s = stage.select(F.substring(F.col(id_col).cast("string"), 1, 50).alias("suburb_id"),
                     F.substring(F.col(name_col), 1, 200).alias("name"),
                     F.coalesce(F.substring(F.col(major_col), 1, 200), F.lit("")).alias("major_name"), "geom")
    if project:
        g = project_geometry(s.select("suburb_id", "geom"), "suburb_id", flip=flip)
        s = s.drop("geom").join(g, "suburb_id")
    elif flip:
        s = s.withColumn("geom", geo.flip_coordinates("geom"))
    s = cut_lineage(s.withColumn("geom", geo.largest_part("geom")))
    # stored, or every edge test below would work the point out again; so are the matches, which are read three times
    pos = cut_lineage(s.select("suburb_id", geo.point_on_surface("geom").alias("p"))).select(
        "suburb_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    inside = cut_lineage(spatial.first_containing(pos, districts.select("district_id", "geom"), "suburb_id", "district_id",
                                                  x="px", y="py", predicate="within"))
    rest = cut_lineage(s.select("suburb_id", "geom").join(inside, "suburb_id", "left_anti"))
    near = nearest_polygon(rest, districts.select("district_id", "geom"), "suburb_id", "district_id")
    chosen = (inside.select("suburb_id", "district_id", F.lit("contains").alias("method"),
                            F.lit(0.0).alias("distance"))
              .unionByName(near.select("suburb_id", "district_id", F.lit("nearest").alias("method"), "distance")))
    return (s.join(chosen, "suburb_id", "left")
            .select("suburb_id", F.coalesce("district_id", F.lit(default_district)).alias("district_id"),
                    "name", "major_name", "geom", "method", "distance"))
