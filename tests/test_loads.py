"""Loads, file scans, stored versions, constraints: registered queries against
their SQL, and what must go wrong."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from addrgrid.functions import geo
from addrgrid.operators import centroids, quality, reports
from addrgrid.plans import catalog_loads
from addrgrid.sources import readers, schemas, versions
from addrgrid.sources.tables import DRIVER_TABLES
from tools.oracle_check import rows_duck, rows_spark

from conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog_loads.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    assert set(catalog_loads.ORACLE) == set(catalog_loads.QUERIES)
    found, expected = rows_spark(E.queries()[name](spark, SF)), rows_duck(con, E.oracle_sql()[name])
    assert found == expected and found[1]


def test_a_job_that_fails_half_way_keeps_the_old_rows(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert versions.current(spark, root) is None
    versions.publish(spark.range(10).repartition(4), root)
    broken = spark.range(1000).repartition(8).select(
        F.when(F.col("id") == 777, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        versions.publish(broken, root)
    assert {r.id for r in versions.current(spark, root).collect()} == set(range(10))
    versions.publish(versions.current(spark, root).where("id < 5"), root)
    assert versions.current(spark, root).count() == 5
    for k in range(3):
        versions.publish(spark.range(k + 1), root)
    assert versions.current(spark, root).count() == 3 and len(versions._listed(spark, root)[3]) == 2


def test_keyed_update_and_defaults(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", None)], "id int, name string, kind string")
    u = spark.createDataFrame([(2, None), (9, "z")], "id int, name string")
    assert {r.id: r.name for r in versions.keyed_update(t, u, "id", ["name"]).collect()} == {1: "a", 2: None, 3: "c"}
    d = versions.with_defaults(t, {"kind": "trademe", "is_primary": False}).collect()
    assert {r.kind for r in d} == {"trademe", "x"} and all(r.created_at is not None and r.is_primary is False for r in d)


def test_malformed_rows_abort(spark, tmp_path):
    path = tmp_path / "feed.csv"
    head = ",".join(f.name for f in schemas.ADDRESS_FEED)
    row = ["x"] * 36
    row[1] = "not a number"
    path.write_text(head + "\n" + ",".join(row) + "\n")
    with pytest.raises(Exception):
        readers.read_address_feed(spark, str(path)).select("address_id").collect()


def test_boundaries_are_read_in_splits(spark, tmp_path):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.lit("POLYGON ((0 0, 1 0, 1 1, 0 0))").alias("WKT"))
    readers.write_csv(rows.coalesce(1), str(tmp_path / "b"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = readers.read_boundaries(spark, str(tmp_path / "b"))
        assert df.rdd.getNumPartitions() > 4 and df.where("geom_type = 'POLYGON' and size(geom) = 1").count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_constraints_on_a_sound_table_give_nothing(spark):
    t = spark.createDataFrame([(1, 1), (2, None)], "id int, parent int")
    found = quality.violations({"t": t}, {"t": quality.Constraints(["id"], ["id"], [("parent", "t", "id")])})
    assert found.collect() == []


def test_polygon_centroid_as_last_resort(spark):
    square = [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]]  # clockwise
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
    kind = "array<array<array<struct<x:double,y:double>>>>"
    s = spark.createDataFrame([("1", "1", "Nowhere", [[square[0], hole]]), ("2", "1", "Flat", [[[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]])],
                              f"suburb_id string, district_id string, name string, geom {kind}")
    c = {r.suburb_id: r.c for r in s.select("suburb_id", geo.centroid("geom").alias("c")).collect()}
    assert c["2"] is None and abs(c["1"].x - 5 / 3) < 1e-12 and abs(c["1"].y - 5 / 3) < 1e-12
    d = spark.createDataFrame([("1", "D", "1")], "district_id string, name string, region_id string")
    r = spark.createDataFrame([("1", "R")], "region_id string, name string")
    a = spark.createDataFrame([], "address_id long, suburb_locality string, gx double, gy double")
    ab = spark.createDataFrame([], schemas.ABBREVIATIONS)
    gz = spark.createDataFrame([], "query_text string, lat double, lon double")
    got = {x.suburb_id: (x.source, x.centroid_x) for x in centroids.fill_centroids(s, d, r, a, ab, gz, polygon=True).collect()}
    assert got["2"] == (None, None) and got["1"][0] == "polygon"
    assert {x.source for x in centroids.fill_centroids(s, d, r, a, ab, gz).collect()} == {None}


def test_samples_are_the_first_thirty(spark):
    one = spark.createDataFrame([(f"n{k:03d}",) for k in range(50)] + [(None,)], "suburb string")
    two = spark.createDataFrame([(f"N{k:03d} ",) for k in range(40, 90)], "name string")
    got = reports.locality_samples(one, two).collect()
    of = {s: [r.name for r in sorted(got, key=lambda r: r.ord) if r.section == s] for s in {r.section for r in got}}
    assert of == {"in both": [f"n{k:03d}" for k in range(40, 50)], "only in listings": [f"n{k:03d}" for k in range(30)],
                  "only in reference": [f"n{k:03d}" for k in range(50, 80)]}
