"""Sources and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from addrgrid.operators import load, localities
from addrgrid.sources import fixtures as fx
from addrgrid.sources import readers, schemas


def test_address_feed_csv_to_table(spark, tmp_path):
    cols = [f.name for f in schemas.ADDRESS_FEED.fields]
    row = {c: "" for c in cols}
    row.update(fid="f1", address_id="42", full_road_name="Kōwhai Street", full_address="7 Kōwhai Street, Te Aro",
               address_number="7", suburb_locality="Te Aro", town_city="Wellington", address_lifecycle="Current",
               gd2000_xcoord="174.7762", gd2000_ycoord="-41.2865")
    p = tmp_path / "feed.csv"
    p.write_text(",".join(cols) + "\n" + ",".join('"%s"' % row[c] for c in cols) + "\n", encoding="utf-8")
    feed = readers.read_address_feed(spark, str(p))
    a = load.load_addresses(feed).first()
    assert a.address_id == 42 and a.full_road_name_ascii == "Kowhai Street"
    assert abs(a.gx - 1748735.553) < 0.01 and abs(a.gy - 5427916.479) < 0.01


def test_boundary_csv_wkt_flip_largest_part(spark, tmp_path):
    p = tmp_path / "regions.csv"
    p.write_text('id,name,Shape\n1,North,"MULTIPOLYGON(((0 0,0 1,1 1,0 0)),((10 10,10 14,14 14,10 10)))"\n')
    b = readers.read_boundaries(spark, str(p))
    r = load.load_regions(b).first()
    assert r.region_id == "1" and len(r.geom) == 1
    # flipped: (northing, easting) -> (x, y)
    assert r.geom[0][0][1].x == 14.0 and r.geom[0][0][1].y == 10.0


def test_locality_json_and_csv_sink(spark, tmp_path):
    doc = [{"Name": "All"},
           {"Name": "Wellington", "Districts": [
               {"DistrictId": 47, "Name": "Wellington City",
                "Suburbs": [{"SuburbId": 1, "Name": "Kelburn"}, {"SuburbId": 2, "Name": "Te Aro"}]},
               {"DistrictId": 48, "Name": "Porirua"}]},
           {"Name": "Nowhere", "Districts": []}]
    p = tmp_path / "loc.json"
    p.write_text(json.dumps(doc))
    docs = readers.read_locality_json(spark, str(p))
    regions = {r.region_id: r.name for r in localities.regions_from_documents(docs).collect()}
    assert regions == {"R02": "Wellington", "R03": "Nowhere"}
    m = spark.createDataFrame([("Wellington", "R09")], "name string, region_id string")
    d, s, unknown = localities.hierarchy_from_documents(docs, m)
    assert sorted(r.district_id for r in d.collect()) == ["D0047", "D0048"]
    assert sorted(r.suburb_id for r in s.collect()) == ["S00001", "S00002"]
    assert [r.region_name for r in unknown.collect()] == ["Nowhere"]
    out = tmp_path / "suburbs_csv"
    readers.write_csv(s.select("suburb_id", "district_id", "name"), str(out))
    back = spark.read.option("header", True).csv(str(out))
    assert back.count() == 2 and set(back.columns) == {"suburb_id", "district_id", "name"}


def test_listing_csv(spark, tmp_path):
    p = tmp_path / "listings.csv"
    p.write_text("region,district,suburb\nwellington,wellington-city,te-aro\n")
    l = readers.read_listings(spark, str(p))
    assert l.select(F.initcap(F.replace("suburb", F.lit("-"), F.lit(" ")))).first()[0] == "Te Aro"


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_every_supplier_is_a_suburb_in_a_cell_of_its_own(spark, sf):
    d = f"/root/testdata/sf{sf}"
    rows = fx.suburb_cells(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/supplier.parquet").count()
    assert len({(r.nk, r.gx, r.gy) for r in rows}) == len(rows)
    assert all(0 <= r.gx < r.grid and 0 <= r.gy < r.grid for r in rows)
