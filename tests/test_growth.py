"""Work that must not be repeated by row, by request or by copy as the tables grow."""

from addrgrid.operators import knn, load, matching
from addrgrid.plans import catalog_loads


def _stored(monkeypatch, module):
    """Frames the module stores, in order."""
    kept, real = [], module.cut_lineage

    def store(df):
        kept.append(real(df))
        return kept[-1]

    monkeypatch.setattr(module, "cut_lineage", store)
    return kept


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_requests_are_not_copied_for_every_coarse_cell(spark, monkeypatch):
    points = spark.createDataFrame([(i, float(i % 37) * 11, float(i % 41) * 7) for i in range(900)], "pid long, x double, y double")
    asked = spark.createDataFrame([(i, i * 1.7, i * 0.9) for i in range(200)] + [(None, 1.0, 1.0), (900, 1e14, -1e14)],
                                  "rid long, qx double, qy double")
    plans, real = [], knn.cut_lineage
    monkeypatch.setattr(knn, "cut_lineage", lambda df: plans.append(_plan(df)) or real(df))
    got = {r.rid: r.distance for r in knn.nearest_points(asked, points, "rid", "pid", leaf_points=8).collect()}
    rows = points.collect()
    for q in asked.collect():
        near = min(((p.x - q.qx) ** 2 + (p.y - q.qy) ** 2) ** 0.5 for p in rows)
        assert abs(got[q.rid] - near) <= 1e-9 * max(1.0, near)
    assert "sequence(0, 63" not in plans[-1]


def test_equal_address_texts_are_compared_once(spark, monkeypatch):
    texts = ["12 Rata Street, Northport", "7 Mill Lane, Eastmoor", "7 MILL LANE, EASTMOOR"]
    table = spark.createDataFrame([(i, texts[i % 3]) for i in range(5, 605)], "address_id long, full_address_ascii string")
    stored = _stored(monkeypatch, matching)
    asked = spark.createDataFrame([("12 rata street northport",), ("7 mil lane, eastmoor",), ("zzqx 1",)], "norm string")
    got = {r.norm: r.address_id for r in matching.similarity_join(asked, table, req_key="norm").collect()}
    assert got == {"12 rata street northport": 6, "7 mil lane, eastmoor": 5}
    assert max(df.count() for df in stored) < 600  # two texts and three requests, exploded to grams


def test_addresses_a_pattern_cannot_tell_apart_are_matched_once(spark, monkeypatch):
    rows = [(i, 12, "Rata Street", "Rata Street", "Locality 1", "Northport") for i in range(9, 3, -1)]
    rows += [(50, 12, "Rata Road", None, None, "Westfield"), (51, 3, None, None, None, None)]
    table = spark.createDataFrame(rows, "address_id long, address_number int, full_road_name string, full_road_name_ascii string, "
                                        "suburb_locality string, town_city string")
    stored = _stored(monkeypatch, matching)
    patterns = spark.createDataFrame([(12, "rata street", None), (12, "rata", "westfield"), (12, "", None), (12, "r", None), (3, "", None)],
                                     "number int, street string, city string")
    got = {(r.number, r.street): (r.n_match, r.best_id, r.best_prio) for r in matching.match_patterns(patterns, table).collect()}
    assert got == {(12, "rata street"): (5, 4, 0), (12, "rata"): (5, 50, 1), (12, ""): (5, 4, 0), (12, "r"): (5, 4, 0)}
    assert [df.count() for df in stored] == [3]


def test_point_on_surface_is_worked_out_once_per_suburb(spark, monkeypatch):
    ring = lambda x, y, s: [[[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]]
    geom = "geom array<array<array<struct<x:double,y:double>>>>"
    stage = spark.createDataFrame([("1", "in", None, ring(1.0, 1.0, 2.0)), ("2", "out", None, ring(-50.0, 0.0, 3.0))],
                                  f"id string, name string, major_name string, {geom}")
    districts = spark.createDataFrame([("7", ring(0.0, 0.0, 100.0)), ("8", ring(200.0, 0.0, 100.0))], f"district_id string, {geom}")
    plans, real = [], load.spatial.first_containing
    monkeypatch.setattr(load.spatial, "first_containing",
                        lambda points, *a, **k: plans.append(points._jdf.queryExecution().optimizedPlan().toString()) or real(points, *a, **k))
    out = load.load_suburbs_cascade(stage, districts, flip=False, project=False).collect()
    assert sorted((r.suburb_id, r.district_id, r.method, r.distance) for r in out) == [("1", "7", "contains", 0.0), ("2", "7", "nearest", 47.0)]
    assert "lambda" not in plans[0]


def test_documents_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    d, out = str(tmp_path / "d"), tmp_path / "localities"
    spark.createDataFrame([(i, f"S{i}", i % 2) for i in range(60)], "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(0, "N0", 0), (1, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame([(0, "AFRICA")], "r_regionkey int, r_name string").write.parquet(f"{d}/region.parquet")
    monkeypatch.setattr(catalog_loads, "FILES_A_TASK", 10, raising=False)
    monkeypatch.setattr(catalog_loads, "_folder", lambda spark, name: str(out))
    got = catalog_loads.scan_locality_json(spark, d).collect()
    assert sorted(tuple(r) for r in got) == [(f"R{i:02d}", "AFRICA", 20) for i in (2, 3, 4)]
    parts = [f.name.split("-")[1] for f in out.iterdir() if f.name.startswith("part-")]
    assert len(parts) == 60 and len(set(parts)) > 1
