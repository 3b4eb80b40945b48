"""Physical-plan checks: no nested-loop or cartesian joins in the spatial,
matching and search operators; filters and column pruning reach the scan."""

import pytest

import __spark_entry__ as E

from conftest import SF

NO_NLJ = ["pip_join", "resolve_hierarchy", "streets_by_suburb", "nearest_address", "verify", "autocomplete",
          "region_by_overlap", "suburb_district_cascade", "polygon_distance", "fill_centroids"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_NLJ)
def test_no_nested_loop_or_cartesian(spark, name):
    p = _plan(E.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in p
    assert "CartesianProduct" not in p


def test_scan_prunes_columns(spark):
    p = _plan(E.queries()["normalize_documents"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
