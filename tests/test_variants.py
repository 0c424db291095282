"""Reference template variables map onto catalog parameters."""

from airlens.operators import catalog
from airlens.operators.variants import to_params, run_variant
from airlens.sources.tables import tables
from tests.conftest import SF_SMALL


def test_mapping():
    p = to_params(4, {"code_location": "city", "code_stats": -2, "code_col": "PM10",
                      "code_time": [12, 1, 2], "code_year": 2021, "code_method": "quantile(0.75)"},
                  year_offset=-23)
    assert p == {"loc": "city", "positions": (-2,), "pm": "pm10", "season": "Winter",
                 "year": 1998, "stat": "q75"}
    assert to_params(37, {"method_1": "len(merged_df)-3", "method_2": "var()", "col": "PM2.5"}) == \
        {"positions": (-3,), "stat": "var", "pm": "pm25"}
    assert to_params(63, {"method_1": "2", "state_code": "city", "inc_code": "False"}) == \
        {"positions": (2,), "loc": "city", "ascending": False}
    assert to_params(57, {"method_1": "median()", "col": "PM10", "code_val": "60"}) == \
        {"stat": "median", "pm": "pm10", "values": (60.0,)}


def test_run_variant_equals_direct_call(spark):
    t = tables(spark, SF_SMALL)
    ref = {"code_location": "state", "code_stats": 1, "code_col": "PM2.5"}
    a = run_variant(t, 2, ref).collect()
    b = catalog.t2(t, loc="state", pm="pm25", positions=(1,)).collect()
    assert a == b and len(a) == 1
