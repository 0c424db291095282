"""Run any catalog variant from the reference's own template variables.

A question of the reference is a template id plus values for its code
variables (``code_col="PM2.5"``, ``code_method="quantile(0.75)"``,
``method_1="len(merged_df)-2"``, ...). ``to_params`` maps them to the
catalog function's parameters; ``run_variant`` runs it. ``year_offset``
shifts calendar years (the fixture data spans 1995-2001 for 2018-2024: -23).
"""

from __future__ import annotations

import inspect
import re

from airlens.functions.timefx import SEASONS_A
from airlens.operators import catalog

_PM = {"PM2.5": "pm25", "PM10": "pm10"}
_STAT = {"mean()": "mean", "median()": "median", "sum()": "sum", "std()": "std", "var()": "var",
         "quantile(0.25)": "q25", "quantile(0.75)": "q75"}
_FY_YEARS = {71: 2020, 72: 2021, 73: 2022}


def _position(v) -> int:
    """``-1``, ``2``, ``"0"``, ``"len(df)-3"`` -> int position (negative = from the end)."""
    if isinstance(v, int):
        return v
    m = re.fullmatch(r"\s*len\([^)]*\)\s*-\s*(\d+)\s*", str(v))
    return -int(m.group(1)) if m else int(v)


def to_params(template_id: int, ref: dict, year_offset: int = 0) -> dict:
    """Catalog parameters for template ``template_id`` from reference variables."""
    fn = getattr(catalog, f"t{template_id}")
    accepted = set(inspect.signature(fn).parameters)
    p: dict = {}
    for key, val in ref.items():
        if key in ("code_location", "state_code"):
            p["loc"] = val
        elif key in ("code_col", "col"):
            p["pm"] = _PM[val]
        elif key in ("code_method", "method_2"):
            p["stat"] = _STAT[val]
        elif key == "method_1" and template_id in (57, 58):
            p["stat"] = _STAT[val]
        elif key == "code_stats" and template_id in (25, 26):
            p["stat"] = _STAT[val]
        elif key in ("code_stats", "method_1"):
            p["positions"] = (_position(val),)
        elif key == "code_year":
            p["year"] = int(val) + year_offset
        elif key == "code_month":
            p["month"] = int(val)
        elif key == "code_time" and template_id == 4:
            months = tuple(val)
            p["season"] = next(name for name, ms in SEASONS_A.items() if ms == months)
        elif key == "code_time" and template_id == 27:
            p["last_years"] = int(val)
        elif key == "code_city":
            p["city"] = val
        elif key == "code_state":
            p["state"] = val
        elif key == "code_day":
            p["day"] = int(val)
        elif key == "code_num":
            p["nums"] = (int(val),)
        elif key == "code_limit":
            p["limits"] = (float(val),)
        elif key == "i":
            p["k"] = int(val)
        elif key in ("greater_bool", "code_below"):
            p["op"] = val
        elif key == "code_val":
            p["values"] = (float(val),)
        elif key == "inc_code":
            p["ascending"] = str(val) == "True"
        else:
            raise KeyError(f"T{template_id}: unknown template variable {key!r}")
    if template_id == 27 and "as_of_year" in accepted:
        p.setdefault("as_of_year", 2024 + year_offset)
    unknown = set(p) - accepted
    if unknown:
        raise KeyError(f"T{template_id}: parameters {sorted(unknown)} not accepted")
    return p


def run_variant(t, template_id: int, ref: dict, year_offset: int = 0):
    """The answer rows of one reference question."""
    fn = getattr(catalog, f"t{template_id}")
    return fn(t, **to_params(template_id, ref, year_offset))
