"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import ORACLES, PLANS, Query, bind

FAMILIES = ("point_in_time", "forecasting", "market", "evidence", "quality", "decisions", "ingest", "modelling", "live")

for _family in FAMILIES:
    importlib.import_module(f"{__package__}.{_family}")


def queries() -> dict[str, Query]:
    return {name: bind(plan) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
