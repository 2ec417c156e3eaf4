"""All queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from reviewlake.plans.registry import ORACLES, QUERIES

#: Modules that register queries.
MODULES = ("funnel", "scalars", "relational", "nested", "projections", "roundtrips")

for _name in MODULES:
    import_module(f"reviewlake.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
