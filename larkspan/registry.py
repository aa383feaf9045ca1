"""All registered queries and their SQL, collected from the plan modules."""

from __future__ import annotations

from importlib import import_module

from larkspan.catalog import ORACLE_SQL, QUERIES

#: Importing a plan module registers its queries.
PLANS = ("relational", "ranking", "text_functions", "retrieval", "stores", "graph_memory", "operations", "streams", "pipelines", "composites")

for _name in PLANS:
    import_module(f"larkspan.plans.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
