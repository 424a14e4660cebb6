"""All queries of the library, by name; importing this module imports every module that registers some."""

from __future__ import annotations

import importlib

from quarryline.plans.catalog import ORACLES, QUERIES

FLAGSHIP = "retrieval_budget"

for _name in ("retrieval", "integrity", "claims", "ledger", "scoring", "text", "gates", "graphs", "streams", "checks", "extras", "stores", "evaluation", "states", "rules", "executions"):
    importlib.import_module(f"quarryline.plans.{_name}")

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
