"""All queries of the ledger and risk operators."""

from __future__ import annotations

from tidebook.plans import catalog_flows, catalog_ledger, catalog_more, catalog_risk, catalog_windows
from tidebook.plans.bindings import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_flows", "catalog_ledger", "catalog_more", "catalog_risk", "catalog_windows"]
