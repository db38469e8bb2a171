"""All registered queries and their SQL."""

from __future__ import annotations

from netloom.plans import catalog, catalog_inputs, catalog_product, catalog_serving  # noqa: F401  (they register)

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
