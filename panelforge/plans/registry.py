"""All queries of the library and their SQL."""

from panelforge.plans import catalogue, inventory, stored

MODULES = (catalogue, inventory, stored)
QUERIES, ORACLES = ({k: v for m in MODULES for k, v in getattr(m, what).items()} for what in ("QUERIES", "ORACLES"))
