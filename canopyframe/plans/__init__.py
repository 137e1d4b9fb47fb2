"""Registered queries: importing the modules fills the catalogue."""
from canopyframe.plans import registry

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES

from canopyframe.plans import (  # noqa: E402,F401
    scans,
    filters,
    scalar,
    joins,
    rasters,
    panels,
    crowns,
    stems,
    sessions,
    learned,
)
