"""All queries of the engine, and their SQL."""

from __future__ import annotations

from . import composed, core, domains, files

QUERIES = core.QUERIES | domains.QUERIES | composed.QUERIES | files.QUERIES
ORACLES = core.ORACLES | domains.ORACLES | composed.ORACLES | files.ORACLES
