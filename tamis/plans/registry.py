"""Every query of the engine by name, and the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from tamis.plans import catalogue, detection, reporting, streams

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (detection, reporting, catalogue, streams):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
