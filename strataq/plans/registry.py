"""All queries of the engine's own operators, and their DuckDB twins, by name."""

from __future__ import annotations

from strataq.plans import extra, maps, more, records, updates

QUERIES: dict = maps.QUERIES | more.QUERIES | extra.QUERIES | updates.QUERIES | records.QUERIES
ORACLES: dict[str, str] = maps.ORACLES | more.ORACLES | extra.ORACLES | updates.ORACLES | records.ORACLES
