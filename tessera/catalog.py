"""Every query of the engine by name, with its SQL twin."""

from tessera.queries import ORACLES, QUERIES, consolidation, drivers, graphs, history, indexed, ingest, lookups, retrieval  # noqa: F401
