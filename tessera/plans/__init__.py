"""Plan-level helpers: tables that cut lineage, snapshots, settings."""
