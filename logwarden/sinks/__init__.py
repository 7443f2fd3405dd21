"""Writers for enriched tables, exports and raw-line archives."""
