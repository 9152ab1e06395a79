"""Table catalogs and data sources."""
