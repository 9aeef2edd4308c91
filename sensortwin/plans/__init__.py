"""Query plans: lazily built inputs, the registered query catalog, DuckDB oracle SQL."""
