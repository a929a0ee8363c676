"""DuckDB statements equivalent to the registered queries."""
