"""End-to-end jobs, and the registered queries with their DuckDB SQL."""
