"""Queries over the driver tables: each module maps names to a Spark plan and to the same query in DuckDB SQL."""
