"""Registered queries: operators on the given tables, and the DuckDB SQL they are compared with."""
