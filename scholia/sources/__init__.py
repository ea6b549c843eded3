"""Readers: parquet tables and text sources."""
