"""Readers: parquet test tables, contract CSV, JSON lines, sniffed text, zip members."""
