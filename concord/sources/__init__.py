"""Readers: files as records, class folders, CSV and Parquet tables."""
