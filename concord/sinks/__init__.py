"""Writers: Parquet, CSV, appended runs, per-model results, table sets and text lines."""
