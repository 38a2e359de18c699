"""The versioned store: immutable Parquet files and one manifest for each commit."""
