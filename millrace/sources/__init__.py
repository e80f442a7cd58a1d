"""Tables: catalog rows, Parquet stores, generated data."""
