"""Where tables come from: literal columns, Parquet files, and generated data."""
