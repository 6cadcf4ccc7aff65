"""Reading text tables, and the files of an index: Parquet segments under a manifest."""
