"""Sources and sinks: CSV read (pandas missing-value tokens, declared types) and write
(Python-style text), and versioned parquet + JSON release bundles."""
