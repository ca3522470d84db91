"""Sources and sinks: managed Parquet tables (family A), text sources, and fixture views."""
