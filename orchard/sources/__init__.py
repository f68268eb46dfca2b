"""Sources and sinks: driver Parquet tables, delimited text, models, histories."""
