"""Sources and sinks: the driver's parquet as retail tables, CSV ingest, exports, the table store and the generator."""
