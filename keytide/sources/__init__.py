"""The stored table: Parquet data files, an atomic commit log, and the command interface."""
