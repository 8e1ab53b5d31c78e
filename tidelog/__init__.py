"""Keyed-log analytics on PySpark: operators over append-only logs and their metadata."""
