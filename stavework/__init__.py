"""Timed event-sequence analytics on Spark: every operator is DataFrame -> DataFrame, keyed by track."""
