"""Document-to-record analytics on Spark: page assembly, field extraction, typed records."""
