"""Review-revision analytics on PySpark: lake, aggregates, serving reads, text rules, streams."""
