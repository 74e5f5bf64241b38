"""recordsync: keep large collections of multi-part records clean, searchable and in step, on Spark."""
