"""Star-schema analytics on Spark: raw text to staging, warehouse, measures and reports."""
