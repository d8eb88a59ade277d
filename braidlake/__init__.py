"""A Spark engine for versioned, multi-writer relational data."""
