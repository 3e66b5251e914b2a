"""A web-corpus engine over Spark tables."""
