"""Ordered, versioned key-value logs as Spark relations."""
