"""Append-only versioned tables on Spark."""
