"""A PySpark library for conversation-memory evaluation data."""
