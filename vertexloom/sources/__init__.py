"""Readers and writers: text forms, property-graph tables and query results."""
