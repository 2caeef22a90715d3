"""Queries over the driver's tables, and the graph of processing jobs."""
