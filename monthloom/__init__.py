"""Leakage-safe panel analytics on security-by-month tables, written as Spark jobs."""
