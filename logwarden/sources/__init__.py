"""Readers for raw log lines and the log views of the sample tables."""
