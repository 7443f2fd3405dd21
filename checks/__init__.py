"""Registered queries on the sample tables and the SQL they must agree with."""
