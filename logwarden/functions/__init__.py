"""Column builders: every function here maps Columns to a Column."""
