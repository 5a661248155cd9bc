"""Column-level functions: everything here maps columns to columns."""
