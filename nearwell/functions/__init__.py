"""Column functions: plain expressions over Columns, no Python in the row path."""
