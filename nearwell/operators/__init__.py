"""DataFrame operators: pure functions, no action inside unless the docstring says so."""
