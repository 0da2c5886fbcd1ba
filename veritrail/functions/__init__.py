"""Column expressions and the few vectorised functions that have no built-in form."""
