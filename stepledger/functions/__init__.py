"""Scalar functions: every one builds a Column from built-in expressions, none calls Python per row."""
