"""Column expressions and hooks for user functions."""
