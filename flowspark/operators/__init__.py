"""DataFrame operators, grouped by purpose."""
