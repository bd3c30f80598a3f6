"""Plans of nested results."""
