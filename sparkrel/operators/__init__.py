"""Relational operators: filters, select, named queries, prepared queries, shortcuts and data changes."""
