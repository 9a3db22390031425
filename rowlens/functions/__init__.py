"""Column-level functions: text predicates, value shapes, security matching."""
