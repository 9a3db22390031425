"""Registered queries: every operator bound to the driver's tables, with the same result in SQL."""
