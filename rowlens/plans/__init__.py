"""Composed plans: the whole analysis, its stored tables, rule exports and the report."""
from rowlens.plans.analysis import Analysis, analyze
from rowlens.plans.store import RunStore

__all__ = ["Analysis", "RunStore", "analyze"]
