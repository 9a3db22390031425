"""rowlens: data-quality profiling, detection, rules and reporting as Spark jobs."""

from rowlens.operators.table import ColumnRef, Table
from rowlens.plans.analysis import Analysis, analyze

__all__ = ["Analysis", "ColumnRef", "Table", "analyze"]
