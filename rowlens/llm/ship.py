"""Functions for Spark tasks that need no installed package on the executors."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Functions of `module` travel with the job instead of being imported by the executors."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)
