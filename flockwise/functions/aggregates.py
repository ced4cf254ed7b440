"""Aggregates that Spark has but doesn't name in its public functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from pyspark.sql.internal import InternalFunction
except ImportError:  # another release
    InternalFunction = None


def top_k(value: Column, k: int, smallest: bool = False) -> Column:
    """An array of the k largest (or smallest) values of a group, in no order.

    A bounded priority queue in each task, merged after the shuffle. A release of Spark without that aggregate gives
    the same result from all values of the group.
    """
    if hasattr(InternalFunction, "collect_top_k"):
        return InternalFunction.collect_top_k(value, k, smallest)
    return F.slice(F.sort_array(F.collect_list(value), asc=smallest), 1, k)
