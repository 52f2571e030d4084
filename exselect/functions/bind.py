"""Name a computed value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once, however often fn uses it.

    Without it, a chain of conditional text steps repeats its input in every branch and outgrows the
    size of a generated method.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))
