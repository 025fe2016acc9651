"""Build expressions once.

``memo_expr``: a static column expression built once per SparkContext.
Column expressions are immutable trees; the large fixed ones (header
parsing, text classification) are otherwise rebuilt through hundreds of
Py4J calls every time a query is planned.

``with_once``: a column evaluated once per row.  The optimizer inlines a
projected expression into every later use and pushes filters through
projections by substituting it, so an expensive value referenced by
several fields and predicates is recomputed for each.  Producing it with a
one-element ``explode`` stops both (Catalyst does not collapse or push
predicates across a Generate on its output).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CACHE: dict[tuple, Column] = {}


def memo_expr(key: tuple, build: Callable[[], Column]) -> Column:
    sc = SparkContext._active_spark_context
    k = (id(sc), sc.applicationId if sc else None, *key)
    col = _CACHE.get(k)
    if col is None:
        col = build()
        _CACHE[k] = col
    return col


def with_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """``df`` plus column ``name`` = ``expr``, evaluated once per row."""
    cols = [c for c in df.columns if c != name]
    return df.select(*cols, F.explode(F.array(expr)).alias(name))
