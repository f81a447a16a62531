"""Landed JSON responses to one wide table (A8 -> A9).

A response is a matrix ``[[header...], [row...], ...]`` that holds some of the
variables (a slice) of some units.  Its cells go to long form, and a single
aggregate per unit and variable replaces a chain of full joins of the slices: a
unit is in the table if any slice has it, and a variable that several cells give
is taken from the first slice, then row, then column.  Error objects, matrices of
the wrong shape or without the unit column, and rows without a unit code go to a
quarantine.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescore.operators.text import matrix_rows


def matrix_table(responses: DataFrame, order: str, payload: str, unit_header: str, columns: Mapping[str, str],
                 key: str = "unit") -> tuple[DataFrame, DataFrame]:
    """(table, quarantine) of responses; ``order`` ranks slices, and names a response in the quarantine.

    The table has ``key`` (trimmed) and, as text, the variables of ``columns``
    (header -> name) in that order; variables that no response has are null.
    """
    rows, bad = matrix_rows(responses, order, payload, [unit_header, *columns])
    place = F.get("__at", F.lit(0))
    lost = rows.where(place == 0).select(order, F.lit("no unit column").alias("reason")).distinct()
    rows = rows.where(place > 0).withColumn(key, F.trim(F.try_element_at("__r", place.cast("int"))))
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    lost = lost.unionByName(rows.where(empty).select(order, F.lit("no unit code").alias("reason")).distinct())
    # Rows are shuffled and sorted as they are; a unit without any variable has a row too.
    at = lambda i: F.get("__at", F.lit(i))
    first = [F.min(F.when(at(i) > 0, F.struct(order, "row", at(i), F.get("__r", (at(i) - 1).cast("int")).alias("value"))))["value"].alias(name)
             for i, name in enumerate(columns.values(), 1)]
    wide = rows.where(~empty).select(key, order, "row", "__at", "__r").repartition(key).groupBy(key).agg(*first)
    return wide, bad.unionByName(lost)
