"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in SHARE of all rows, so there are fewer than SHARE hot keys, whatever the table's size.
SHARE = 1000


def join_hot(rows: DataFrame, told: DataFrame, key: list[str], total: int, n: str = "n") -> DataFrame:
    """``rows`` joined with ``told``, which has one row of a few numbers for each key and, in ``n``, how many of the ``total`` rows have it (or more).

    What is told of hot keys is broadcast, so their rows stay where they are; the others meet by a shuffle.  Both frames are read twice.
    """
    hot = told.filter(F.col(n) * SHARE > total)
    cold = told.filter(F.col(n) * SHARE <= total)
    stay = rows.join(F.broadcast(hot), key)
    return stay.unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key))
