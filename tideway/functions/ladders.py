"""Score ladders of the backtest verdict.  Fixed values: the steps and points of each ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (least value, points), tried from the top; below the last: 0.
RETURN_STEPS = ((10.0, 30), (8.0, 28), (6.0, 24), (4.0, 20), (3.0, 18), (1.0, 12), (0.0, 8))
DRAWDOWN_STEPS = ((-10.0, 25), (-12.5, 22), (-15.0, 20), (-17.5, 18), (-20.0, 16), (-22.5, 13), (-25.0, 10))
#: (value that is not reached, points).
COST_STEPS = ((1.0, 12), (2.0, 9), (3.0, 6), (4.0, 3))
TAX_STEPS = ((1.0, 8), (2.5, 6), (5.0, 3))


def steps(x: Column, ladder, below: bool = False) -> Column:
    out = None
    for limit, points in ladder:
        reached = x < limit if below else x >= limit
        out = F.when(reached, points) if out is None else out.when(reached, points)
    return out.otherwise(0)


def grade(points: Column, most: int) -> Column:
    return F.when(points / most >= 0.8, "pass").when(points / most >= 0.5, "hold").otherwise("warn")
