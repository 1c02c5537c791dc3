"""Rounding with the tie rule of Python's ``round`` as a column expression.

Spark's ``round`` and ``bround`` decide ties on the shortest decimal text of a double.
Python decides on its exact binary value, so ``round(2.675, 2)`` is 2.67 and
``round(12.25, 1)`` is 12.2.  Published scores follow the latter, so do we.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _powers_of_two(n: int) -> list[int]:
    """The binary summands of ``n``, largest first: 20 -> [16, 4]."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def py_round(x: Column | str, digits: int) -> Column:
    """``round(x, digits)`` for doubles, exact at ties.

    With f = floor(10^d * x) the halfway point is (2f+1) / (2*10^d).  Its distance from x
    is summed as 2*10^d*x - (2f+1) in power-of-two steps; each step is exact in floating
    point because the remainder shrinks as fast as its unit, so the sign is exact too.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = 10 ** digits
    low = F.floor(x * F.lit(float(scale)))
    halfway = (low * 2 + 1).cast("double")
    steps = _powers_of_two(2 * scale)
    distance = x * F.lit(float(steps[0])) - halfway
    for step in steps[1:]:
        distance = distance + x * F.lit(float(step))
    up = (F.when(distance > 0, F.lit(1)).when(distance < 0, F.lit(0))
          .otherwise(F.pmod(low, F.lit(2))))
    rounded = (low + up).cast("double") / F.lit(float(scale))
    # From 1e12 on the steps above are no longer exact; a double there has few binary places left,
    # so its shortest decimal text decides.
    return F.when(F.isnan(x), x).when(F.abs(x) >= F.lit(1e12), F.bround(x, digits)).otherwise(rounded)
