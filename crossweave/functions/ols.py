"""Closed-form least squares on centred sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLINEAR = 1e-12


def two_slopes(s11: Column, s12: Column, s22: Column, s1y: Column, s2y: Column) -> tuple[Column, Column]:
    """Slopes of y on x1, x2 from centred cross-products.

    Collinear or constant regressors leave the fitted values of the one that
    varies, as a minimum-norm solution would.
    """
    det = s11 * s22 - s12 * s12
    regular = det > F.lit(COLLINEAR) * s11 * s22
    one = (s11 > 0) & ~regular
    b1 = F.when(regular, (s22 * s1y - s12 * s2y) / det).when(one, s1y / s11).otherwise(F.lit(0.0))
    b2 = F.when(regular, (s11 * s2y - s12 * s1y) / det).when(one, F.lit(0.0)) \
        .when(s22 > 0, s2y / s22).otherwise(F.lit(0.0))
    return b1, b2
