"""Shot geometry in feet with the origin at centre court."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hardwood.functions.metrics import _c

# Court geometry in feet.
BASKET_X = 41.75
RIM_FEET = 4.0
PAINT_HALF_WIDTH = 6.0
PAINT_MIN_X = 28.0
CORNER_MIN_Y = 21.0
CORNER_MIN_X = 34.0


def shot_distance(x, y) -> Column:
    x, y = _c(x), _c(y)
    to_basket = F.sqrt(F.pow(F.abs(x) - F.lit(BASKET_X), F.lit(2.0)) + y * y)
    return to_basket


def in_paint(x, y) -> Column:
    return (F.abs(_c(y)) <= PAINT_HALF_WIDTH) & (F.abs(_c(x)) >= PAINT_MIN_X)


def shot_zone(x, y, is_three) -> Column:
    x, y = _c(x), _c(y)
    three = F.coalesce(_c(is_three), F.lit(False))
    corner = (F.abs(y) >= CORNER_MIN_Y) & (F.abs(x) >= CORNER_MIN_X)
    return (
        F.when(x.isNull() | y.isNull(), None)
        .when(three & corner, "corner_3")
        .when(three, "above_break_3")
        .when(shot_distance(x, y) <= RIM_FEET, "at_rim")
        .when(in_paint(x, y), "paint")
        .otherwise("mid_range")
    )
