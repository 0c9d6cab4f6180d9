"""Game clock parsing, printing and time-remaining expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hardwood.functions.metrics import _c, league_rule


def clock_to_seconds(clock) -> Column:
    """'M:SS' or bare seconds to a double; anything else is NULL."""
    x = F.trim(_c(clock))
    minutes = F.split_part(x, F.lit(":"), F.lit(1)).try_cast("double")
    seconds = F.split_part(x, F.lit(":"), F.lit(2)).try_cast("double")
    return F.when(x.contains(":"), minutes * 60 + seconds).otherwise(x.try_cast("double"))


def round_half_even(x, digits: int = 0) -> Column:
    return F.bround(_c(x), digits)


def seconds_to_clock(secs) -> Column:
    s = F.bround(_c(secs)).cast("int")
    return F.when(s.isNotNull(), F.format_string("%d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60))))


def period_seconds(league, period) -> Column:
    reg = league_rule(league, "reg_periods")
    return F.when(_c(period) <= reg, league_rule(league, "period_seconds")).when(
        _c(period) > reg, league_rule(league, "ot_seconds")
    )


def seconds_left_in_game(league, period, secs) -> Column:
    """Remaining regulation time; an overtime period counts only itself."""
    reg = league_rule(league, "reg_periods")
    period, secs = _c(period), _c(secs)
    return F.when(period <= reg, secs + (reg - period) * league_rule(league, "period_seconds")).when(
        period > reg, secs
    )
