"""Rating, four-factor and rate formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hardwood.schemas import FT_COEF, LEAGUE_RULES, OLIVER_OREB_WEIGHT, BOX_COUNTS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def ratio(num, den, when: Column | None = None) -> Column:
    """num / den where den is positive (and `when` holds), else NULL."""
    num, den = _c(num), _c(den)
    ok = den > 0 if when is None else (den > 0) & when
    return F.when(ok, num / den)


def floor_at_zero(x) -> Column:
    """Negative to zero; NULL stays NULL (unlike `greatest`)."""
    x = _c(x)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def clamp(x, lo: float, hi: float) -> Column:
    x = _c(x)
    return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def simple_possessions(fga="fga", fta="fta", tov="tov", oreb="oreb", ft_coef: float = FT_COEF) -> Column:
    return _c(fga) + F.lit(ft_coef) * _c(fta) + _c(tov) - _c(oreb)


def oliver_possessions(fga, fgm, fta, tov, oreb, opp_dreb, ft_coef: float = FT_COEF) -> Column:
    fga, fgm, fta, tov, oreb, opp_dreb = map(_c, (fga, fgm, fta, tov, oreb, opp_dreb))
    chances = oreb + opp_dreb
    rate = F.when(chances > 0, oreb / chances).otherwise(F.lit(0.0))
    return fga + F.lit(ft_coef) * fta + tov - F.lit(OLIVER_OREB_WEIGHT) * rate * (fga - fgm)


def efg(fgm="fgm", fg3m="fg3m", fga="fga") -> Column:
    return ratio(_c(fgm) + F.lit(0.5) * _c(fg3m), fga)


def rebound_share(own, other) -> Column:
    return ratio(own, _c(own) + _c(other))


def true_shooting(pts="pts", fga="fga", fta="fta", ft_coef: float = 0.44) -> Column:
    load = _c(fga) + F.lit(ft_coef) * _c(fta)
    return F.when(load > 0, _c(pts) / (F.lit(2.0) * load))


def used_possessions(fga="fga", fta="fta", tov="tov") -> Column:
    return _c(fga) + F.lit(0.44) * _c(fta) + _c(tov)


def turnover_share_of_used(fga="fga", fta="fta", tov="tov") -> Column:
    """Player / strip-plot turnover rate: share of used possessions, not of team possessions."""
    return ratio(tov, used_possessions(fga, fta, tov))


def pace(poss, opp_poss, minutes, regulation: float = 48.0) -> Column:
    poss, opp_poss, minutes = _c(poss), _c(opp_poss), _c(minutes)
    return F.when(minutes > 0, F.lit(regulation) * (poss + opp_poss) / (F.lit(2.0) * minutes))


def pro_game_minutes(periods) -> Column:
    """48 minutes plus 5 per overtime; NULL below four periods."""
    p = _c(periods)
    return F.when(p >= 4, F.lit(48.0) + F.lit(5.0) * (p - 4))


def league_rule(league, field: str) -> Column:
    """Rule value of the row's league as a CASE over the fixed rule table."""
    league = _c(league)
    out = None
    for name, rules in LEAGUE_RULES.items():
        cond = league == name
        out = F.when(cond, F.lit(rules[field])) if out is None else out.when(cond, F.lit(rules[field]))
    return out


def league_game_minutes(league, periods) -> Column:
    """Regulation plus overtime minutes; missing or short period counts read as regulation."""
    reg = league_rule(league, "reg_periods")
    played = F.greatest(F.coalesce(_c(periods), reg), reg)
    return (
        reg * league_rule(league, "period_seconds") / F.lit(60.0)
        + (played - reg) * league_rule(league, "ot_seconds") / F.lit(60.0)
    )


def with_team_metrics(
    df: DataFrame, ft_coef: float = FT_COEF, estimator: str = "oliver", regulation: float = 48.0
) -> DataFrame:
    """Possessions, ratings and both sides' four factors; pace only when lengths are known."""
    if estimator == "oliver":
        own = oliver_possessions("fga", "fgm", "fta", "tov", "oreb", "opp_dreb", ft_coef)
        opp = oliver_possessions("opp_fga", "opp_fgm", "opp_fta", "opp_tov", "opp_oreb", "dreb", ft_coef)
    elif estimator == "simple":
        own = simple_possessions(ft_coef=ft_coef)
        opp = simple_possessions("opp_fga", "opp_fta", "opp_tov", "opp_oreb", ft_coef)
    else:
        raise ValueError(f"unknown possession estimator {estimator!r}; use 'oliver' or 'simple'")
    out = df.withColumn("poss", (own + opp) / 2).withColumn("opp_poss", F.col("poss"))
    out = out.withColumns({
        "ortg": F.when(F.col("poss") > 0, F.lit(100.0) * F.col("pts") / F.col("poss")),
        "drtg": F.when(F.col("poss") > 0, F.lit(100.0) * F.col("opp_pts") / F.col("poss")),
    })
    cols = {"net_rtg": F.col("ortg") - F.col("drtg")}
    for me, them in (("", "opp_"), ("opp_", "")):
        cols |= {
            f"{me}efg": efg(f"{me}fgm", f"{me}fg3m", f"{me}fga"),
            f"{me}tov_pct": ratio(f"{me}tov", "poss"),
            f"{me}orb_pct": rebound_share(f"{me}oreb", f"{them}dreb"),
            f"{me}ft_rate": ratio(f"{me}fta", f"{me}fga"),
            f"{me}ts_pct": true_shooting(f"{me}pts", f"{me}fga", f"{me}fta"),
        }
    if "game_minutes" in df.columns:
        cols["pace"] = pace("poss", "opp_poss", "game_minutes", regulation)
    return out.withColumns(cols)


PAIRED_COUNTS = BOX_COUNTS + [f"opp_{c}" for c in BOX_COUNTS]


def position_group(pos) -> Column:
    """Guard / forward / centre by containment; anything else NULL."""
    pos = _c(pos)
    return F.when(pos.contains("G"), "G").when(pos.contains("F"), "F").when(pos == "C", "C")


def position_group_listed(pos) -> Column:
    """College variant: listed forwards and centres, everything else a guard."""
    pos = _c(pos)
    return (
        F.when(pos.isin("F", "SF", "PF", "F-C"), "Forward").when(pos == "C", "Center").otherwise("Guard")
    )


def net_per_100(pts, opp_pts, pace_) -> Column:
    return F.lit(100.0) * (_c(pts) - _c(opp_pts)) / _c(pace_)


def expected_spread(r_home, r_away, term, pace_) -> Column:
    return (_c(r_home) - _c(r_away) + _c(term)) * _c(pace_) / F.lit(100.0)


def quadrant(ortg, drtg, avg_ortg, avg_drtg) -> Column:
    """Region of an efficiency chart relative to the averages (lower drtg is better)."""
    good_off, good_def = _c(ortg) >= _c(avg_ortg), _c(drtg) <= _c(avg_drtg)
    return (
        F.when(_c(ortg).isNull() | _c(drtg).isNull(), None)
        .when(good_off & good_def, "good offense, good defense")
        .when(good_off, "good offense, bad defense")
        .when(good_def, "bad offense, good defense")
        .otherwise("bad offense, bad defense")
    )
