"""String rules: event grammar, number cleaning, names, standings and display lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hardwood.functions.clock import round_half_even
from hardwood.functions.metrics import _c
from hardwood.schemas import (
    FREQ_BAD_CATEGORIES, FREQ_RANKED_DIMENSIONS, RANK_DISPLAY_MAX_POPULATION, UNIT_DENOMINATOR,
    UNIT_PHRASE,
)

# Event patterns, matched without regard to case on type + text.
P_FREE_THROW = "free throw"
P_REBOUND = "rebound"
P_OFF_REBOUND = "offensive rebound"
P_DEAD_BALL = "dead ball"
P_STEAL = "steal"
P_TURNOVER = "turnover|traveling|double dribble|palming|backcourt|shot clock"
P_SHOT = "shot|jumper|layup|dunk"
P_PROFILE_NOT_SHOT = "rebound|free throw|block"
P_FT_COUNT = r"free throw\s+(\d+)\s+of\s+(\d+)"
P_DEAD_REBOUND = "dead ?ball|team rebound"
P_FOUL = "foul"
P_SUB_TYPE = "substitution"
P_SUB_TEXT = "subbing (in|out)|enters"
P_SUB_IN = "subbing in|enters|checks in"
P_SUB_OUT = "subbing out|leaves|checks out"
P_THREE = "three point|3-point"


def matches(x, pattern: str) -> Column:
    """Case-insensitive containment of a pattern; NULL reads as no match."""
    return F.coalesce(_c(x).rlike(f"(?i){pattern}"), F.lit(False))


def event_blob(type_text="type_text", text="text") -> Column:
    return F.concat_ws(" ", F.coalesce(_c(type_text), F.lit("")), F.coalesce(_c(text), F.lit("")))


def truthy(x, dtype: str) -> Column:
    """Boolean from a boolean, 0/1 or 'true'/'t'/'yes' column; NULL is false."""
    x = _c(x)
    if dtype == "boolean":
        out = x
    elif dtype == "string":
        out = F.lower(x).isin("true", "t", "yes")
    else:
        out = x == 1
    return F.coalesce(out, F.lit(False))


def free_throw_count(text) -> tuple[Column, Column]:
    """(shot, of) stated as 'free throw N of M'; NULL when not stated."""
    low = F.lower(_c(text))
    # nullif guards the cast: regexp_extract gives '' on no match
    grab = lambda k: F.nullif(F.regexp_extract(low, P_FT_COUNT, k), F.lit("")).try_cast("int")
    return grab(1), grab(2)


def is_three_point(text="text", score_value="score_value") -> Column:
    return matches(text, P_THREE) | F.coalesce(_c(score_value) == 3, F.lit(False))


def inferred_points(text) -> Column:
    return F.when(matches(text, "three"), 3).when(matches(text, P_FREE_THROW), 1).otherwise(2)


def substitution_flag(type_text="type_text", text="text") -> Column:
    return matches(type_text, P_SUB_TYPE) | matches(text, P_SUB_TEXT)


def substitution_direction(is_sub, text, first, second) -> Column:
    """paired / in / out; 'out' wins when a single event reads both ways."""
    is_sub, first, second = _c(is_sub), _c(first), _c(second)
    return F.when(
        is_sub,
        F.when(first.isNotNull() & second.isNotNull(), "paired")
        .when(matches(text, P_SUB_OUT), "out")
        .when(matches(text, P_SUB_IN), "in"),
    )


def parse_minutes(x) -> Column:
    """'MM:SS' or a plain number to decimal minutes."""
    x = F.trim(_c(x))
    mm = F.nullif(F.regexp_extract(x, r"^(\d+):", 1), F.lit("")).try_cast("double")
    ss = F.nullif(F.regexp_extract(x, r":(\d+)$", 1), F.lit("")).try_cast("double")
    return F.when(mm.isNotNull(), mm + ss / 60).otherwise(F.nullif(x, F.lit("")).try_cast("double"))


def clean_number(x) -> Column:
    """Keep digits, dot and minus; blank is zero; NULL stays NULL."""
    kept = F.regexp_replace(F.trim(_c(x)), "[^0-9.-]", "")
    return F.when(kept == "", F.lit(0.0)).otherwise(kept.try_cast("double"))


def short_name(full) -> Column:
    parts = F.split(F.trim(_c(full)), r"\s+")
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " ")
    return F.when(F.size(parts) < 2, F.array_join(parts, " ")).otherwise(
        F.concat(F.substring(F.get(parts, F.lit(0)), 1, 1), F.lit(". "), rest)
    )


def expand_position(pos) -> Column:
    """G/F to Guard/Forward; an unknown part leaves the text as it is; blank is NULL."""
    pos = _c(pos)
    long = lambda p: F.when(p == "G", "Guard").when(p == "F", "Forward").when(p == "C", "Center")
    parts = F.transform(F.split(pos, "/"), long)
    known = F.forall(parts, lambda p: p.isNotNull())
    return F.when(pos.isNull() | (pos == ""), None).when(known, F.array_join(parts, "/")).otherwise(pos)


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def ordinal(n) -> Column:
    n = _c(n).cast("int")
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    suffix = (
        F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd")
        .when(ones == 3, "rd").otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def rank_from_percentile(pctl, n) -> Column:
    n = _c(n)
    return round_half_even(n - _c(pctl) * (n - 1) / F.lit(100.0)).cast("int")


def flip_percentile(pctl) -> Column:
    return (F.lit(100) - _c(pctl)).cast("int")


def reads_inverted(dimension, category) -> Column:
    return _c(dimension).isin(FREQ_RANKED_DIMENSIONS) & _c(category).isin(FREQ_BAD_CATEGORIES)


def _lookup(x, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(_c(x) == k, v) if out is None else out.when(_c(x) == k, v)
    return out


def unit_denominator(unit) -> Column:
    return _lookup(unit, UNIT_DENOMINATOR)


def unit_phrase(unit) -> Column:
    return _lookup(unit, UNIT_PHRASE)


def two_decimals(x) -> Column:
    # half-even before printing: the formatter itself would round ties up
    return F.format_string("%.2f", F.bround(_c(x), 2))


def whole_percent(share) -> Column:
    """Share as whole percent, half-even like the percentiles."""
    return F.concat(round_half_even(_c(share) * 100).cast("int").cast("string"), F.lit("%"))


def volume_line(freq, ppp, unit, ppp_meaningful) -> Column:
    """Volume and rate; the rate is dropped where points carry no signal."""
    vol = F.concat(whole_percent(freq), F.lit(" "), unit_denominator(unit))
    return F.when(
        F.coalesce(_c(ppp_meaningful), F.lit(True)),
        F.concat(vol, F.lit(" · "), two_decimals(ppp), F.lit(" "), unit_phrase(unit)),
    ).otherwise(vol)


#: Names of the good and the bad end of a quantity that is better when small.
ENDS = ("lowest", "highest")


def inverted_standing(pctl, n, population, compact: bool = False, ends: tuple[str, str] = ENDS) -> Column:
    """Place counted from the nearer end, for a rank whose label names the bad quantity."""
    n = _c(n)
    from_good = rank_from_percentile(pctl, n)
    from_bad = n + 1 - from_good
    place, end = F.least(from_good, from_bad), F.when(from_good <= n / 2, ends[0]).otherwise(ends[1])
    text = F.concat(F.when(place > 1, F.concat(ordinal(place), F.lit(" "))).otherwise(""), end)
    whole = text if compact else F.concat(text, F.lit(" of the "), _c(population))
    return F.when(_c(pctl).isNull(), "unranked").otherwise(whole)


def row_standing(pctl, n, population, dimension, category, compact: bool = False) -> Column:
    plain = F.concat(ordinal(rank_from_percentile(pctl, n)), F.lit(" of "), _c(n).cast("string"))
    return (
        F.when(reads_inverted(dimension, category), inverted_standing(pctl, n, population, compact))
        .when(_c(pctl).isNull(), "unranked")
        .otherwise(plain)
    )


def standing(pctl, n, population, mode: str = "auto", defense: bool = False) -> Column:
    """Rank in small populations, percentile in large ones."""
    n, pctl = _c(n), _c(pctl)
    ranked = F.concat(
        ordinal(rank_from_percentile(pctl, n)), F.lit(" of "), n.cast("string"),
        F.lit(" defensively" if defense else ""), F.lit(" in the "), _c(population),
    )
    pct = F.concat(ordinal(pctl), F.lit(" percentile " + ("defensively" if defense else "offensively")))
    as_rank = {"rank": F.lit(True), "percentile": F.lit(False)}.get(mode, n <= RANK_DISPLAY_MAX_POPULATION)
    return F.when(pctl.isNull(), "unranked").when(as_rank, ranked).otherwise(pct)


def split_at_dash(sentence) -> tuple[Column, Column]:
    """(action, evidence): the part after the last em dash as a headline, the part before it.

    Without a dash the whole sentence is the action and the evidence is empty.
    """
    s = _c(sentence)
    tail = F.substring_index(s, " — ", -1)
    head = F.left(s, F.length(s) - F.length(tail) - F.lit(3))
    bare = F.regexp_replace(tail, r"\.$", "")
    action = F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))
    has = s.contains(" — ")
    return F.when(has, action).otherwise(s), F.when(has, head).otherwise(F.lit(""))


def build_url(prefix: str, ident, suffix: str) -> Column:
    return F.concat(F.lit(prefix), _c(ident).cast("string"), F.lit(suffix))
