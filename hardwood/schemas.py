"""Declared schemas of the logical tables, league rules and fixed constants."""

from __future__ import annotations

# Schemas are DDL texts: readers take them as they are and no session is needed to import them.

BOX_COUNTS = ["pts", "fga", "fgm", "fg3m", "fta", "oreb", "dreb", "tov"]

TEAM_BOX = (
    "game_id string, team_id string, season int, season_type int, game_date date, "
    "team_home_away string, pts double, fga double, fgm double, fg3m double, fta double, "
    "oreb double, dreb double, tov double"
)

PLAYER_COUNTS = [
    "pts", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "reb", "ast", "stl",
    "blk", "tov", "pf",
]

PLAYER_BOX = (
    "season int, game_id string, game_date date, team_id string, athlete_id string, "
    "athlete_name string, position_raw string, minutes double, starter boolean, "
    "did_not_play boolean, " + ", ".join(f"{c} double" for c in PLAYER_COUNTS)
)

SCHEDULE = (
    "game_id string, season int, game_date date, home_id string, away_id string, "
    "home_abbreviation string, away_abbreviation string, home_display_name string, "
    "away_display_name string, home_conference_id string, away_conference_id string, "
    "home_score double, away_score double, status_type_completed boolean, status_period int, "
    "neutral_site boolean, notes_headline string, groups_id string, groups_short_name string"
)

PBP = (
    "league string, game_id string, sequence_number double, period_number int, "
    "clock_display_value string, team_id string, type_text string, text string, "
    "scoring_play boolean, score_value double, athlete_id_1 string, athlete_id_2 string, "
    "coordinate_x double, coordinate_y double, home_score int, away_score int, "
    "home_team_id string, away_team_id string, home_team_abbrev string, away_team_abbrev string, "
    "game_date date"
)

POSSESSIONS = (
    "game_id string, period int, poss_id int, off_team string, def_team string, "
    "clock_start string, clock_end string, seconds double, points int, context string, "
    "start_reason string, end_reason string, had_oreb boolean, start_idx int, end_idx int"
)

STINTS = (
    "game_id string, team string, opponent string, date date, stint_id int, period int, "
    "clock_start string, clock_end string, player_id_1 string, player_id_2 string, "
    "player_id_3 string, player_id_4 string, player_id_5 string, team_pts int, opp_pts int, "
    "stint_seconds double, lineup_valid boolean"
)

PROFILE = (
    "league string, season int, population string, team string, dimension string, "
    "category string, unit string, source string, off_n bigint, off_freq double, "
    "off_ppp double, off_ppp_pctl double, def_n bigint, def_ppp double, def_ppp_pctl double"
)

# League rules.
LEAGUE_RULES = {
    "wnba": {"reg_periods": 4, "period_seconds": 600, "ot_seconds": 300, "shot_clock": 24},
    "wbb": {"reg_periods": 4, "period_seconds": 600, "ot_seconds": 300, "shot_clock": 30},
    "mbb": {"reg_periods": 2, "period_seconds": 1200, "ot_seconds": 300, "shot_clock": 30},
    "nba": {"reg_periods": 4, "period_seconds": 720, "ot_seconds": 300, "shot_clock": 24},
}

# Season type codes.
SEASON_TYPES = {"regular": 2, "postseason": 3, "play_in": 5}

# Rating and win-probability constants.
FT_COEF = 0.44
OLIVER_OREB_WEIGHT = 1.07
RATING_LAMBDA = 3.0
CARRYOVER_DECAY = 0.9
HOME_TERM_EPS = 1e-8
FT_MAKE = 0.71
FT_OREB_KEEP = 0.20
DEFAULT_PACE = 70.6
MIN_PACE_GAMES = 15

# Possession and profile constants.
LIVE_BALL_STARTS = ["dreb", "steal", "made_fg", "made_ft"]
TRANSITION_SECONDS = 7
MIN_POSS_FOR_PERCENTILE = 50
FREQ_RANKED_DIMENSIONS = ["ball_security"]
FREQ_BAD_CATEGORIES = ["live_ball_to", "dead_ball_to"]

# Key selection.
KEY_STRENGTH_MIN = 70
KEY_WEAKNESS_MAX = 30
KEY_MIN_POSS = 50
KEY_MAX_BULLETS = 3
RANK_DISPLAY_MAX_POPULATION = 50

# Lineup score weights and position presets.
LINEUP_WEIGHTS = {
    "intercept": -72.88772, "efg": 144.50778, "tov": -93.57270, "oreb": 47.19972, "ftr": 18.79830,
}
LINEUP_PRESETS = {
    "balanced": {"G": (1, 3), "F": (1, 3), "C": (1, 2)},
    "big": {"G": (1, 2), "F": (1, 2), "C": (2, 2)},
    "small": {"G": (2, 4), "F": (2, 3), "C": (0, 1)},
}

# Display vocabularies.
CONTEXTS = ["halfcourt", "second_chance", "transition"]
SHOT_ZONES = ["at_rim", "paint", "mid_range", "corner_3", "above_break_3"]
UNIT_DENOMINATOR = {
    "possession": "of possessions", "attempt": "of attempts", "made_fg": "of made FGs",
}
UNIT_PHRASE = {
    "possession": "points per possession", "attempt": "points per attempt",
    "made_fg": "points per made FG",
}
