"""Play profile and scouting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.catalog.events import WALK
from hardwood.catalog.registry import query
from hardwood.functions import text as X
from hardwood.functions.text import split_at_dash
from hardwood.functions.arrays import rows_as_json
from hardwood.plans import profile as PR
from hardwood.plans import scouting as SC
from hardwood.session import materialize

SIDES = ("strength", "weakness", "attack")
MIN_N, MIN_POSS = 5, 8  # floors for the small event table, where a team has few games a season

CATEGORIES = WALK + """, gs AS (SELECT game_id, max(season) AS season FROM pbp GROUP BY 1),
 nxp AS (SELECT po.*, po.game_id AS po_game, season, lead(start_reason) OVER (PARTITION BY po.game_id ORDER BY poss_id) AS nxt FROM po JOIN gs ON po.game_id = gs.game_id),
 sh AS (SELECT league, season, game_id, CASE WHEN team_id = home_team_id THEN home_team_abbrev ELSE away_team_abbrev END AS off_team,
     CASE WHEN team_id = home_team_id THEN away_team_abbrev ELSE home_team_abbrev END AS def_team, made, assisted,
     CASE WHEN made THEN CASE WHEN is_three THEN 3 ELSE 2 END ELSE 0 END AS points,
     CASE WHEN coordinate_x IS NULL OR coordinate_y IS NULL THEN NULL
          WHEN is_three AND abs(coordinate_y) >= 21 AND abs(coordinate_x) >= 34 THEN 'corner_3' WHEN is_three THEN 'above_break_3'
          WHEN sqrt(pow(abs(coordinate_x) - 41.75e0, 2) + coordinate_y * coordinate_y) <= 4 THEN 'at_rim'
          WHEN abs(coordinate_y) <= 6 AND abs(coordinate_x) >= 28 THEN 'paint' ELSE 'mid_range' END AS zone
   FROM ev WHERE profile_shot AND team_id IN (home_team_id, away_team_id)),
 ca AS (SELECT league, season, po_game AS game_id, off_team, def_team, 'context' AS dimension, context AS category, 'possession' AS unit, points FROM nxp
   UNION ALL SELECT league, season, po_game, off_team, def_team, 'ball_security', CASE WHEN end_reason <> 'turnover' THEN 'no_turnover' WHEN nxt = 'steal' THEN 'live_ball_to'
             ELSE 'dead_ball_to' END, 'possession', points FROM nxp
   UNION ALL SELECT league, season, game_id, off_team, def_team, 'shot_zone', zone, 'attempt', points FROM sh WHERE zone IS NOT NULL
   UNION ALL SELECT league, season, game_id, off_team, def_team, 'creation', CASE WHEN assisted THEN 'assisted' ELSE 'unassisted' END, 'made_fg', points FROM sh WHERE made)"""

PROFILE = CATEGORIES + f""", ofs AS (SELECT league, season, off_team AS team, dimension, category, unit, count(*) AS off_n, sum(points) AS op FROM ca GROUP BY ALL),
 ofq AS (SELECT *, off_n / cast(sum(off_n) OVER (PARTITION BY league, season, team, dimension) AS double) AS off_freq, op / cast(off_n AS double) AS off_ppp FROM ofs),
 dfs AS (SELECT league, season, def_team AS team, dimension, category, unit, count(*) AS def_n, sum(points) / cast(count(*) AS double) AS def_ppp FROM ca GROUP BY ALL),
 jn AS (SELECT coalesce(o.league, d.league) AS league, coalesce(o.season, d.season) AS season, coalesce(o.team, d.team) AS team, coalesce(o.dimension, d.dimension) AS dimension, coalesce(o.category, d.category) AS category,
     coalesce(o.unit, d.unit) AS unit, off_n, off_freq, off_ppp, def_n, def_ppp FROM ofq o FULL JOIN dfs d
     ON o.league = d.league AND o.season = d.season AND o.team = d.team AND o.dimension = d.dimension AND o.category = d.category AND o.unit = d.unit),
 kk AS (SELECT *, CASE WHEN dimension = 'ball_security' THEN CASE WHEN category <> 'no_turnover' THEN -off_freq ELSE off_freq END ELSE off_ppp END AS ok,
     CASE WHEN dimension = 'ball_security' THEN CASE WHEN category <> 'no_turnover' THEN -1 ELSE 1 END * (def_n / cast(sum(def_n) OVER (PARTITION BY league, season, dimension, category) AS double))
          ELSE def_ppp END AS dk FROM jn),
 fl2 AS (SELECT *, coalesce(ok IS NOT NULL AND off_n >= {MIN_N}, false) AS og, coalesce(dk IS NOT NULL AND def_n >= {MIN_N}, false) AS dg FROM kk),
 prof AS (SELECT league, season, team, dimension, category, unit, 'pbp_derived' AS source, off_n, off_freq, off_ppp,
     CASE WHEN og AND count(*) OVER o >= 2 THEN round_even(100e0 * (rank() OVER (PARTITION BY league, season, dimension, category, og ORDER BY ok) + (count(*) OVER (PARTITION BY league, season, dimension, category, og, ok) - 1) / 2e0 - 1)
          / (count(*) OVER o - 1), 0) END AS off_ppp_pctl, def_n, def_ppp,
     CASE WHEN dg AND count(*) OVER d >= 2 THEN round_even(100e0 * (rank() OVER (PARTITION BY league, season, dimension, category, dg ORDER BY dk) + (count(*) OVER (PARTITION BY league, season, dimension, category, dg, dk) - 1) / 2e0 - 1)
          / (count(*) OVER d - 1), 0) END AS def_ppp_pctl
   FROM fl2 WINDOW o AS (PARTITION BY league, season, dimension, category, og), d AS (PARTITION BY league, season, dimension, category, dg))"""

LABELS = """, lab AS (SELECT 'pbp_derived' AS source, * FROM (VALUES ('context', 'transition', 'Transition', true), ('context', 'halfcourt', 'Half court', false),
  ('context', 'second_chance', 'Second chance', true), ('shot_zone', 'at_rim', 'At the rim', true), ('shot_zone', 'paint', 'Paint', true),
  ('shot_zone', 'mid_range', 'Mid-range', true), ('shot_zone', 'corner_3', 'Corner three', true), ('shot_zone', 'above_break_3', 'Above-the-break three', true),
  ('ball_security', 'live_ball_to', 'Live-ball turnovers', true), ('ball_security', 'dead_ball_to', 'Dead-ball turnovers', true),
  ('ball_security', 'no_turnover', 'Possessions kept', false)) v(dimension, category, display_label, bulletable))"""

GAMES = """, mt AS (SELECT DISTINCT league, season, home_team_abbrev AS team, away_team_abbrev AS opponent FROM pbp),
 card AS (SELECT mt.league, mt.season, mt.team, mt.opponent, u.dimension, u.category, u.unit, u.source, u.off_n AS poss, u.off_freq AS freq, u.off_ppp AS ppp, u.off_ppp_pctl AS ppp_percentile,
     t.def_ppp, t.def_ppp_pctl AS def_ppp_percentile FROM mt JOIN prof u ON u.league = mt.league AND u.season = mt.season AND u.team = mt.team JOIN prof t ON t.league = mt.league AND t.season = mt.season AND t.team = mt.opponent AND t.dimension = u.dimension AND t.category = u.category),
 rcard AS (SELECT mt.league, mt.season, mt.opponent AS team, mt.team AS opponent, u.dimension, u.category, u.unit, u.source, u.off_n AS poss, u.off_freq AS freq, u.off_ppp AS ppp, u.off_ppp_pctl AS ppp_percentile,
     t.def_ppp, t.def_ppp_pctl AS def_ppp_percentile FROM mt JOIN prof u ON u.league = mt.league AND u.season = mt.season AND u.team = mt.opponent JOIN prof t ON t.league = mt.league AND t.season = mt.season AND t.team = mt.team AND t.dimension = u.dimension AND t.category = u.category)"""


def keys_sql(card: str, side: str) -> str:
    rank = "def_ppp_percentile" if side == "attack" else "ppp_percentile"
    gate = f"{rank} < 30" if side == "weakness" else f"{rank} > 70"
    score = f"freq_rel * (100 - {rank})" if side == "weakness" else f"freq_rel * {rank}"
    return f"""SELECT *, row_number() OVER (PARTITION BY league, season, team, opponent ORDER BY key_score DESC, dimension, freq DESC, category) AS key_no
      FROM (SELECT *, {score} AS key_score, '{side}' AS side FROM (
        SELECT c.*, CASE WHEN max(freq) OVER g > 0 THEN freq / max(freq) OVER g ELSE 0 END AS freq_rel FROM {card} c
        WHERE {rank} IS NOT NULL AND poss >= {MIN_POSS} AND EXISTS (SELECT 1 FROM lab WHERE lab.bulletable AND lab.source = c.source AND lab.dimension = c.dimension AND lab.category = c.category)
        WINDOW g AS (PARTITION BY league, season, team, opponent, dimension)) q WHERE {gate}) z QUALIFY key_no <= 3"""


KEYS = PROFILE + LABELS + GAMES + (
    f", ks AS ({keys_sql('rcard', 'strength')} UNION ALL {keys_sql('rcard', 'weakness')} UNION ALL {keys_sql('card', 'attack')})"
)


def _profile(t):
    return PR.play_profile(t.pbp, min_n=MIN_N)


def _stored_profile(t):
    """Serving reads a stored profile; it never builds one more than once."""
    return materialize(_profile(t))


def _matchups(t):
    return t.pbp.select("league", "season", F.col("home_team_abbrev").alias("team"), F.col("away_team_abbrev").alias("opponent")).distinct()


def _keys(t):
    return SC.build_keys(_stored_profile(t), _matchups(t), SC.default_labels(t.spark), SIDES, MIN_POSS)


@query("category_rows", ("pbp",), CATEGORIES + " SELECT league, season, off_team, def_team, dimension, category, unit, count(*) AS n, cast(sum(points) AS bigint) AS points FROM ca GROUP BY ALL")
def category_rows(t):
    return PR.category_rows(t.pbp)


@query("category_rows_per_game", ("pbp",), CATEGORIES + " SELECT league, season, game_id, off_team, def_team, dimension, category, unit, count(*) AS n, cast(sum(points) AS bigint) AS points FROM ca GROUP BY ALL")
def category_rows_per_game(t):
    return PR.category_rows(t.pbp, per_game=True)


@query("play_profile", ("pbp",), PROFILE + " SELECT 'national' AS population, * FROM prof")
def play_stored_profile(t):
    return _stored_profile(t)



@query(
    "population_profile", ("pbp",),
    CATEGORIES + """ SELECT league, season, off_team AS team, dimension, category, count(*) AS off_n, cast(sum(points) AS bigint) AS points FROM ca
      WHERE off_team IN ('T03', 'T07', 'T11', 'T19') GROUP BY ALL""",
)
def population_stored_profile(t):
    """Only games of population teams are read; teams outside it drop out afterwards."""
    pop = t.spark.createDataFrame([("T03",), ("T07",), ("T11",), ("T19",)], "team string")
    from hardwood.operators.filters import population_games

    rows = PR.category_rows(population_games(t.pbp, pop))
    kept = rows.join(F.broadcast(pop.withColumnRenamed("team", "off_team")), "off_team", "left_semi")
    return kept.groupBy("league", "season", F.col("off_team").alias("team"), "dimension", "category").agg(
        F.sum("n").alias("off_n"), F.sum("points").alias("points")
    )


@query("matchup_card", ("pbp",), PROFILE + GAMES + " SELECT * FROM card")
def matchup_card(t):
    return SC.matchup_cards(_stored_profile(t), _matchups(t))


_SHOWN = """SELECT p.league, p.season, p.team, p.dimension, p.category, coalesce(l.display_label, p.category) AS label, coalesce(l.bulletable, true) AS bulletable,
   CASE WHEN off_freq IS NULL THEN NULL WHEN p.dimension = 'ball_security' THEN concat(cast(round_even(off_freq * 100, 0) AS int), '% of possessions')
        ELSE concat(cast(round_even(off_freq * 100, 0) AS int), '% ', CASE unit WHEN 'possession' THEN 'of possessions' WHEN 'attempt' THEN 'of attempts' ELSE 'of made FGs' END,
             ' · ', printf('%.2f', off_ppp), ' points per ', CASE unit WHEN 'made_fg' THEN 'made FG' ELSE unit END) END AS meta,
   cast(round_even(n - off_ppp_pctl * (n - 1) / 100e0, 0) AS int) AS rank, cast(100 - def_ppp_pctl AS int) AS def_display_percentile
   FROM prof p LEFT JOIN lab l ON l.source = p.source AND l.dimension = p.dimension AND l.category = p.category, (SELECT league AS zl, season AS zs, count(DISTINCT team) AS n FROM prof GROUP BY 1, 2) z WHERE zl = p.league AND zs = p.season"""
_ORD = lambda x: (
    f"concat({x}, CASE WHEN {x} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {x} % 10 = 1 THEN 'st' WHEN {x} % 10 = 2 THEN 'nd' WHEN {x} % 10 = 3 THEN 'rd' ELSE 'th' END)"
)


def _STANDS(place: str, pctl: str, defense: bool, most: int = 50) -> str:
    """A rank in small populations, a percentile in large ones."""
    ranked = f"concat({_ORD(place)}, ' of ', n, '{' defensively' if defense else ''} in the league')"
    return f"CASE WHEN {pctl} IS NULL THEN 'unranked' WHEN n <= {most} THEN {ranked} ELSE concat({_ORD(f'({pctl})')}, ' percentile {'defensively' if defense else 'offensively'}') END"


@query(
    "display_rows", ("pbp",),
    PROFILE + LABELS + f""", s AS ({_SHOWN}), n AS (SELECT league, season, cast(count(DISTINCT team) AS int) AS n FROM prof GROUP BY 1, 2)
      SELECT s.*, CASE WHEN rank IS NULL THEN 'unranked' WHEN category IN ('live_ball_to', 'dead_ball_to') THEN
          concat(CASE WHEN least(rank, n + 1 - rank) > 1 THEN concat({_ORD('least(rank, n + 1 - rank)')}, ' ') ELSE '' END,
                 CASE WHEN rank <= n / 2e0 THEN 'lowest' ELSE 'highest' END, ' of the national')
          ELSE concat({_ORD('rank')}, ' of ', n) END AS standing FROM s JOIN n USING (league, season)""",
)
def display_rows(t):
    p = _stored_profile(t)
    n = SC.population_size(p)
    rows = SC.profile_rows(p).join(n, SC.SCOPE)
    out = SC.display_rows(rows, F.col("pop_n"), F.lit("national"), SC.default_labels(t.spark), SC.default_headers(t.spark))
    return out.select("league", "season", "team", "dimension", "category", "label", "bulletable", "meta", "rank", "def_display_percentile", "standing")


@query(
    "leaders", ("pbp",),
    PROFILE + """ SELECT 'best' AS list, league, season, team, off_ppp_pctl AS ppp_percentile, row_number() OVER (PARTITION BY league, season ORDER BY off_ppp_pctl DESC NULLS LAST, team) AS place
        FROM prof WHERE dimension = 'context' AND category = 'halfcourt' QUALIFY place <= 5
      UNION ALL SELECT 'worst', league, season, team, off_ppp_pctl, row_number() OVER (PARTITION BY league, season ORDER BY off_ppp_pctl NULLS LAST, team) AS place
        FROM prof WHERE dimension = 'ball_security' AND category = 'live_ball_to' QUALIFY place <= 5""",
)
def leaders(t):
    p = _stored_profile(t)
    pick = lambda name, df: df.select(F.lit(name).alias("list"), "league", "season", "team", "ppp_percentile", "place")
    return pick("best", SC.leaders(p, "context", "halfcourt")).unionByName(
        pick("worst", SC.leaders(p, "ball_security", "live_ball_to", best=False))
    )


@query("keys_selected", ("pbp",), KEYS + " SELECT league, season, team, opponent, side, dimension, category, round(freq_rel, 8) AS freq_rel, round(key_score, 6) AS key_score, key_no FROM ks")
def keys_selected(t):
    return _keys(t).select(
        "league", "season", "team", "opponent", "side", "dimension", "category", F.round("freq_rel", 8).alias("freq_rel"),
        F.round("key_score", 6).alias("key_score"), "key_no",
    )


@query(
    "priority_keys", ("pbp",),
    KEYS + """ SELECT league, season, team, opponent, side, dimension, category, row_number() OVER (PARTITION BY league, season, team, opponent ORDER BY key_score DESC, side, key_no) AS priority
      FROM ks WHERE side <> 'attack' QUALIFY priority <= 3""",
)
def priority_keys(t):
    k = SC.build_keys(_stored_profile(t), _matchups(t), SC.default_labels(t.spark), min_poss=MIN_POSS)
    return SC.priority_keys(k).select("league", "season", "team", "opponent", "side", "dimension", "category", "priority")


@query(
    "key_sentences", ("pbp",),
    KEYS + """, n AS (SELECT league, season, count(DISTINCT team) AS n FROM prof GROUP BY 1, 2)
      , kn AS (SELECT ks.*, lab.display_label, n.n, cast(round_even(n.n - ppp_percentile * (n.n - 1) / 100e0, 0) AS int) AS place,
          cast(round_even(n.n - (100 - def_ppp_percentile) * (n.n - 1) / 100e0, 0) AS int) AS def_place,
          concat(display_label, ', ', cast(round_even(freq * 100, 0) AS int), '% ', CASE unit WHEN 'possession' THEN 'of possessions' ELSE 'of attempts' END) AS volume
        FROM ks JOIN lab ON lab.dimension = ks.dimension AND lab.category = ks.category JOIN n ON n.league = ks.league AND n.season = ks.season)
      SELECT league, season, team, opponent, side, key_no, category, CASE
          WHEN side = 'attack' THEN concat('Us: ', volume, ' at ', printf('%.2f', round_even(ppp, 2)), ' points per ', unit, '; ', opponent, ' gives up ', printf('%.2f', round_even(def_ppp, 2)), ' there, ',
            """ + _STANDS("def_place", "100 - cast(def_ppp_percentile AS int)", True) + """)
          WHEN dimension = 'ball_security' THEN concat(team, ': ', volume, ', ', CASE WHEN ppp_percentile IS NULL THEN 'unranked' ELSE
            concat(CASE WHEN least(place, n + 1 - place) > 1 THEN concat(""" + _ORD("least(place, n + 1 - place)") + """, ' ') ELSE '' END, CASE WHEN place <= n / 2e0 THEN 'lowest' ELSE 'highest' END, ' of the league') END)
          ELSE concat(team, ': ', volume, ' at ', CASE WHEN side = 'weakness' THEN 'just ' ELSE '' END, printf('%.2f', round_even(ppp, 2)), ' points per ', unit, ', ',
            """ + _STANDS("place", "cast(ppp_percentile AS int)", False) + """) END AS evidence,
        concat(CASE WHEN side = 'attack' THEN 'Go at the ' ELSE 'Guard the ' END, category) AS action
      FROM kn""",
)
def key_sentences(t):
    p = _stored_profile(t)
    labels, headers = SC.default_labels(t.spark), SC.default_headers(t.spark)
    k = SC.build_keys(p, _matchups(t), labels, SIDES, MIN_POSS)
    phrases = labels.select(F.explode(F.array(*map(F.lit, SIDES))).alias("side"), "source", "dimension", "category").select(
        "side", "source", "dimension", "category",
        F.concat(F.when(F.col("side") == "attack", "go at the ").otherwise("guard the "), "category").alias("phrase"),
    )
    k = k.join(SC.population_size(p), SC.SCOPE)
    s = SC.key_sentences(k, phrases, labels, headers, F.col("pop_n"), F.lit("league"))
    action, evidence = split_at_dash("sentence")
    return s.select("league", "season", "team", "opponent", "side", "key_no", "category", evidence.alias("evidence"), action.alias("action"))


@query(
    "shot_identity", ("pbp",),
    PROFILE + LABELS + """, z AS (SELECT p.*, l.display_label, row_number() OVER (PARTITION BY p.league, p.season, team ORDER BY off_freq DESC, p.category) AS rn FROM prof p
        JOIN lab l ON l.dimension = p.dimension AND l.category = p.category WHERE p.dimension = 'shot_zone' AND off_freq IS NOT NULL)
      SELECT league, season, team, string_agg(concat(display_label, ' ', cast(round_even(off_freq * 100, 0) AS int), '%'), '; ' ORDER BY rn) FILTER (WHERE rn <= 3) AS tags,
        round(sum(CASE WHEN category IN ('corner_3', 'above_break_3') THEN off_freq ELSE 0 END), 8) AS three_share FROM z GROUP BY 1, 2, 3""",
)
def shot_identity(t):
    out = SC.shot_identity(SC.profile_rows(_stored_profile(t)), SC.default_labels(t.spark))
    return out.select("league", "season", "team", "tags", F.round("three_share", 8).alias("three_share"))


@query(
    "rows_as_json", ("pbp",),
    PROFILE + """ SELECT league, season, team, count(*) AS n_rows, concat('[', string_agg(concat('{"dimension":"', dimension, '","category":"', category, '","off_n":',
        coalesce(off_n::varchar, 'null'), ',"off_ppp_pctl":', coalesce(off_ppp_pctl::varchar, 'null'), '}'), ',' ORDER BY dimension, category), ']') AS payload
      FROM prof GROUP BY 1, 2, 3""",
)
def profile_json(t):
    p = _stored_profile(t).select("league", "season", "team", "dimension", "category", "off_n", "off_ppp_pctl")
    return rows_as_json(p, ["league", "season", "team"], ["dimension", "category"])


@query(
    "team_profile", ("pbp",),
    PROFILE + LABELS + f" SELECT * FROM ({_SHOWN}) q WHERE team = 'T03' AND bulletable",
)
def team_profile(t):
    """One team's lines, those fit for bullets."""
    p = _stored_profile(t)
    out = SC.team_profile(p, "T03", SC.population_size(p), F.lit("national"), SC.default_labels(t.spark), SC.default_headers(t.spark), bulletable_only=True)
    return out.select("league", "season", "team", "dimension", "category", "label", "bulletable", "meta", "rank", "def_display_percentile")


@query(
    "attack_card", ("pbp",),
    PROFILE + """ SELECT u.league, u.season, u.team, t.team AS opponent, u.dimension, u.category, u.unit, u.source, u.off_n AS poss, u.off_freq AS freq, u.off_ppp AS ppp, u.off_ppp_pctl AS ppp_percentile,
        t.def_ppp, t.def_ppp_pctl AS def_ppp_percentile FROM prof u JOIN prof t ON t.league = u.league AND t.season = u.season AND t.dimension = u.dimension AND t.category = u.category
      WHERE u.team = 'T03' AND t.team = 'T07' AND u.dimension IN ('shot_zone', 'context')""",
)
def attack_card(t):
    """One team's offence against another's defence, whether they meet or not."""
    return SC.attack_index_card(_stored_profile(t), "T03", "T07", ["shot_zone", "context"])


@query(
    "dimension_list", ("pbp",),
    PROFILE + LABELS + """, hd AS (SELECT * FROM (VALUES ('context', true), ('shot_zone', true), ('ball_security', false), ('creation', true)) v(dimension, ppp_meaningful)),
      sz AS (SELECT dimension, category, count(DISTINCT team) AS teams FROM prof WHERE off_n IS NOT NULL GROUP BY 1, 2)
      SELECT lab.dimension, lab.category, display_label, bulletable, ppp_meaningful, coalesce(teams, 0) AS teams
      FROM lab JOIN hd ON hd.dimension = lab.dimension LEFT JOIN sz ON sz.dimension = lab.dimension AND sz.category = lab.category""",
)
def dimension_list(t):
    """What can be asked for, and how many teams have it."""
    held = _stored_profile(t).where("off_n IS NOT NULL").groupBy("dimension", "category").agg(F.countDistinct("team").alias("teams"))
    listed = SC.dimensions(SC.default_labels(t.spark), SC.default_headers(t.spark)).join(held, ["dimension", "category"], "left")
    return listed.select("dimension", "category", "display_label", "bulletable", "ppp_meaningful", F.coalesce("teams", F.lit(0)).alias("teams"))


@query(
    "standing_modes", ("pbp", "schedule"),
    PROFILE + """, n AS (SELECT count(*) AS n FROM (SELECT home_id AS t FROM schedule UNION SELECT away_id FROM schedule) q),
      s AS (SELECT *, cast(round_even(n - off_ppp_pctl * (n - 1) / 100e0, 0) AS int) AS place, cast(round_even(n - (100 - def_ppp_pctl) * (n - 1) / 100e0, 0) AS int) AS def_place FROM prof, n)
      SELECT league, season, team, dimension, category, """ + _STANDS("place", "cast(off_ppp_pctl AS int)", False) + " AS auto, " + _STANDS("place", "cast(off_ppp_pctl AS int)", False, 10**9)
    + " AS as_rank, " + _STANDS("def_place", "100 - cast(def_ppp_pctl AS int)", True, 0) + " AS defended FROM s",
)
def standing_modes(t):
    """Standings in a population as large as the schedule's, which shows percentiles; as ranks; and of the defence as percentiles."""
    p = SC.profile_rows(_stored_profile(t))
    n = t.schedule.select(F.explode(F.array("home_id", "away_id")).alias("x")).agg(F.countDistinct("x").cast("int").alias("n"))
    stand = lambda c, mode, **kw: X.standing(c, F.col("n"), F.lit("league"), mode, **kw)
    return p.join(F.broadcast(n)).select(
        "league", "season", "team", "dimension", "category", stand("ppp_percentile", "auto").alias("auto"), stand("ppp_percentile", "rank").alias("as_rank"),
        stand(X.flip_percentile("def_ppp_percentile"), "percentile", defense=True).alias("defended"),
    )
