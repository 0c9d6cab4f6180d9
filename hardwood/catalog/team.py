"""Team box queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.catalog.registry import query
from hardwood.functions.metrics import quadrant
from hardwood.operators.aggregates import aggregate_games, axis_half_width, reconcile
from hardwood.operators.filters import (
    drop_nonstandard, keep_members, season_type_filter, valid_team_games,
)
from hardwood.operators.pairing import malformed_games, pair_opponents, pair_two_sided, two_sides_of
from hardwood.plans import teams

RATINGS = [
    "games", "poss", "ortg", "drtg", "net_rtg", "efg", "tov_pct", "orb_pct", "ft_rate", "ts_pct",
    "opp_efg", "opp_tov_pct", "opp_orb_pct", "opp_ft_rate", "opp_ts_pct",
]
COUNTS = ["pts", "fga", "fgm", "fg3m", "fta", "oreb", "dreb", "tov"]
PATTERNS = ["Exhibition", "Cup Final"]


def pairs_sql(src: str, keep: str = "") -> str:
    opp = ", ".join(f"b.{c} AS opp_{c}" for c in COUNTS)
    return (
        f"SELECT a.*, b.team_id AS opp_team_id, {opp} FROM {src} a JOIN {src} b "
        f"ON a.game_id = b.game_id AND a.team_id <> b.team_id {keep}"
    )


def totals_sql(src: str, by: str, extra: str = "") -> str:
    sums = ", ".join(f"sum({c}) AS {c}, sum(opp_{c}) AS opp_{c}" for c in COUNTS)
    head = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"SELECT {head}count(*) AS games{extra}, {sums} FROM {src} {tail}"


def ratings_sql(src: str, by: str, simple: bool = False, pace: bool = False) -> str:
    def own(me: str, them: str) -> str:
        if simple:
            return f"{me}fga + 0.44e0 * {me}fta + {me}tov - {me}oreb"
        return (
            f"{me}fga + 0.44e0 * {me}fta + {me}tov - 1.07e0 * CASE WHEN {me}oreb + {them}dreb > 0 "
            f"THEN {me}oreb / ({me}oreb + {them}dreb) ELSE 0 END * ({me}fga - {me}fgm)"
        )

    def side(me: str, them: str) -> str:
        return f"""
        CASE WHEN {me}fga > 0 THEN ({me}fgm + 0.5e0 * {me}fg3m) / {me}fga END AS {me}efg,
        CASE WHEN poss > 0 THEN {me}tov / poss END AS {me}tov_pct,
        CASE WHEN {me}oreb + {them}dreb > 0 THEN {me}oreb / ({me}oreb + {them}dreb) END AS {me}orb_pct,
        CASE WHEN {me}fga > 0 THEN {me}fta / {me}fga END AS {me}ft_rate,
        CASE WHEN {me}fga + 0.44e0 * {me}fta > 0
             THEN {me}pts / (2e0 * ({me}fga + 0.44e0 * {me}fta)) END AS {me}ts_pct"""

    head = f"{by}, " if by else ""
    extra = ", CASE WHEN game_minutes > 0 THEN 48e0 * (poss + poss) / (2e0 * game_minutes) END AS pace" if pace else ""
    return f"""
    SELECT {head}games, poss, 100e0 * pts / poss AS ortg, 100e0 * opp_pts / poss AS drtg,
           100e0 * pts / poss - 100e0 * opp_pts / poss AS net_rtg, {side('', 'opp_')}, {side('opp_', '')}{extra}
    FROM (SELECT *, (({own('', 'opp_')}) + ({own('opp_', '')})) / 2 AS poss FROM {src}) m"""


def _ratings(src: str, by: str, **kw) -> str:
    return f", tot AS ({totals_sql(src, by)}) {ratings_sql('tot', by, **kw)}"


@query(
    "team_efficiency", ("team_box",),
    f", prs AS ({pairs_sql('team_box')}) {_ratings('prs', 'team_id')} ORDER BY net_rtg DESC",
)
def team_efficiency(t):
    out = teams.team_efficiency(pair_two_sided(t.team_box), "team_id")
    return out.select("team_id", *RATINGS).orderBy(F.desc("net_rtg"), "team_id")


@query(
    "team_efficiency_simple", ("team_box",),
    f", prs AS ({pairs_sql('team_box')}) {_ratings('prs', 'team_id', simple=True)}",
)
def team_efficiency_simple(t):
    return teams.team_efficiency(pair_two_sided(t.team_box), "team_id", estimator="simple").select("team_id", *RATINGS)


@query(
    "team_efficiency_home_away", ("team_box",),
    f", prs AS ({pairs_sql('team_box')}) {_ratings('prs', 'season, team_id, team_home_away')}",
)
def team_efficiency_home_away(t):
    by = ["season", "team_id", "team_home_away"]
    paired = pair_two_sided(t.team_box, carry=["season", "team_home_away"])
    return aggregate_games(paired, *by).select(*by, *RATINGS)


@query("league_totals", ("team_box",), f", prs AS ({pairs_sql('team_box')}) {_ratings('prs', '')}")
def league_totals(t):
    return aggregate_games(pair_two_sided(t.team_box)).select(*RATINGS)


def _ranked(direction: str, n: int) -> str:
    return (
        f", prs AS ({pairs_sql('team_box')}), lim AS (SELECT * FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY season, team_id ORDER BY game_date {direction}, game_id) AS rn FROM prs) q WHERE rn <= {n}) "
        + _ratings("lim", "season, team_id")
    )


@query("team_efficiency_last20", ("team_box",), _ranked("DESC", 20))
def team_efficiency_last20(t):
    paired = pair_two_sided(t.team_box, carry=["season", "game_date"])
    return teams.recent_efficiency(paired, 20).select("season", "team_id", *RATINGS)


@query(
    "team_efficiency_first_n", ("team_box",),
    """, lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, team_id ORDER BY game_date, game_id) AS rn
                 FROM team_box) q WHERE rn <= 15),
       prs AS (SELECT a.*, """ + ", ".join(f"b.{c} AS opp_{c}" for c in COUNTS) + """
               FROM lim a JOIN team_box b ON a.game_id = b.game_id AND a.team_id <> b.team_id) """
    + _ratings("prs", "season, team_id"),
)
def team_efficiency_first_n(t):
    """First games of a team against complete opponents."""
    from hardwood.operators.aggregates import last_n

    first = last_n(t.team_box, ["season", "team_id"], 15, [F.col("game_date"), F.col("game_id")])
    paired = pair_opponents(first, against=t.team_box)
    return aggregate_games(paired, "season", "team_id").select("season", "team_id", *RATINGS)


@query(
    "college_efficiency", ("team_box", "team_region"),
    ", ok AS (SELECT * FROM team_box WHERE season_type = 2 AND pts IS NOT NULL AND fga > 0), "
    f"prs AS ({pairs_sql('ok')}), kept AS (SELECT * FROM prs WHERE team_id IN (SELECT team_id FROM team_region WHERE region_name IN ('AMERICA', 'EUROPE'))) "
    + _ratings("kept", "season, team_id"),
)
def college_efficiency(t):
    """Valid regular games; opponents stay complete because the team list applies after pairing."""
    paired = pair_two_sided(valid_team_games(t.team_box), carry=["season"])
    listed = t.team_region.where(F.col("region_name").isin("AMERICA", "EUROPE"))
    kept = keep_members(paired, listed, "team_id")
    return aggregate_games(kept, "season", "team_id").select("season", "team_id", *RATINGS)


@query(
    "pair_malformed", ("team_box",),
    """, sides AS (SELECT cast(l_orderkey AS string) AS game_id, cast(l_suppkey AS string) AS team_id, sum(l_quantity) AS pts
                   FROM lineitem GROUP BY 1, 2)
       SELECT a.game_id, a.team_id, a.pts, b.team_id AS opp_team_id, b.pts AS opp_pts
       FROM sides a JOIN sides b ON a.game_id = b.game_id AND a.team_id <> b.team_id""",
)
def pair_malformed(t):
    """Games of one to seven sides: every ordered pair of teams, none for a side that is alone."""
    return pair_opponents(_supplier_sides(t), counts=["pts"]).select("game_id", "team_id", "pts", "opp_team_id", "opp_pts")


def _supplier_sides(t):
    """Each supplier of an order as a side of its own, with all its lines."""
    return t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("game_id"), F.col("l_suppkey").cast("string").alias("team_id")).agg(
        F.sum("l_quantity").alias("pts")
    )


@query(
    "pair_strict", ("team_box",),
    """, sides AS (SELECT cast(l_orderkey AS string) AS game_id, cast(l_suppkey AS string) AS team_id, sum(l_quantity) AS pts
                   FROM lineitem GROUP BY 1, 2),
       two AS (SELECT game_id FROM sides GROUP BY game_id HAVING count(*) = 2)
       SELECT a.game_id, a.team_id, a.pts, b.team_id AS opp_team_id, b.pts AS opp_pts, true AS well_formed
       FROM sides a JOIN sides b ON a.game_id = b.game_id AND a.team_id <> b.team_id WHERE a.game_id IN (SELECT game_id FROM two)
       UNION ALL
       SELECT game_id, NULL, NULL, NULL, count(*), false FROM sides GROUP BY game_id HAVING count(*) <> 2""",
)
def pair_strict(t):
    """Only games of two sides are paired, and the others are reported with their number of sides."""
    sides = _supplier_sides(t)
    paired = pair_two_sided(sides, counts=["pts"]).withColumn("well_formed", F.lit(True))
    left_out = malformed_games(sides).select("game_id", F.col("n_rows").cast("double").alias("opp_pts"), F.lit(False).alias("well_formed"))
    return paired.unionByName(left_out, allowMissingColumns=True)


@query(
    "malformed_games", ("team_box",),
    " SELECT game_id, count(*) AS n_rows FROM team_box GROUP BY game_id HAVING count(*) <> 2",
)
def malformed(t):
    return malformed_games(t.team_box)


@query(
    "season_type_filter", ("team_box",),
    " SELECT season, season_type, count(*) AS n, sum(pts) AS pts FROM team_box WHERE season_type = 3 GROUP BY season, season_type",
)
def season_types(t):
    return season_type_filter(t.team_box, "postseason").groupBy("season", "season_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pts").alias("pts")
    )


@query(
    "drop_nonstandard", ("schedule",),
    """ SELECT season, count(*) AS n, count(DISTINCT game_id) AS games, sum(pts) AS pts FROM team_box b
        WHERE cast(team_id AS bigint) < 350 AND NOT EXISTS (
          SELECT 1 FROM schedule s WHERE s.game_id = b.game_id
          AND (s.notes_headline LIKE 'Exhibition%' OR s.notes_headline LIKE 'Cup Final%')) GROUP BY season""",
)
def nonstandard(t):
    return drop_nonstandard(t.team_box, t.schedule, PATTERNS, max_team_id=350).groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("game_id").alias("games"), F.sum("pts").alias("pts")
    )


@query(
    "pace_overtime", ("schedule",),
    f""", prs AS ({pairs_sql('(SELECT * FROM team_box WHERE season_type = 2)')}),
        len AS (SELECT game_id, min(CASE WHEN status_period >= 4 THEN 48e0 + 5e0 * (status_period - 4) END) AS game_minutes
                FROM schedule GROUP BY game_id),
        j AS (SELECT prs.*, game_minutes FROM prs LEFT JOIN len ON prs.game_id = len.game_id),
        tot AS ({totals_sql('j', 'season, team_id', ', count(game_minutes) / cast(count(*) AS double) AS minutes_coverage, sum(game_minutes) AS game_minutes')}),
        r AS ({ratings_sql('tot', 'season, team_id, minutes_coverage, game_minutes', pace=True)})
        SELECT season, team_id, games, minutes_coverage, game_minutes, poss, net_rtg, pace FROM r""",
)
def pace_overtime(t):
    games = teams.team_games(t.team_box, t.schedule)
    return aggregate_games(games, "season", "team_id").select(
        "season", "team_id", "games", "minutes_coverage", "game_minutes", "poss", "net_rtg", "pace"
    )


@query(
    "team_games_standard", ("schedule",),
    f""", std AS (SELECT * FROM team_box b WHERE season_type = 2 AND cast(team_id AS bigint) < 100000 AND NOT EXISTS (
          SELECT 1 FROM schedule s WHERE s.game_id = b.game_id
          AND (s.notes_headline LIKE 'Exhibition%' OR s.notes_headline LIKE 'Cup Final%'))),
        prs AS ({pairs_sql('std')}),
        one AS (SELECT *, 1 AS games FROM prs),
        r AS ({ratings_sql('one', 'game_id, team_id, season, opp_team_id')})
        SELECT game_id, team_id, season, opp_team_id, poss, ortg, drtg, net_rtg, efg, orb_pct FROM r""",
)
def team_games_standard(t):
    g = teams.team_games(t.team_box, t.schedule, standard_only=True, patterns=PATTERNS)
    return g.select("game_id", "team_id", "season", "opp_team_id", "poss", "ortg", "drtg", "net_rtg", "efg", "orb_pct")


@query(
    "chart_frame", ("team_box",),
    f""", prs AS ({pairs_sql('team_box')}), tot AS ({totals_sql('prs', 'season, team_id')}),
        r AS ({ratings_sql('tot', 'season, team_id')}),
        a AS (SELECT season, avg(ortg) AS avg_ortg, avg(drtg) AS avg_drtg, min(games) AS min_games, max(games) AS max_games
              FROM r GROUP BY season)
        SELECT r.season, count(*) AS teams, round(min(avg_ortg), 6) AS avg_ortg, round(min(avg_drtg), 6) AS avg_drtg,
               min(min_games) AS min_games, max(max_games) AS max_games,
               ceil(greatest(max(abs(ortg - avg_ortg)), max(abs(drtg - avg_drtg))) * 1.15e0 * 2) / 2 AS half_width,
               (SELECT max(game_date) FROM team_box) AS data_through,
               count(*) FILTER (ortg >= avg_ortg AND drtg <= avg_drtg) AS strong_teams, count(*) FILTER (ortg >= avg_ortg AND drtg > avg_drtg) AS attacking_teams,
               count(*) FILTER (ortg < avg_ortg AND drtg <= avg_drtg) AS defending_teams, count(*) FILTER (ortg < avg_ortg AND drtg > avg_drtg) AS weak_teams
        FROM r JOIN a ON r.season = a.season GROUP BY r.season""",
)
def chart_frame(t):
    """Averages, games range, window size and quadrant counts behind the efficiency chart."""
    r = aggregate_games(pair_two_sided(t.team_box, carry=["season"]), "season", "team_id")
    avg = r.groupBy("season").agg(
        F.avg("ortg").alias("avg_ortg"), F.avg("drtg").alias("avg_drtg"),
        F.min("games").alias("min_games"), F.max("games").alias("max_games"),
    )
    through = t.team_box.agg(F.max("game_date").alias("data_through"))
    label = quadrant("ortg", "drtg", "avg_ortg", "avg_drtg")
    named = {"strong": "good offense, good defense", "attacking": "good offense, bad defense", "defending": "bad offense, good defense", "weak": "bad offense, bad defense"}
    return r.join(avg, "season").groupBy("season").agg(
        F.count(F.lit(1)).alias("teams"),
        F.round(F.min("avg_ortg"), 6).alias("avg_ortg"), F.round(F.min("avg_drtg"), 6).alias("avg_drtg"),
        F.min("min_games").alias("min_games"), F.max("max_games").alias("max_games"),
        axis_half_width([F.max(F.abs(F.col("ortg") - F.col("avg_ortg"))), F.max(F.abs(F.col("drtg") - F.col("avg_drtg")))]).alias("half_width"),
        *[F.count(F.when(label == text, 1)).alias(f"{name}_teams") for name, text in named.items()],
    ).join(F.broadcast(through))


@query(
    "reconcile_two_paths", ("team_box", "schedule"),
    f""", prs AS ({pairs_sql('team_box')}), pr2 AS (SELECT p.*, b.season FROM prs p JOIN (SELECT DISTINCT game_id, season FROM team_box) b ON b.game_id = p.game_id),
        a AS (SELECT season, team_id, sum(pts) AS pts, sum(opp_pts) AS opp_pts, count(*) AS games FROM pr2 GROUP BY 1, 2),
        b AS (SELECT season, team_id, sum(pts) AS pts, sum(opp) AS opp_pts, count(*) AS games FROM (SELECT season, home_id AS team_id, home_score AS pts, away_score AS opp FROM schedule WHERE status_type_completed
              UNION ALL SELECT season, away_id, away_score, home_score FROM schedule WHERE status_type_completed) q GROUP BY 1, 2)
        SELECT coalesce(a.season, b.season) AS season, coalesce(a.team_id, b.team_id) AS team_id, a.pts, a.opp_pts, a.games, b.pts AS pts_other, b.opp_pts AS opp_pts_other, b.games AS games_other,
          greatest(coalesce(abs(a.pts - b.pts), 0), coalesce(abs(a.opp_pts - b.opp_pts), 0), coalesce(abs(a.games - b.games), 0)) AS gap,
          CASE WHEN b.team_id IS NULL THEN 'first only' WHEN a.team_id IS NULL THEN 'second only' WHEN a.pts = b.pts AND a.opp_pts = b.opp_pts AND a.games = b.games THEN 'agrees'
               ELSE concat('differs: ', concat_ws(', ', CASE WHEN a.pts <> b.pts THEN 'pts' END, CASE WHEN a.opp_pts <> b.opp_pts THEN 'opp_pts' END, CASE WHEN a.games <> b.games THEN 'games' END)) END AS reason
        FROM a FULL JOIN b ON a.season = b.season AND a.team_id = b.team_id""",
)
def reconcile_two_paths(t):
    """Season totals of each team from the paired box scores against those of the completed games of the schedule."""
    p = pair_two_sided(t.team_box, carry=["season"]).groupBy("season", "team_id").agg(
        F.sum("pts").alias("pts"), F.sum("opp_pts").alias("opp_pts"), F.count(F.lit(1)).alias("games")
    )
    sides = two_sides_of(t.schedule.where("status_type_completed"), ["season"], ["id", "score"])
    s = sides.groupBy("season", F.col("id").alias("team_id")).agg(
        F.sum("score").alias("pts"), F.sum("opp_score").alias("opp_pts"), F.count(F.lit(1)).alias("games")
    )
    return reconcile(p, s, ["season", "team_id"], ["pts", "opp_pts", "games"])


_TEAM_GAME = """, tg AS (SELECT season, game_id, team_id, sum(minutes) AS minutes, sum(fgm) AS fgm, sum(fga) AS fga, sum(fg3m) AS fg3m,
    sum(fg3a) AS fg3a, sum(ftm) AS ftm, sum(fta) AS fta, sum(oreb) AS oreb, sum(dreb) AS dreb, sum(reb) AS reb, sum(tov) AS tov, sum(pts) AS pts
  FROM player_box WHERE minutes > 0 AND NOT coalesce(did_not_play, false) GROUP BY season, game_id, team_id),
 tp AS (SELECT a.*, b.fgm AS opp_fgm, b.fga AS opp_fga, b.fg3m AS opp_fg3m, b.fta AS opp_fta, b.oreb AS opp_oreb, b.dreb AS opp_dreb,
               b.tov AS opp_tov, b.pts AS opp_pts, b.team_id AS opp_team_id
        FROM tg a JOIN tg b ON a.season = b.season AND a.game_id = b.game_id AND a.team_id <> b.team_id),
 ts AS (SELECT season, team_id, sum(minutes) AS t_minutes, sum(fgm) AS t_fgm, sum(fga) AS t_fga, sum(fg3m) AS t_fg3m, sum(fta) AS t_fta,
               sum(oreb) AS t_oreb, sum(dreb) AS t_dreb, sum(tov) AS t_tov, sum(opp_fgm) AS o_fgm, sum(opp_fga) AS o_fga,
               sum(opp_fg3m) AS o_fg3m, sum(opp_fta) AS o_fta, sum(opp_oreb) AS o_oreb, sum(opp_dreb) AS o_dreb, sum(opp_tov) AS o_tov
        FROM tp GROUP BY season, team_id)"""


@query(
    "team_totals_from_players", ("player_box",),
    _TEAM_GAME + " SELECT season, team_id, t_minutes, t_fga, t_oreb, t_tov, o_oreb, o_dreb FROM ts",
)
def team_totals_from_players(t):
    _, _, s = teams.team_totals(t.player_box)
    return s.select(
        "season", "team_id", F.col("team_minutes_total").alias("t_minutes"), F.col("team_fga_total").alias("t_fga"),
        F.col("team_oreb_total").alias("t_oreb"), F.col("team_tov_total").alias("t_tov"),
        F.col("opp_oreb_total").alias("o_oreb"), F.col("opp_dreb_total").alias("o_dreb"),
    )


_STRIP = _TEAM_GAME + """, f AS (SELECT season, team_id, cast(team_id AS bigint) % 4 AS conf,
    (t_fgm + 0.5e0 * t_fg3m) / nullif(t_fga, 0) AS efg, t_tov / nullif(t_fga + 0.44e0 * t_fta + t_tov, 0) AS tov_pct,
    t_oreb / nullif(t_oreb + o_dreb, 0) AS oreb_pct, t_fta / nullif(t_fga, 0) AS ft_rate,
    (o_fgm + 0.5e0 * o_fg3m) / nullif(o_fga, 0) AS opp_efg, o_tov / nullif(o_fga + 0.44e0 * o_fta + o_tov, 0) AS opp_tov_pct,
    t_dreb / nullif(t_dreb + o_oreb, 0) AS dreb_pct, o_fta / nullif(o_fga, 0) AS opp_ft_rate FROM ts),
 l AS (UNPIVOT f ON efg, tov_pct, oreb_pct, ft_rate, opp_efg, opp_tov_pct, dreb_pct, opp_ft_rate INTO NAME metric VALUE value),
 h AS (SELECT *, metric IN ('efg', 'oreb_pct', 'ft_rate', 'opp_tov_pct', 'dreb_pct') AS higher_better FROM l)
 SELECT season, conf, team_id, metric, value, higher_better,
   round((sum(value) OVER g - value) / (count(value) OVER g - 1), 8) AS conf_others_avg,
   row_number() OVER (PARTITION BY season, conf, metric ORDER BY CASE WHEN higher_better THEN value ELSE -value END DESC, team_id) AS metric_rank
 FROM h WINDOW g AS (PARTITION BY season, conf, metric)"""


@query("four_factor_strip", ("player_box",), _STRIP)
def four_factor_strip(t):
    _, _, s = teams.team_totals(t.player_box)
    conf = s.select("team_id").distinct().withColumn("conf", F.col("team_id").cast("bigint") % 4)
    out = teams.four_factor_strip(s, conf)
    return out.select(
        "season", "conf", "team_id", "metric", "value", "higher_better",
        F.round("conf_others_avg", 8).alias("conf_others_avg"), "metric_rank",
    )


_FACTOR_ROWS = _TEAM_GAME + f""", one AS (SELECT *, 1 AS games FROM tp),
 r AS ({ratings_sql('one', 'season, game_id, team_id', simple=True)}),
 v AS (SELECT efg, tov_pct, orb_pct, ft_rate, net_rtg FROM r
       WHERE efg IS NOT NULL AND tov_pct IS NOT NULL AND orb_pct IS NOT NULL AND ft_rate IS NOT NULL AND net_rtg IS NOT NULL)"""
_NAMES = ["efg", "tov_pct", "orb_pct", "ft_rate", "net_rtg"]


@query(
    "four_factor_moments", ("player_box",),
    _FACTOR_ROWS + " SELECT count(*) AS n, " + ", ".join(f"round(sum({a}), 4) AS s_{a}" for a in _NAMES) + ", "
    + ", ".join(f"round(sum({a} * {b}), 4) AS x_{a}_{b}" for i, a in enumerate(_NAMES) for b in _NAMES[i:]) + " FROM v",
)
def four_factor_moments(t):
    m = teams.four_factor_moments(teams.four_factor_rows(t.player_box))
    return m.select("n", *[F.round(c, 4).alias(c) for c in m.columns if c != "n"])


_OLS = """, c0 AS (SELECT efg - avg(efg) OVER () AS a, tov_pct - avg(tov_pct) OVER () AS b, orb_pct - avg(orb_pct) OVER () AS c, ft_rate - avg(ft_rate) OVER () AS d,
     net_rtg - avg(net_rtg) OVER () AS y FROM v),
  r1 AS (SELECT sum(a * b) / sum(a * a) AS ab, sum(a * c) / sum(a * a) AS ac, sum(a * d) / sum(a * a) AS ad FROM c0),
  c1 AS (SELECT a, b - ab * a AS b, c - ac * a AS c, d - ad * a AS d, y FROM c0, r1),
  r2 AS (SELECT sum(b * c) / sum(b * b) AS bc, sum(b * d) / sum(b * b) AS bd FROM c1),
  c2 AS (SELECT a, b, c - bc * b AS c, d - bd * b AS d, y FROM c1, r2),
  r3 AS (SELECT sum(c * d) / sum(c * c) AS cd FROM c2),
  c3 AS (SELECT a, b, c, d - cd * c AS d, y FROM c2, r3),
  g AS (SELECT sum(a * y) / sum(a * a) AS ga, sum(b * y) / sum(b * b) AS gb, sum(c * y) / sum(c * c) AS gc, sum(d * y) / sum(d * d) AS gd, count(*) AS n, sum(y * y) AS yy,
     pow(sum(a * y), 2) / sum(a * a) + pow(sum(b * y), 2) / sum(b * b) + pow(sum(c * y), 2) / sum(c * c) + pow(sum(d * y), 2) / sum(d * d) AS told FROM c3),
  w3 AS (SELECT *, gd AS wd, gc - cd * gd AS wc FROM g, r3), w2 AS (SELECT *, gb - bc * wc - bd * wd AS wb FROM w3, r2),
  w1 AS (SELECT *, ga - ab * wb - ac * wc - ad * wd AS wa FROM w2, r1),
  mn AS (SELECT avg(efg) AS ma, avg(tov_pct) AS mb, avg(orb_pct) AS mc, avg(ft_rate) AS md, avg(net_rtg) AS my FROM v),
  o AS (SELECT *, my - wa * ma - wb * mb - wc * mc - wd * md AS w0 FROM w1, mn)
  SELECT term, round(weight, 5) AS weight, round(told / yy, 8) AS r2, round(sqrt((yy - told) / n), 6) AS rmse FROM (
    SELECT 'intercept' AS term, w0 AS weight, told, yy, n FROM o UNION ALL SELECT 'efg', wa, told, yy, n FROM o UNION ALL SELECT 'tov_pct', wb, told, yy, n FROM o
    UNION ALL SELECT 'orb_pct', wc, told, yy, n FROM o UNION ALL SELECT 'ft_rate', wd, told, yy, n FROM o) q"""


@query("four_factor_ols", ("player_box",), _FACTOR_ROWS + _OLS)
def four_factor_ols(t):
    """Weights of net rating on the four factors."""
    w = teams.four_factor_weights(teams.four_factor_rows(t.player_box))
    return w.select("term", F.round("weight", 5).alias("weight"), F.round("r2", 8).alias("r2"), F.round("rmse", 6).alias("rmse"))
