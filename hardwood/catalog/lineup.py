"""Lineup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.catalog.player import _PLAYER, pct_sql
from hardwood.catalog.registry import query
from hardwood.plans import lineups as LU
from hardwood.plans import players
from hardwood.session import materialize

CORE3 = ("P1", "P2", "P4")
CORE2 = ("P3", "P9")


def _in(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def search_sql(core, bounds, min_games: int, types=None, top_n: int = 6) -> str:
    k = 5 - len(core)
    keep = f"AND (contract_type IN ({_in(types)}) OR player IN ({_in(core)}))" if types else ""
    ids = [f"x{i}" for i in range(k)]
    joins = " ".join(
        f"JOIN cand x{i} ON x{i - 1}.player < x{i}.player" if i else "FROM cand x0" for i in range(k)
    )
    cols = ["u", "ue", "ut", "o", "f", "g", "fw", "c"]
    sums = ", ".join(f"core.{c} + " + " + ".join(f"{x}.{c}" for x in ids) + f" AS {c}" for c in cols)
    part = lambda p: f"list_contains(string_split(position, '-'), '{p}')::int"
    added = "concat(" + ", ', ', ".join(f"{x}.player" for x in ids) + ")"
    b = bounds
    return f""", pool AS (SELECT * FROM lineup_pool WHERE games_played >= {min_games} {keep}),
     tm AS (SELECT player, usage AS u, usage * efg_pct AS ue, usage * tov_pct AS ut, oreb_pct AS o, fta_rate AS f, {part('G')} AS g, {part('F')} AS fw, {part('C')} AS c FROM pool),
     cand AS (SELECT * FROM tm WHERE player NOT IN ({_in(core)})),
     core AS (SELECT {", ".join(f"sum({c}) AS {c}" for c in cols)} FROM tm WHERE player IN ({_in(core)})),
     cmb AS (SELECT {added} AS added_players, {sums} {joins}, core),
     ok AS (SELECT *, pow(CASE WHEN u < 2 THEN u * 100 ELSE u END / 100, 0.25e0) AS st FROM cmb WHERE g BETWEEN {b['G'][0]} AND {b['G'][1]}
            AND fw BETWEEN {b['F'][0]} AND {b['F'][1]} AND c BETWEEN {b['C'][0]} AND {b['C'][1]})
     SELECT added_players, round(ue / u / st, 8) AS lineup_efg, round(ut / u * st, 8) AS lineup_tov, round(CASE WHEN u < 2 THEN u * 100 ELSE u END, 6) AS usage_total,
       round_even(-72.88772e0 + 144.50778e0 * (ue / u / st) - 93.57270e0 * (ut / u * st) + 47.19972e0 * (o / 5) + 18.79830e0 * (f / 5), 2) AS projected_net
     FROM ok ORDER BY projected_net DESC, added_players LIMIT {top_n}"""


def _shown(df):
    return df.select(
        "added_players", F.round("lineup_efg", 8).alias("lineup_efg"), F.round("lineup_tov", 8).alias("lineup_tov"),
        F.round("usage_total", 6).alias("usage_total"), "projected_net",
    )


@query("lineup_search", ("lineup_pool",), search_sql(CORE3, LU.LINEUP_PRESETS["balanced"], 2, ("Veteran", "Rookie", "Reserve")))
def lineup_search(t):
    """Two additions to a core of three, by contract type."""
    pool = materialize(LU.candidate_pool(t.lineup_pool, CORE3, 2, ("Veteran", "Rookie", "Reserve")))
    return _shown(LU.best_additions(pool, CORE3, "balanced"))


@query("lineup_search_core2", ("lineup_pool",), search_sql(CORE2, LU.LINEUP_PRESETS["small"], 2, top_n=12))
def lineup_search_core2(t):
    """Three additions to a core of two: every combination of the league."""
    pool = materialize(LU.candidate_pool(t.lineup_pool, CORE2, 2))
    return _shown(LU.best_additions(pool, CORE2, "small", 12))


def _roster_sql() -> str:
    head, tail = search_sql(CORE3, LU.LINEUP_PRESETS["big"], 2).rsplit("SELECT added_players, round", 1)
    return f"""{head.rstrip()}, opt AS (SELECT added_players, round{tail}),
      mem AS (SELECT added_players, projected_net, unnest(list_concat([{_in(CORE3)}], string_split(added_players, ', '))) AS player FROM opt)
      SELECT mem.added_players, mem.projected_net, mem.player, pool.position FROM mem JOIN pool ON pool.player = mem.player"""


@query("lineup_roster", ("lineup_pool",), _roster_sql())
def lineup_roster(t):
    pool = materialize(LU.candidate_pool(t.lineup_pool, CORE3, 2))
    return LU.lineup_roster(LU.best_additions(pool, CORE3, "big"), pool, CORE3)


@query(
    "player_insight", ("player_box",),
    _PLAYER + f""", pp AS (SELECT season, athlete_id, {pct_sql('position', 10)} FROM ps),
      v AS (SELECT row_number() OVER () AS r, season, athlete_id, usage_pctile_pos AS u, efg_pctile_pos AS e, tov_pctile_pos AS t, oreb_pctile_pos AS o, fta_rate_pctile_pos AS f FROM pp),
      l AS (SELECT r, e AS p, 1 AS i, 'shooting' AS label FROM v UNION ALL SELECT r, t, 2, 'ball care' FROM v UNION ALL SELECT r, o, 3, 'offensive boards' FROM v
            UNION ALL SELECT r, f, 4, 'drawn fouls' FROM v),
      k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p DESC, i) AS n FROM l WHERE p IS NOT NULL),
      w AS (SELECT r, string_agg(label, ' and ' ORDER BY n) AS why FROM k WHERE n <= 2 GROUP BY r)
      SELECT season, athlete_id, CASE WHEN e >= 0.75 AND u <= 0.55 THEN 'shoots without the ball' WHEN t >= 0.75 AND u <= 0.7 THEN 'keeps possessions alive'
        WHEN o >= 0.7 OR f >= 0.7 THEN 'works inside' ELSE 'does some of everything' END AS role, why FROM v LEFT JOIN w USING (r)""",
)
def player_insight(t):
    stored = players.stored_player_season(t.player_box_by_player, players.percentile_columns(players.PERCENTILE_SPECS))
    s = players.player_percentiles(stored, specs=players.PERCENTILE_SPECS)
    rounded = s.withColumns({
        f"{p}_pctile_pos": F.round(f"{p}_pctile_pos", 10) for p in ("usage", "efg", "tov", "oreb", "fta_rate")
    })
    return LU.player_insight(rounded).select("season", "athlete_id", "role", "why")
