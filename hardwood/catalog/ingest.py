"""Ingest and bookkeeping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.catalog.registry import query
from hardwood.operators.filters import as_of
from hardwood.sources import contract, links, resolve

CUT = "2000-06-30"


@query(
    "standardize_contract", ("team_box",),
    """ SELECT cast(l_orderkey AS varchar) AS game_id, cast(l_suppkey AS varchar) AS team_id, sum(l_quantity) AS fga, sum(l_extendedprice) AS pts FROM lineitem GROUP BY 1, 2""",
)
def standardize_contract(t):
    """Upper-case source names, a mapping with an absent entry, text ids."""
    raw = t.lineitem.toDF(*[c.upper() for c in t.lineitem.columns])
    std = contract.standardize(
        raw, {"L_ORDERKEY": "game_id", "L_SUPPKEY": "team_id", "L_QUANTITY": "fga", "L_EXTENDEDPRICE": "pts", "NO_SUCH": "fta"}, required=["fga", "pts"]
    )
    return contract.ids_as_text(std).groupBy("game_id", "team_id").agg(
        F.sum("fga").alias("fga"), F.sum("pts").alias("pts"),
    )


@query(
    "canonical_team_box", ("team_box",),
    " SELECT season, count(*) AS n, sum(pts) AS pts, sum(tov) AS tov, sum(dreb) AS dreb FROM team_box GROUP BY season",
)
def canonical(t):
    raw = t.team_box.withColumnsRenamed(contract.RAW_BOX)
    return contract.canonical_team_box(raw).groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pts").alias("pts"), F.sum("tov").alias("tov"), F.sum("dreb").alias("dreb")
    )


@query(
    "incremental_topup", ("team_box",),
    f""" SELECT game_id, team_id, game_date, pts, season_type FROM team_box WHERE game_date <= DATE '{CUT}'
      UNION ALL SELECT DISTINCT game_id, team_id, game_date, pts, NULL::int FROM team_box WHERE game_date > DATE '{CUT}'""",
)
def incremental_topup(t):
    """Older release plus newer rows that arrive as text without the season type."""
    cols = ["game_id", "team_id", "game_date", "pts", "season_type"]
    base = as_of(t.team_box.select(*cols), CUT)
    late = t.team_box.select(
        "game_id", "team_id", F.col("game_date").cast("string").alias("game_date"), F.col("pts").cast("string").alias("pts"),
        F.lit("x").alias("not_in_base"), "team_home_away",
    )
    return contract.top_up(base, late, ["game_id", "team_id", "pts"])


@query(
    "resume_antijoin", ("schedule",),
    f""" SELECT s.game_id FROM schedule s WHERE status_type_completed AND NOT EXISTS (SELECT 1 FROM team_box b WHERE b.game_id = s.game_id AND b.game_date <= DATE '{CUT}')""",
)
def resume_antijoin(t):
    wanted = resolve.resolve_games(t.schedule).select("game_id")
    return resolve.pending_games(wanted, as_of(t.team_box, CUT))


@query(
    "cache_status", ("schedule",),
    f""", w AS (SELECT DISTINCT game_id FROM schedule WHERE status_type_completed),
      a AS (SELECT DISTINCT game_id FROM team_box WHERE game_date <= DATE '{CUT}'), b AS (SELECT DISTINCT game_id FROM team_box WHERE season_type = 2)
      SELECT 'stints' AS table_name, count(*) AS requested, count(a.game_id) AS stored, count(*) - count(a.game_id) AS missing FROM w LEFT JOIN a ON w.game_id = a.game_id
      UNION ALL SELECT 'possessions', count(*), count(b.game_id), count(*) - count(b.game_id) FROM w LEFT JOIN b ON w.game_id = b.game_id""",
)
def cache_status(t):
    wanted = resolve.resolve_games(t.schedule).select("game_id")
    return resolve.cache_status(wanted, {
        "stints": as_of(t.team_box, CUT), "possessions": t.team_box.where(F.col("season_type") == 2),
    })


@query(
    "link_ids", (),
    r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/(\w+)', 1)) AS link_id FROM pages""",
)
def link_ids(t):
    """Link ids of whole pages; the pattern is a parameter because these pages carry words, not numbers."""
    return links.link_ids(t.pages, r'href="/(\w+)')


@query(
    "page_numbers", (),
    r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(url, '/(\d+)', 1)) AS link_id FROM pages""",
)
def page_numbers(t):
    return links.link_ids(t.pages, r"/(\d+)", text="url")
