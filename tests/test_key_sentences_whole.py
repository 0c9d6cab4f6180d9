"""Every selected key has its sentence: all three sides, and the dimensions that state a rate only."""

from hardwood.catalog import profile
from hardwood.catalog.registry import Inputs


def test_a_sentence_for_every_key(spark):
    tables = Inputs(spark, "/root/testdata/sf0.01")  # the smallest scale has no key of turnovers
    keys = profile.keys_selected(tables).collect()
    got = profile.key_sentences(tables).collect()
    ids = lambda rows: sorted((r.league, r.season, r.team, r.opponent, r.side, r.key_no, r.category) for r in rows)
    assert ids(got) == ids(keys)
    assert {r.side for r in got} == {"strength", "weakness", "attack"}
    assert any(r.side != "attack" and r.dimension == "ball_security" for r in keys)
    turnovers = ("live_ball_to", "dead_ball_to")
    for r in got:
        if r.side == "attack":
            assert r.evidence.startswith("Us: ") and f"; {r.opponent} gives up " in r.evidence and " defensively in the league" in r.evidence
            assert r.action == f"Go at the {r.category}"
        else:
            assert r.evidence.startswith(f"{r.team}: ") and r.action == f"Guard the {r.category}"
            assert (" points per " in r.evidence) == (r.category not in turnovers)
            assert r.category not in turnovers or "% of possessions, " in r.evidence
