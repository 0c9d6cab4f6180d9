"""Row-by-row statements of the possession and stint rules, used only to check the window plans."""

from __future__ import annotations


def walk_possessions(rows):
    """`rows`: ordered event dicts of one game with flags; gives possession dicts and lost points."""
    out, cur, owed, period, lost = [], None, None, None, 0.0
    teams = {rows[0]["home_team_id"], rows[0]["away_team_id"]}
    other = lambda t: next(iter(teams - {t}))

    def start(t, r, why):
        return {"period": r["period_number"], "off": t, "start": r["secs"], "why": why, "pts": 0.0,
                "oreb": False, "shot": None, "start_idx": r["idx"]}

    def finish(p, secs, why, idx):
        secs = p["start"] if secs is None else secs
        gap = None if p["shot"] is None or p["start"] is None else p["start"] - p["shot"]
        if p["oreb"]:
            ctx = "second_chance"
        elif p["why"] in ("dreb", "steal", "made_fg", "made_ft") and gap is not None and gap <= 7:
            ctx = "transition"
        else:
            ctx = "halfcourt"
        p.update(end=secs, end_why=why, end_idx=idx, context=ctx)
        out.append(p)

    for i, r in enumerate(rows):
        if r["period_number"] is None:
            continue
        if period is not None and r["period_number"] != period and cur:
            finish(cur, 0.0, "period_end", r["idx"] - 1)
            cur = None
        period = r["period_number"]
        t = r["team_id"]
        if t not in teams:
            continue
        if cur is None:
            if not r["ball"]:
                continue
            cur = start(t, r, "period_start")
        if r["made"]:
            v = r["score_value"] if r["score_value"] and r["score_value"] > 0 else (1.0 if r["ft"] else 2.0)
            if t == cur["off"]:
                cur["pts"] += v
            elif r["ft"] and t == owed and out:
                out[-1]["pts"] += v
            else:
                lost += v
        if r["shot"] or r["reb"] or r["tov"]:
            owed = None
        if r["shot"] and t == cur["off"] and cur["shot"] is None:
            cur["shot"] = r["secs"]
        if r["oreb"]:
            cur["oreb"] |= t == cur["off"]
            continue
        if r["dreb"]:
            if t != cur["off"]:
                finish(cur, r["secs"], "dreb", r["idx"])
                cur = start(t, r, "dreb")
            continue
        if r["tov"]:
            finish(cur, r["secs"], "turnover", r["idx"])
            near = any(x["stl"] for x in rows[max(0, i - 1): i + 2])
            cur = start(other(t), r, "steal" if near else "turnover")
            continue
        if r["made"] and not r["ft"]:
            finish(cur, r["secs"], "made_fg", r["idx"])
            owed = t
            cur = start(other(t), r, "made_fg")
        elif r["made"] and r["last_ft"] and t == cur["off"]:
            finish(cur, r["secs"], "made_ft", r["idx"])
            cur = start(other(t), r, "made_ft")
    if cur:
        finish(cur, 0.0, "period_end", len(rows))
    return out, lost


def walk_stints(rows, starters, period_seconds):
    """`rows`: ordered event dicts with substitution fields; `starters`: team -> set of players."""
    teams = [rows[0]["home_team_id"], rows[0]["away_team_id"]]
    floor = {t: set(starters.get(t, ())) for t in teams}
    out, cur, opened, bad, phantom = [], None, None, 0, 0

    def close(secs):
        nonlocal cur
        if cur is None:
            return
        secs = cur["start"] if secs is None else secs
        out.append({**cur, "end": secs, "floor": {t: sorted(floor[t]) for t in teams}})
        cur = None

    def open_at(period, secs):
        return {"period": period, "start": secs, "pts": dict.fromkeys(teams, 0.0)}

    for r in rows:
        p, t = r["period_number"], r["team_id"]
        if p is None:
            continue
        if cur is None:
            cur = open_at(p, period_seconds(p) if p != opened else r["secs"])
            opened = p
        elif p != cur["period"]:
            close(0.0)
            cur = open_at(p, period_seconds(p))
            opened = p
        if r["is_sub"]:
            if r["grp_start"]:
                close(r["secs"])
            a, b, d = r["athlete_id_1"], r["athlete_id_2"], r["sub_dir"]
            if d is None or t not in teams:
                bad += 1
            elif d == "paired":
                phantom += b not in floor[t]
                floor[t] = (floor[t] - {b}) | {a}
            elif d == "in":
                floor[t] = floor[t] | {a}
            else:
                phantom += a not in floor[t]
                floor[t] = floor[t] - {a}
            if r["grp_end"]:
                cur = open_at(p, r["secs"])
            continue
        if t in teams and (r["scored_text"] or r["made"]):
            v = r["score_value"] if r["score_value"] and r["score_value"] > 0 else r["inferred"]
            cur["pts"][t] += v
    close(0.0)
    return out, bad, phantom
