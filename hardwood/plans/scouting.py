"""Matchup cards, leaders, key selection and display rows over stored profiles.

Label, header and phrase tables are inputs of the user: a handful of rows each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hardwood.functions import text as X
from hardwood.schemas import KEY_MAX_BULLETS, KEY_MIN_POSS, KEY_STRENGTH_MIN, KEY_WEAKNESS_MAX

LABEL_KEY = ["source", "dimension", "category"]
HEADER_KEY = ["source", "dimension"]
LABEL_DDL = "source string, dimension string, category string, display_label string, bulletable boolean"
HEADER_DDL = "source string, dimension string, unit_noun string, ppp_meaningful boolean"
PHRASE_DDL = "side string, source string, dimension string, category string, phrase string"
SCOPE = ["league", "season"]
RANK_COLUMN = {"strength": "ppp_percentile", "weakness": "ppp_percentile", "attack": "def_ppp_percentile"}


def scope_of(df: DataFrame, *others: DataFrame) -> list[str]:
    """League and season, as far as all the tables have them."""
    return [k for k in SCOPE if all(k in x.columns for x in (df, *others))]


def default_labels(spark: SparkSession, source: str = "pbp_derived") -> DataFrame:
    rows = [
        ("context", "transition", "Transition", True), ("context", "halfcourt", "Half court", False),
        ("context", "second_chance", "Second chance", True), ("shot_zone", "at_rim", "At the rim", True),
        ("shot_zone", "paint", "Paint", True), ("shot_zone", "mid_range", "Mid-range", True),
        ("shot_zone", "corner_3", "Corner three", True), ("shot_zone", "above_break_3", "Above-the-break three", True),
        ("ball_security", "live_ball_to", "Live-ball turnovers", True),
        ("ball_security", "dead_ball_to", "Dead-ball turnovers", True),
        ("ball_security", "no_turnover", "Possessions kept", False),
    ]
    return spark.createDataFrame([(source, *r) for r in rows], LABEL_DDL)


def default_headers(spark: SparkSession, source: str = "pbp_derived") -> DataFrame:
    rows = [
        ("context", "possession", True), ("shot_zone", "attempt", True),
        ("ball_security", "possession", False), ("creation", "made FG", True),
    ]
    return spark.createDataFrame([(source, *r) for r in rows], HEADER_DDL)


def matchup_cards(profile: DataFrame, matchups: DataFrame, dimension: Sequence[str] | None = None) -> DataFrame:
    """Our offence against their defence for every requested (team, opponent) pair.

    Pairs come from a schedule or a request, never from crossing all teams.
    """
    if dimension is not None:
        profile = profile.where(F.col("dimension").isin(list(dimension)))
    scope = scope_of(profile)
    us = profile.select(
        *scope, "team", "dimension", "category", "unit", "source", F.col("off_n").alias("poss"), F.col("off_freq").alias("freq"),
        F.col("off_ppp").alias("ppp"), F.col("off_ppp_pctl").alias("ppp_percentile"),
    )
    them = profile.select(
        *scope, F.col("team").alias("opponent"), "dimension", "category", "def_ppp", F.col("def_ppp_pctl").alias("def_ppp_percentile")
    )
    asked = scope_of(profile, matchups)
    pairs = matchups.select(*asked, "team", "opponent").distinct()
    return pairs.join(us, [*asked, "team"]).join(them, [*scope, "opponent", "dimension", "category"]).select(
        *scope, "team", "opponent", "dimension", "category", "unit", "source", "poss", "freq", "ppp", "ppp_percentile",
        "def_ppp", "def_ppp_percentile",
    )


def attack_index_card(profile: DataFrame, team: str, opponent: str, dimension: Sequence[str] | None = None) -> DataFrame:
    known = {r[0] for r in profile.where(F.col("team").isin(team, opponent)).select("team").distinct().collect()}
    for side in (team, opponent):
        if side not in known:
            raise ValueError(f"no profile rows for {side!r}")
    pair = profile.sparkSession.createDataFrame([(team, opponent)], "team string, opponent string")
    return matchup_cards(profile, pair, dimension).orderBy("dimension", F.desc("freq"))


def population_size(profile: DataFrame) -> DataFrame:
    """Teams of each league season."""
    return profile.groupBy(*scope_of(profile)).agg(F.countDistinct("team").cast("int").alias("pop_n"))


def profile_rows(profile: DataFrame) -> DataFrame:
    return profile.select(
        *scope_of(profile), "team", "dimension", "category", "unit", "source", F.col("off_n").alias("poss"), F.col("off_freq").alias("freq"),
        F.col("off_ppp").alias("ppp"), F.col("off_ppp_pctl").alias("ppp_percentile"), "def_ppp",
        F.col("def_ppp_pctl").alias("def_ppp_percentile"),
    )


def with_labels(rows: DataFrame, labels: DataFrame, headers: DataFrame) -> DataFrame:
    """Label (category name when unknown), bulletable and rate flags (true when unknown)."""
    lab = labels.dropDuplicates(LABEL_KEY).withColumnRenamed("bulletable", "_b")
    head = headers.dropDuplicates(HEADER_KEY).select(*HEADER_KEY, F.col("ppp_meaningful").alias("_m"))
    return (
        rows.join(lab, LABEL_KEY, "left").join(head, HEADER_KEY, "left")
        .withColumns({
            "label": F.coalesce("display_label", "category"),
            "bulletable": F.when(F.col("display_label").isNull(), True).otherwise(F.coalesce("_b", F.lit(False))),
            "ppp_meaningful": F.coalesce("_m", F.lit(True)),
        }).drop("display_label", "_b", "_m")
    )


def display_rows(
    rows: DataFrame, pop_n, population, labels: DataFrame, headers: DataFrame,
    pctl: str = "ppp_percentile", compact: bool = False,
) -> DataFrame:
    out = with_labels(rows, labels, headers)
    return out.withColumns({
        "meta": X.volume_line("freq", "ppp", "unit", "ppp_meaningful"),
        "standing": X.row_standing(pctl, pop_n, population, "dimension", "category", compact),
        "rank": X.rank_from_percentile(pctl, pop_n),
        "def_display_percentile": X.flip_percentile("def_ppp_percentile"),
    })


def team_profile(profile, team: str, sizes: DataFrame, population, labels, headers, bulletable_only: bool = False) -> DataFrame:
    """Display lines of one team; `sizes` has the population of each league season (`population_size`). An unknown team is an error."""
    rows = profile_rows(profile).where(F.col("team") == team)
    if rows.isEmpty():
        raise LookupError(f"no profile rows for {team!r}")
    out = display_rows(rows.join(sizes, scope_of(profile)), F.col("pop_n"), population, labels, headers)
    if bulletable_only:
        out = out.where("bulletable")
    return out.orderBy("dimension", F.desc("freq"))


def leaders(profile: DataFrame, dimension: str, category: str, n: int = 5, best: bool = True) -> DataFrame:
    """Best or worst teams of one category in each league season; unranked teams come last either way."""
    key = F.col("ppp_percentile")
    rows = profile_rows(profile).where((F.col("dimension") == dimension) & (F.col("category") == category))
    order = [key.desc_nulls_last() if best else key.asc_nulls_last(), F.col("team")]
    place = F.row_number().over(Window.partitionBy(*scope_of(profile)).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def dimensions(labels: DataFrame, headers: DataFrame) -> DataFrame:
    return labels.join(headers, HEADER_KEY, "left")


def bullet_pool(cards: DataFrame, labels: DataFrame) -> DataFrame:
    return cards.join(labels.where("bulletable").select(*LABEL_KEY).distinct(), LABEL_KEY, "left_semi")


def select_keys(
    cards: DataFrame, side: str, labels: DataFrame, percentile: float | None = None,
    min_poss: int = KEY_MIN_POSS, max_bullets: int = KEY_MAX_BULLETS,
) -> DataFrame:
    """Rows of each matchup worth a bullet: gated by percentile, ordered by volume times extremity.

    Volume is relative to the most frequent category of its dimension, taken before the gate.
    """
    if side not in RANK_COLUMN:
        raise ValueError(f"side {side!r} is not one of {sorted(RANK_COLUMN)}")
    c = F.col
    rank, scope = c(RANK_COLUMN[side]), scope_of(cards)
    pool = bullet_pool(cards, labels).where(rank.isNotNull() & (c("poss") >= min_poss))
    top = F.max("freq").over(Window.partitionBy(*scope, "team", "opponent", "dimension"))
    pool = pool.withColumn("freq_rel", F.when(top > 0, c("freq") / top).otherwise(0.0))
    if side == "weakness":
        gated = pool.where(rank < (KEY_WEAKNESS_MAX if percentile is None else percentile))
        score = c("freq_rel") * (F.lit(100) - rank)
    else:
        gated = pool.where(rank > (KEY_STRENGTH_MIN if percentile is None else percentile))
        score = c("freq_rel") * rank
    w = Window.partitionBy(*scope, "team", "opponent").orderBy(
        c("key_score").desc(), c("dimension"), c("freq").desc(), c("category")
    )
    return (
        gated.withColumn("key_score", score).withColumn("side", F.lit(side))
        .withColumn("key_no", F.row_number().over(w)).where(c("key_no") <= max_bullets)
    )


def key_sentences(
    keys: DataFrame, phrases: DataFrame, labels: DataFrame, headers: DataFrame, pop_n: Column, population: Column,
    subject: Column | str = "team", mode: str = "auto",
) -> DataFrame:
    """One sentence per selected row; a strength or attack row without a phrase gives none."""
    c = F.col
    p = phrases.dropDuplicates(["side", *LABEL_KEY])
    rows = with_labels(keys, labels, headers).join(p, ["side", *LABEL_KEY], "left")
    rows = rows.where((c("side") == "weakness") | c("phrase").isNotNull())
    lit = F.lit
    share = F.concat(X.whole_percent("freq"), lit(" "), X.unit_denominator("unit"))
    rate = F.concat(X.two_decimals("ppp"), lit(" "), X.unit_phrase("unit"))
    place = X.standing("ppp_percentile", pop_n, population, mode)
    inverted = X.row_standing("ppp_percentile", pop_n, population, "dimension", "category")
    tail = F.when(F.coalesce("phrase", lit("")) != "", F.concat(lit(" — "), c("phrase"), lit("."))).otherwise(lit("."))
    who = c(subject) if isinstance(subject, str) else subject
    own = F.when(
        c("ppp_meaningful"),
        F.concat(who, lit(": "), c("label"), lit(", "), share, lit(" at "), F.when(c("side") == "weakness", "just ").otherwise(""), rate,
                 lit(", "), place, tail),
    ).otherwise(F.concat(who, lit(": "), c("label"), lit(", "), share, lit(", "), inverted, tail))
    attack = F.concat(
        lit("Us: "), c("label"), lit(", "), share, lit(" at "), rate, lit("; "), c("opponent"), lit(" gives up "),
        X.two_decimals("def_ppp"), lit(" there, "),
        X.standing(X.flip_percentile("def_ppp_percentile"), pop_n, population, mode, defense=True), tail,
    )
    return rows.withColumn("sentence", F.when(c("side") == "attack", attack).otherwise(own))


def build_keys(profile: DataFrame, matchups: DataFrame, labels: DataFrame, sides: Sequence[str] = ("strength", "weakness"), min_poss: int = KEY_MIN_POSS) -> DataFrame:
    """Selected rows of every matchup: the opponent's card for its strengths and weaknesses, ours to attack."""
    flipped = matchups.select(*scope_of(matchups), F.col("opponent").alias("team"), F.col("team").alias("opponent"))
    parts = [
        select_keys(matchup_cards(profile, matchups if s == "attack" else flipped), s, labels, min_poss=min_poss) for s in sides
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def priority_keys(keys: DataFrame, k: int = 3) -> DataFrame:
    """Highest scores of both sides together."""
    w = Window.partitionBy(*scope_of(keys), "team", "opponent").orderBy(F.desc("key_score"), "side", "key_no")
    return keys.withColumn("priority", F.row_number().over(w)).where(F.col("priority") <= k)


def shot_identity(rows: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """Top shot zones per team as tags, plus the share of threes."""
    c = F.col
    zones = rows.where((c("dimension") == "shot_zone") & c("freq").isNotNull()).join(
        labels.select(*LABEL_KEY, "display_label"), LABEL_KEY, "left"
    )
    w = Window.partitionBy(*scope_of(rows), "team").orderBy(F.desc("freq"), "category")
    tag = F.concat(F.coalesce("display_label", "category"), F.lit(" "), X.whole_percent("freq"))
    ranked = zones.withColumn("_rn", F.row_number().over(w))
    return ranked.groupBy(*scope_of(rows), "team").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(c("_rn") <= k, F.struct("_rn", tag.alias("tag"))))), lambda x: x["tag"]
        ), "; ").alias("tags"),
        F.sum(F.when(c("category").isin("corner_3", "above_break_3"), c("freq")).otherwise(0.0)).alias("three_share"),
    )
