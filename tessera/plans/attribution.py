"""Why the anchor's market share moved: market by inversion, drivers, gated titles, coverage, facets and the packs of week and owners.

What several parts of a report read (a row for each week, the titles' changes) is stored once for each report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ANCHOR, Tables
from .domain import FLOOR_SQL, title_floor
from .registry import query

DOUBLE = "double"
#: Labels that are reported one by one; the rest of the market is "other".
PANEL = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
#: Basis points of the market from which a title counts as a mover or as an anchor, by owner.
TAU_DELTA, TAU_LEVEL = 25, 75
TAU_LEVEL_BY_OWNER = {"ASIA": 40, "EUROPE": 60}
#: The owner whose share is explained, and the owners that are reported one by one.
SUBJECT, OWNERS = "ASIA", ("AMERICA", "ASIA", "EUROPE")
#: The label of an owner in the panel.
OWNER_OF_LABEL = {"AUTOMOBILE": "AMERICA", "BUILDING": "ASIA", "FURNITURE": "EUROPE", "HOUSEHOLD": "AFRICA", "MACHINERY": "MIDDLE EAST"}
#: Fixed value: titles first sold more months ago are no longer current.
CURRENT_MONTHS = 18
#: Headlines by driver.
HEADLINES = {
    "outgrown": "{} volume is up; share is down because the pie grew faster",
    "held": "{} held while the market faded — share up on anchors",
    "other_up": "{} share fell because Other (outside the eight) grew the market",
    "own_up": "{} share rose on {} title gains",
    "own_down": "{} share fell on {} title losses",
    "market_up": "Market expanded faster than {}",
    "market_down": "Market contracted; {} share moved with the fade",
    "na": "Not enough lag to classify this week",
    "mix": "Mixed own vs market effects for {}",
}


def week_market(t: Tables) -> DataFrame:
    return t.stored("week-market", lambda: _week_market(t))


def _week_market(t: Tables) -> DataFrame:
    """One row a week: the market is the anchor's volume over its share, never a sum of the panel."""
    p = t.panel.withColumn("ae", F.col("ae").cast(DOUBLE))
    anchor = p.filter(F.col("label") == ANCHOR).select("week_end", F.col("ae").alias("own_ae"), (F.col("ae") / F.col("share")).alias("market"))
    panel = p.filter(F.col("label").isin(*PANEL)).groupBy("week_end").agg(F.sum(F.col("ae").cast("decimal(18,2)")).cast(DOUBLE).alias("panel_ae"))
    x = anchor.join(panel, "week_end").withColumn("other_ae", F.col("market") - F.col("panel_ae")).withColumn("share", F.col("own_ae") / F.col("market"))
    w = Window.orderBy("week_end")  # a row for each week: a few hundred in all
    for c in ("own_ae", "market", "panel_ae", "other_ae", "share"):
        x = x.withColumn(f"prev_{c}", F.lag(c).over(w))
    return effects(x)


def effects(x: DataFrame) -> DataFrame:
    """The change in share in basis points, split into the own and the market's part (they add up exactly), and the driver."""
    x = x.withColumn("d_share_bps", (F.col("share") - F.col("prev_share")) * 10000)
    x = x.withColumn("own_effect_bps", (F.col("own_ae") - F.col("prev_own_ae")) / F.col("market") * 10000)
    x = x.withColumn("market_effect_bps", -F.col("prev_share") * (F.col("market") - F.col("prev_market")) / F.col("market") * 10000)
    return x.withColumn("driver", driver())


def driver() -> Column:
    """The first rule that holds decides."""
    d_own, d_market = F.col("own_ae") - F.col("prev_own_ae"), F.col("market") - F.col("prev_market")
    d_other, d_panel = F.col("other_ae") - F.col("prev_other_ae"), F.col("panel_ae") - F.col("prev_panel_ae")
    d_share, own, market = F.col("d_share_bps"), F.col("own_effect_bps"), F.abs("market_effect_bps")
    still = F.abs(d_own) / F.greatest(F.abs("prev_own_ae"), F.lit(1.0)) < 0.02
    return (
        F.when(d_share.isNull() | d_own.isNull() | d_market.isNull(), "na")
        .when((d_own > 0) & (d_share < 0), "outgrown")
        .when(still & (d_market < 0) & (d_share > 0), "held")
        .when((d_share < 0) & (d_other > F.greatest(d_panel - d_own, F.lit(0.0))), "other_up")
        .when((d_share > 0) & (d_own > 0) & (own >= market), "own_up")
        .when((d_share < 0) & (d_own < 0) & (F.abs(own) >= market), "own_down")
        .when((d_share < 0) & (d_market > 0), "market_up")
        .when((d_share > 0) & (d_market < 0), "market_down")
        .otherwise("mix")
    )


DRIVER_SQL = """CASE WHEN prev_own IS NULL THEN 'na' WHEN own_ae > prev_own AND d_share_bps < 0 THEN 'outgrown'
    WHEN abs(own_ae - prev_own) / greatest(abs(prev_own), 1.0) < 0.02 AND market < prev_market AND d_share_bps > 0 THEN 'held'
    WHEN d_share_bps < 0 AND other_ae - prev_other > greatest((panel_ae - prev_panel) - (own_ae - prev_own), 0.0) THEN 'other_up'
    WHEN d_share_bps > 0 AND own_ae > prev_own AND own_effect_bps >= abs(market_effect_bps) THEN 'own_up'
    WHEN d_share_bps < 0 AND own_ae < prev_own AND abs(own_effect_bps) >= abs(market_effect_bps) THEN 'own_down'
    WHEN d_share_bps < 0 AND market > prev_market THEN 'market_up' WHEN d_share_bps > 0 AND market < prev_market THEN 'market_down' ELSE 'mix' END AS driver"""
MARKET_SQL = f"""m0 AS (SELECT week_end, max(CASE WHEN label = 'BUILDING' THEN CAST(ae AS DOUBLE) END) AS own_ae, max(CASE WHEN label = 'BUILDING' THEN CAST(ae AS DOUBLE) / share END) AS market,
    CAST(sum(CASE WHEN label <> 'MACHINERY' THEN ae END) AS DOUBLE) AS panel_ae FROM panel GROUP BY 1),
    m1 AS (SELECT *, market - panel_ae AS other_ae, own_ae / market AS share FROM m0 WHERE own_ae IS NOT NULL),
    m2 AS (SELECT *, lag(own_ae) OVER w AS prev_own, lag(market) OVER w AS prev_market, lag(panel_ae) OVER w AS prev_panel, lag(other_ae) OVER w AS prev_other, lag(share) OVER w AS prev_share FROM m1 WINDOW w AS (ORDER BY week_end)),
    m3 AS (SELECT *, (share - prev_share) * 10000 AS d_share_bps, (own_ae - prev_own) / market * 10000 AS own_effect_bps, -prev_share * (market - prev_market) / market * 10000 AS market_effect_bps FROM m2),
    weeks AS (SELECT *, {DRIVER_SQL} FROM m3)"""
WEEK_OUT = "week_end, round(market, 4) AS market, round(other_ae, 4) AS other_ae, round(d_share_bps, 6) AS d_share_bps, round(own_effect_bps, 6) AS own_effect_bps, round(market_effect_bps, 6) AS market_effect_bps, driver"


def rounded(x: DataFrame, *keys: str, **digits: int) -> DataFrame:
    return x.select(*keys, *(F.round(c, n).alias(c) for c, n in digits.items()))


@query(f"WITH {MARKET_SQL} SELECT {WEEK_OUT} FROM weeks")
def attr_week_market(t: Tables) -> DataFrame:
    return rounded(week_market(t), "week_end", "driver", market=4, other_ae=4, d_share_bps=6, own_effect_bps=6, market_effect_bps=6)


def owner_weeks(t: Tables) -> DataFrame:
    """The same split for each label against the market, all labels at once."""
    m = week_market(t).select("week_end", "market", "panel_ae", "other_ae")
    x = t.panel.select("week_end", "label", F.col("ae").cast(DOUBLE).alias("own_ae")).join(m, "week_end").withColumn("share", F.col("own_ae") / F.col("market"))
    w = Window.partitionBy("label").orderBy("week_end")
    for c in ("own_ae", "market", "panel_ae", "other_ae", "share"):
        x = x.withColumn(f"prev_{c}", F.lag(c).over(w))
    return effects(x)


@query(f"""WITH {MARKET_SQL}, o1 AS (SELECT week_end, label, CAST(p.ae AS DOUBLE) AS own_ae, w.market, w.panel_ae, w.other_ae, CAST(p.ae AS DOUBLE) / w.market AS share FROM panel p JOIN weeks w USING (week_end)),
    o2 AS (SELECT *, lag(own_ae) OVER w AS prev_own, lag(market) OVER w AS prev_market, lag(panel_ae) OVER w AS prev_panel, lag(other_ae) OVER w AS prev_other, lag(share) OVER w AS prev_share FROM o1 WINDOW w AS (PARTITION BY label ORDER BY week_end)),
    o3 AS (SELECT *, (share - prev_share) * 10000 AS d_share_bps, (own_ae - prev_own) / market * 10000 AS own_effect_bps, -prev_share * (market - prev_market) / market * 10000 AS market_effect_bps FROM o2)
    SELECT week_end, label, round(d_share_bps, 6) AS d_share_bps, round(own_effect_bps, 6) AS own_effect_bps, round(market_effect_bps, 6) AS market_effect_bps, {DRIVER_SQL} FROM o3""")
def attr_owner_weeks(t: Tables) -> DataFrame:
    return rounded(owner_weeks(t), "week_end", "label", "driver", d_share_bps=6, own_effect_bps=6, market_effect_bps=6)


def title_deltas(t: Tables) -> DataFrame:
    """Weeks of titles above the floor with the volume seven days before (by date, not by row), current titles only.

    New titles, and weeks without the one before, count in full. The first week of all, of which nothing is known, is left out.
    """
    w = Window.partitionBy("title_id").orderBy("week_end")
    x = title_floor(t).withColumn("ae", F.col("ae").cast(DOUBLE))
    x = x.withColumn("prev_ae", F.when(F.lag("week_end").over(w) == F.date_sub("week_end", 7), F.lag("ae").over(w)))
    x = x.withColumn("is_new", F.coalesce((F.col("first_sale_date") > F.date_sub("week_end", 7)) & (F.col("first_sale_date") <= F.col("week_end")), F.lit(False)))
    x = x.withColumn("delta", F.when(F.col("is_new") | F.col("prev_ae").isNull(), F.col("ae")).otherwise(F.col("ae") - F.col("prev_ae"))).drop("prev_ae")
    x = t.stored("title-deltas", lambda: x)
    first = x.agg(F.min("week_end").alias("first_week"))
    current = F.col("first_sale_date").isNull() | (F.col("first_sale_date") >= F.add_months("week_end", -CURRENT_MONTHS))
    return x.join(F.broadcast(first), F.col("week_end") > F.col("first_week")).filter(current).drop("first_week")  # one row


def gated(t: Tables, tau_delta: float = TAU_DELTA, tau_level: float = TAU_LEVEL, by_owner: dict[str, int] | None = None) -> DataFrame:
    """Titles that moved the market or hold a part of it: gate mover, anchor or both."""
    taus = TAU_LEVEL_BY_OWNER if by_owner is None else by_owner
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in taus.items() for v in kv]), F.col("owner")), F.lit(tau_level)) if taus else F.lit(tau_level)
    m = week_market(t).select("week_end", "market", (F.col("market") - F.col("prev_market")).alias("d_market"), "driver").filter("market > 0")
    x = title_deltas(t).join(m, "week_end").withColumn("share_bps", F.col("ae") / F.col("market") * 10000).withColumn("d_market_bps", F.col("delta") / F.col("market") * 10000)
    mover, anchor = F.abs("d_market_bps") >= tau_delta, F.col("share_bps") >= level
    x = x.withColumn("gate", F.when(mover & anchor, "both").when(mover, "mover").when(anchor, "anchor")).filter("gate is not null")
    return x.withColumn("sort_key", F.greatest(F.abs("share_bps"), F.abs("d_market_bps")))


NEW_SQL = "coalesce(a.first_sale_date > a.week_end - 7 AND a.first_sale_date <= a.week_end, FALSE)"
DELTA_SQL = f"CASE WHEN {NEW_SQL} OR b.ae IS NULL THEN CAST(a.ae AS DOUBLE) ELSE CAST(a.ae AS DOUBLE) - CAST(b.ae AS DOUBLE) END"
GATED_SQL = f"""{MARKET_SQL}, {FLOOR_SQL}, f0 AS (SELECT a.week_end, a.title_id, a.title, a.owner, a.first_sale_date, CAST(a.ae AS DOUBLE) AS ae, {DELTA_SQL} AS delta,
    {NEW_SQL} AS is_new FROM title_floor a LEFT JOIN title_floor b ON a.title_id = b.title_id AND b.week_end = a.week_end - 7
    WHERE a.week_end > (SELECT min(week_end) FROM title_floor) AND (a.first_sale_date IS NULL OR a.first_sale_date >= a.week_end - INTERVAL {CURRENT_MONTHS} MONTH)),
    g0 AS (SELECT f0.*, market, market - prev_market AS d_market, driver, ae / market * 10000 AS share_bps, delta / market * 10000 AS d_market_bps FROM f0 JOIN weeks USING (week_end) WHERE market > 0),
    g1 AS (SELECT *, abs(d_market_bps) >= 25 AS mover, share_bps >= CASE owner WHEN 'ASIA' THEN 40 WHEN 'EUROPE' THEN 60 ELSE 75 END AS anchor FROM g0),
    gated AS (SELECT *, CASE WHEN mover AND anchor THEN 'both' WHEN mover THEN 'mover' ELSE 'anchor' END AS gate, greatest(abs(share_bps), abs(d_market_bps)) AS sort_key FROM g1 WHERE mover OR anchor)"""


@query(f"WITH {GATED_SQL} SELECT week_end, title_id, owner, gate, is_new, round(share_bps, 6) AS share_bps, round(d_market_bps, 6) AS d_market_bps FROM gated")
def attr_titles_gated(t: Tables) -> DataFrame:
    return rounded(gated(t), "week_end", "title_id", "owner", "gate", "is_new", share_bps=6, d_market_bps=6)


def coverage(t: Tables, g: DataFrame | None = None) -> DataFrame:
    """By week: how many titles are named and how much of the market's move they explain; null where it hardly moved."""
    m = week_market(t).select("week_end", F.col("own_ae").alias("subject_ae"), (F.col("market") - F.col("prev_market")).alias("d_market"))
    g = (gated(t) if g is None else g).drop("d_market", "market").join(m.select("week_end", "d_market"), "week_end")
    is_mover, is_anchor = F.col("gate").isin("mover", "both"), F.col("gate").isin("anchor", "both")
    same = (F.abs("d_market") > 1) & (F.signum("delta") == F.signum("d_market")) & (F.col("delta") != 0)
    zero = F.lit(0).cast("decimal(18,4)")
    exact = F.col("delta").cast("decimal(18,4)")  # sums that do not depend on their order
    sums = g.groupBy("week_end").agg(
        F.sum(F.when(is_mover, 1).otherwise(0)).alias("n_movers"), F.sum(F.when(is_anchor, 1).otherwise(0)).alias("n_anchors"), F.count(F.lit(1)).alias("n_titles"), F.sum(exact).cast(DOUBLE).alias("listed"),
        F.sum(F.when(same, exact).otherwise(zero)).cast(DOUBLE).alias("same"), F.sum(F.when(same & is_mover, exact).otherwise(zero)).cast(DOUBLE).alias("mover_same"),
        F.sum(F.when(F.col("owner") == SUBJECT, F.col("ae").cast("decimal(18,4)")).otherwise(zero)).cast(DOUBLE).alias("subject"),
    )
    x = m.join(sums, "week_end", "left").na.fill(0, ["n_movers", "n_anchors", "n_titles", "same", "mover_same", "subject"])
    moved = F.abs("d_market") > 1
    part = lambda c: F.when(moved, F.least(F.lit(1.0), F.abs(c) / F.abs("d_market")))
    return x.select(
        "week_end", "n_movers", "n_anchors", "n_titles", F.round(F.when(moved, F.abs("listed") / F.abs("d_market")), 6).alias("cover"), F.round(part("same"), 6).alias("cover_same"),
        F.round(part("mover_same"), 6).alias("cover_mover_same"), F.round(F.when(F.col("subject_ae") > 0, F.col("subject") / F.col("subject_ae")), 6).alias("cover_subject"),
    )


COVERAGE_SQL = f"""{GATED_SQL}, c0 AS (SELECT *, abs(d_market) > 1 AND sign(delta) = sign(d_market) AND delta <> 0 AS same, CAST(delta AS DECIMAL(18,4)) AS dd FROM gated),
    c1 AS (SELECT week_end, CAST(sum(CASE WHEN gate IN ('mover', 'both') THEN 1 ELSE 0 END) AS BIGINT) AS n_movers, CAST(sum(CASE WHEN gate IN ('anchor', 'both') THEN 1 ELSE 0 END) AS BIGINT) AS n_anchors, CAST(count(*) AS BIGINT) AS n_titles,
    CAST(sum(dd) AS DOUBLE) AS listed, CAST(sum(CASE WHEN same THEN dd ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN same AND gate IN ('mover', 'both') THEN dd ELSE 0 END) AS DOUBLE) AS ms, CAST(sum(CASE WHEN owner = 'ASIA' THEN CAST(ae AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS subject FROM c0 GROUP BY 1),
    coverage AS (SELECT w.week_end, coalesce(n_movers, 0) AS n_movers, coalesce(n_anchors, 0) AS n_anchors, coalesce(n_titles, 0) AS n_titles, CASE WHEN abs(market - prev_market) > 1 THEN round(abs(listed) / abs(market - prev_market), 6) END AS cover,
    CASE WHEN abs(market - prev_market) > 1 THEN round(least(1.0, abs(coalesce(s, 0)) / abs(market - prev_market)), 6) END AS cover_same, CASE WHEN abs(market - prev_market) > 1 THEN round(least(1.0, abs(coalesce(ms, 0)) / abs(market - prev_market)), 6) END AS cover_mover_same,
    CASE WHEN own_ae > 0 THEN round(coalesce(subject, 0) / own_ae, 6) END AS cover_subject FROM weeks w LEFT JOIN c1 USING (week_end))"""


@query(f"WITH {COVERAGE_SQL} SELECT * FROM coverage")
def attr_coverage(t: Tables) -> DataFrame:
    return coverage(t)


@query(f"WITH {GATED_SQL} SELECT week_end, owner, CAST(count(*) AS BIGINT) AS titles, CAST(sum(CAST(ae AS DECIMAL(18,4))) AS DOUBLE) AS ae, CAST(count(*) FILTER (WHERE is_new) AS BIGINT) AS new_titles FROM gated GROUP BY ALL")
def attr_owner_cards(t: Tables) -> DataFrame:
    return gated(t).groupBy("week_end", "owner").agg(F.count(F.lit(1)).alias("titles"), F.sum(F.col("ae").cast("decimal(18,4)")).cast(DOUBLE).alias("ae"), F.count(F.when(F.col("is_new"), 1)).alias("new_titles"))


@query(f"WITH {MARKET_SQL} SELECT week_end, label, CAST(row_number() OVER (PARTITION BY week_end ORDER BY share DESC, label) AS BIGINT) AS pos FROM panel JOIN (SELECT week_end FROM weeks) USING (week_end)")
def attr_labels(t: Tables) -> DataFrame:
    w = Window.partitionBy("week_end").orderBy(F.desc("share"), "label")
    return t.panel.join(week_market(t).select("week_end"), "week_end", "left_semi").select("week_end", "label", F.row_number().over(w).cast("long").alias("pos"))


def in_order(x: DataFrame, subject: Column, driver: Column, keys: tuple[str, ...] = ("week_end",)) -> DataFrame:
    """Titles with lead or also and their place in the order in which the driver is explained. subject: whether the title is the owner's."""
    mover, anchor = F.col("gate").isin("mover", "both"), F.col("gate").isin("anchor", "both")
    grew, up, down = mover & (F.col("d_market_bps") > 0), driver.isin("outgrown", "market_up"), F.col("d_market_bps") < 0
    own, abs_d = driver.isin("own_up", "own_down"), -F.abs("d_market_bps")
    pri = (
        F.when(up, F.when(~subject & grew, 0).when(subject & mover, 1).otherwise(2))
        .when(driver == "held", F.when(subject & anchor, 0).when(down, 1).otherwise(2))
        .when(driver == "other_up", F.when(grew, 0).otherwise(1))
        .when(own, F.when(subject & mover, 0).when(mover, 1).otherwise(2))
        .when(driver == "market_down", F.when(down, 0).otherwise(1))
        .otherwise(0)
    )
    x = x.withColumn("pri", pri).withColumn("lead", F.when(driver == "held", F.col("pri") <= 1).otherwise(F.col("pri") == 0))
    x = x.withColumn("sec", F.when((driver == "held") & (F.col("pri") == 0), -F.col("share_bps")).otherwise(abs_d))
    w = Window.partitionBy(*keys).orderBy("pri", "sec", F.desc("sort_key"), "title_id")
    return x.withColumn("pos", F.row_number().over(w).cast("long")).withColumn("section", F.when(F.col("lead"), "lead").otherwise("also"))


def pack(t: Tables) -> DataFrame:
    return in_order(gated(t), F.col("owner") == SUBJECT, F.col("driver"))


PRIORITY_SQL = """CASE WHEN driver IN ('outgrown', 'market_up') THEN CASE WHEN NOT subj AND mv AND d_market_bps > 0 THEN 0 WHEN subj AND mv THEN 1 ELSE 2 END WHEN driver = 'held' THEN CASE WHEN subj AND an THEN 0 WHEN d_market_bps < 0 THEN 1 ELSE 2 END
    WHEN driver = 'other_up' THEN CASE WHEN mv AND d_market_bps > 0 THEN 0 ELSE 1 END WHEN driver IN ('own_up', 'own_down') THEN CASE WHEN subj AND mv THEN 0 WHEN mv THEN 1 ELSE 2 END WHEN driver = 'market_down' THEN CASE WHEN d_market_bps < 0 THEN 0 ELSE 1 END ELSE 0 END"""
ORDER_SQL = f"""p1 AS (SELECT *, {PRIORITY_SQL} AS pri FROM p0),
    p2 AS (SELECT *, CASE WHEN driver = 'held' THEN pri <= 1 ELSE pri = 0 END AS lead, CASE WHEN driver = 'held' AND pri = 0 THEN -share_bps ELSE -abs(d_market_bps) END AS sec FROM p1)"""


@query(f"""WITH {GATED_SQL}, p0 AS (SELECT *, gate IN ('mover', 'both') AS mv, gate IN ('anchor', 'both') AS an, owner = 'ASIA' AS subj FROM gated), {ORDER_SQL}
    SELECT week_end, title_id, driver, CASE WHEN lead THEN 'lead' ELSE 'also' END AS section, CAST(row_number() OVER (PARTITION BY week_end ORDER BY pri, sec, sort_key DESC, title_id) AS BIGINT) AS pos FROM p2""")
def attr_week_pack(t: Tables) -> DataFrame:
    return pack(t).select("week_end", "title_id", "driver", "section", "pos")


def tagged(x: DataFrame) -> DataFrame:
    """Whether the title is the subject's, whether its owner is reported by itself, and the tag that says so."""
    x = x.withColumn("is_subject", F.col("owner") == SUBJECT).withColumn("in_panel", F.col("owner").isin(*OWNERS))
    return x.withColumn("tag", F.when(F.col("is_subject"), "subject").when(F.col("in_panel"), "panel").otherwise("other"))


def title_facets(x: DataFrame, owner: str | None = None, in_panel: bool | None = None, is_subject: bool | None = None, gate: str | None = None, tag: str | None = None) -> DataFrame:
    """Titles that fit the facets that are given; ballast is an older name of the gate anchor."""
    gate = "anchor" if gate == "ballast" else gate
    for name, value in {"owner": owner, "in_panel": in_panel, "is_subject": is_subject, "gate": gate, "tag": tag}.items():
        if value is not None:
            x = x.filter(F.col(name) == F.lit(value))
    return x


@query(f"""WITH {GATED_SQL}, f AS (SELECT *, CASE WHEN owner = 'ASIA' THEN 'subject' WHEN owner IN ('AMERICA', 'ASIA', 'EUROPE') THEN 'panel' ELSE 'other' END AS tag FROM gated)
    SELECT 'ballast' AS facet, week_end, title_id, owner, gate, tag FROM f WHERE gate = 'anchor' UNION ALL SELECT 'panel movers', week_end, title_id, owner, gate, tag FROM f WHERE gate = 'mover' AND tag <> 'other'
    UNION ALL SELECT 'owner', week_end, title_id, owner, gate, tag FROM f WHERE owner = 'EUROPE' AND tag = 'panel' UNION ALL SELECT 'others', week_end, title_id, owner, gate, tag FROM f WHERE tag = 'other'""")
def attr_facets(t: Tables) -> DataFrame:
    """The titles of four choices of facets, side by side."""
    x = t.stored("gated", lambda: tagged(gated(t)))
    chosen = {"ballast": {"gate": "ballast"}, "panel movers": {"gate": "mover", "in_panel": True}, "owner": {"owner": "EUROPE", "is_subject": False, "tag": "panel"}, "others": {"tag": "other"}}
    parts = [title_facets(x, **facets).select(F.lit(name).alias("facet"), "week_end", "title_id", "owner", "gate", "tag") for name, facets in chosen.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def headline(driver: Column, owner: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in HEADLINES.items():
        out = F.when(driver == name, F.replace(F.lit(text), F.lit("{}"), owner)).otherwise(out)
    return out


HEADLINE_SQL = "CASE driver " + " ".join(f"WHEN '{d}' THEN replace('{x}', '{{}}', owner)" for d, x in HEADLINES.items()) + " END"
OWNER_SQL = "CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in OWNER_OF_LABEL.items()) + " END"


@query(f"""WITH {GATED_SQL}, o1 AS (SELECT week_end, {OWNER_SQL} AS owner, CAST(p.ae AS DOUBLE) AS own_ae, w.market, w.panel_ae, w.other_ae, CAST(p.ae AS DOUBLE) / w.market AS share FROM panel p JOIN weeks w USING (week_end)),
    o2 AS (SELECT *, lag(own_ae) OVER w AS prev_own, lag(market) OVER w AS prev_market, lag(panel_ae) OVER w AS prev_panel, lag(other_ae) OVER w AS prev_other, lag(share) OVER w AS prev_share FROM o1 WINDOW w AS (PARTITION BY owner ORDER BY week_end)),
    o3 AS (SELECT *, (share - prev_share) * 10000 AS d_share_bps, (own_ae - prev_own) / market * 10000 AS own_effect_bps, -prev_share * (market - prev_market) / market * 10000 AS market_effect_bps FROM o2),
    o4 AS (SELECT week_end, owner, {DRIVER_SQL} FROM o3), p0 AS (SELECT g.* EXCLUDE (driver, owner), o.driver, o.owner AS subject_owner, gate IN ('mover', 'both') AS mv, gate IN ('anchor', 'both') AS an, g.owner = o.owner AS subj FROM gated g JOIN o4 o USING (week_end)), {ORDER_SQL},
    ids AS (SELECT week_end, subject_owner AS owner, string_agg(CAST(title_id AS VARCHAR), ',' ORDER BY pri, sec, sort_key DESC, title_id) AS lead_ids FROM p2 WHERE lead GROUP BY ALL)
    SELECT week_end, owner, driver, {HEADLINE_SQL} AS headline, CASE WHEN owner = 'ASIA' THEN 'subject' ELSE 'panel' END AS tag, coalesce(lead_ids, '') AS lead_ids FROM o4 LEFT JOIN ids USING (week_end, owner)""")
def attr_owner_pack(t: Tables) -> DataFrame:
    """By week and owner: the driver of its share, its headline, and the titles that explain it, in their order.

    The titles of a week are those that pass its gate: a few dozen, as the market bounds them (at most 10000 / tau of them can hold tau).
    """
    owner = F.create_map(*[F.lit(x) for kv in OWNER_OF_LABEL.items() for x in kv])[F.col("label")]
    o = owner_weeks(t).select("week_end", owner.alias("subject_owner"), "driver")
    titles = t.stored("gated", lambda: tagged(gated(t))).drop("driver").join(o, "week_end")
    ordered = in_order(titles, F.col("owner") == F.col("subject_owner"), F.col("driver"), ("week_end", "subject_owner"))
    ids = ordered.filter("lead").groupBy("week_end", "subject_owner").agg(F.array_sort(F.collect_list(F.struct("pos", "title_id"))).alias("ids"))
    x = o.join(ids.select("week_end", "subject_owner", F.array_join(F.transform("ids", lambda i: i["title_id"].cast("string")), ",").alias("lead_ids")), ["week_end", "subject_owner"], "left")
    return x.select(
        "week_end", F.col("subject_owner").alias("owner"), "driver", headline(F.col("driver"), F.col("subject_owner")).alias("headline"),
        F.when(F.col("subject_owner") == SUBJECT, "subject").otherwise("panel").alias("tag"), F.coalesce("lead_ids", F.lit("")).alias("lead_ids"),
    )


#: Thresholds tried for an owner, coarsest first, and the one that is taken if none is enough.
TAU_GRID, TAU_FALLBACK = (100, 75, 60, 50, 40, 25), 25


@query(f"""WITH {GATED_SQL}, o1 AS (SELECT week_end, {OWNER_SQL} AS owner, CAST(p.ae AS DOUBLE) AS own_ae, w.market, w.panel_ae, w.other_ae, CAST(p.ae AS DOUBLE) / w.market AS share FROM panel p JOIN weeks w USING (week_end)),
    o2 AS (SELECT *, lag(own_ae) OVER w AS prev_own, lag(market) OVER w AS prev_market, lag(panel_ae) OVER w AS prev_panel, lag(other_ae) OVER w AS prev_other, lag(share) OVER w AS prev_share FROM o1 WINDOW w AS (PARTITION BY owner ORDER BY week_end)),
    o3 AS (SELECT *, (share - prev_share) * 10000 AS d_share_bps, (own_ae - prev_own) / market * 10000 AS own_effect_bps, -prev_share * (market - prev_market) / market * 10000 AS market_effect_bps FROM o2),
    held AS (SELECT week_end, owner FROM (SELECT week_end, owner, {DRIVER_SQL} FROM o3) JOIN (SELECT DISTINCT week_end FROM f0) USING (week_end) WHERE driver = 'held'),
    top AS (SELECT owner, week_end, max(share_bps) AS best FROM g0 GROUP BY ALL), x AS (SELECT owner, CAST(tau AS BIGINT) AS tau, count(*) AS held, count(*) FILTER (WHERE best >= tau) AS ok FROM held LEFT JOIN top USING (owner, week_end), (VALUES (100), (75), (60), (50), (40), (25)) g(tau) GROUP BY ALL),
    o AS (SELECT DISTINCT owner FROM o1) SELECT owner, CAST(coalesce(any_value(held), 0) AS BIGINT) AS held_weeks, CAST(coalesce(max(tau) FILTER (WHERE ok = held), CASE WHEN any_value(held) IS NULL THEN 100 ELSE {TAU_FALLBACK} END) AS BIGINT) AS tau_level FROM o LEFT JOIN x USING (owner) GROUP BY 1""")
def attr_tau_by_owner(t: Tables) -> DataFrame:
    """For each owner the coarsest threshold at which every week in which it held its share names a title of its own."""
    owner = F.create_map(*[F.lit(x) for kv in OWNER_OF_LABEL.items() for x in kv])[F.col("label")]
    deltas = title_deltas(t)
    o = owner_weeks(t).select("week_end", owner.alias("owner"), "driver")
    held = o.filter("driver = 'held'").join(deltas.select("week_end").distinct(), "week_end").select("owner", "week_end")
    m = week_market(t).filter("market > 0").select("week_end", "market")
    top = deltas.join(m, "week_end").groupBy("owner", "week_end").agg(F.max(F.col("ae") / F.col("market") * 10000).alias("best"))
    ok = [F.count(F.when(F.col("best") >= tau, 1)).alias(f"ok_{tau}") for tau in TAU_GRID]  # the grid is a few columns, not rows
    x = held.join(top, ["owner", "week_end"], "left").groupBy("owner").agg(F.count(F.lit(1)).alias("held"), *ok)
    level = F.coalesce(*[F.when(F.col(f"ok_{tau}") == F.col("held"), tau) for tau in TAU_GRID], F.when(F.col("held").isNull(), TAU_GRID[0]), F.lit(TAU_FALLBACK))
    return o.select("owner").distinct().join(x, "owner", "left").select("owner", F.coalesce("held", F.lit(0)).cast("long").alias("held_weeks"), level.cast("long").alias("tau_level"))


@query(f"""WITH {MARKET_SQL}, {FLOOR_SQL}, grid AS (SELECT d, l FROM (VALUES (15), (25), (40)) a(d), (VALUES (50), (75), (100)) b(l)),
    f0 AS (SELECT a.week_end, CAST(a.ae AS DOUBLE) AS ae, {DELTA_SQL} AS delta FROM title_floor a LEFT JOIN title_floor b ON a.title_id = b.title_id AND b.week_end = a.week_end - 7
    WHERE a.week_end > (SELECT min(week_end) FROM title_floor) AND (a.first_sale_date IS NULL OR a.first_sale_date >= a.week_end - INTERVAL {CURRENT_MONTHS} MONTH)),
    x AS (SELECT d, l, week_end, count(*) AS n FROM f0 JOIN weeks USING (week_end), grid WHERE abs(delta / market * 10000) >= d OR ae / market * 10000 >= l GROUP BY ALL)
    SELECT CAST(d AS BIGINT) AS tau_delta, CAST(l AS BIGINT) AS tau_level, CAST(sum(n) AS BIGINT) AS named, round(quantile_cont(n, 0.9), 4) AS p90 FROM x GROUP BY ALL""")
def attr_tau_grid(t: Tables) -> DataFrame:
    """How many titles each pair of thresholds names: all pairs in one pass over the titles."""
    grid = t.spark.createDataFrame([(d, lv) for d in (15, 25, 40) for lv in (50, 75, 100)], "tau_delta bigint, tau_level bigint")
    m = week_market(t).select("week_end", "market")
    x = title_deltas(t).join(m, "week_end").crossJoin(F.broadcast(grid))  # nine rows
    named = x.filter((F.abs(F.col("delta") / F.col("market") * 10000) >= F.col("tau_delta")) | (F.col("ae") / F.col("market") * 10000 >= F.col("tau_level")))
    n = named.groupBy("tau_delta", "tau_level", "week_end").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("tau_delta", "tau_level").agg(F.sum("n").alias("named"), F.round(F.expr("percentile(n, 0.9)"), 4).alias("p90"))
