"""Share reports over the weekly panel: actuals, year-to-date variants, overlays, scrubbing and injection scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import columns as C
from ..functions import windows as W
from ..sources.tables import ANCHOR, Tables
from .registry import query

DOUBLE = "double"
#: Half width of the forecast's band in points of share; floor and gate of injected titles.
BAND, INJECTION_FLOOR, INJECTION_GATE = 0.82, 20_000, 75_000
FORECAST_FROM = "2001-01-01"


def by_label() -> WindowSpec:
    return Window.partitionBy("label", "year").orderBy("week_end")


def panel(t: Tables) -> DataFrame:
    return t.panel.withColumn("ae", F.col("ae").cast(DOUBLE))


def anchor_market(t: Tables) -> DataFrame:
    return panel(t).filter(F.col("label") == ANCHOR).select("week_end", (F.col("ae") / F.col("share")).alias("market"))


ANCHOR_SQL = "mk AS (SELECT week_end, CAST(ae AS DOUBLE) / share AS market FROM panel WHERE label = 'BUILDING')"


@query(f"WITH {ANCHOR_SQL} SELECT label, week_end, round(CAST(sum(ae) OVER w AS DOUBLE) / sum(market) OVER w * 100, 4) AS ytd_share FROM panel JOIN mk USING (week_end) WINDOW w AS (PARTITION BY label, year ORDER BY week_end)")
def share_ytd_anchor(t: Tables) -> DataFrame:
    x = t.panel.join(anchor_market(t), "week_end")
    return x.select("label", "week_end", F.round(W.running_sum(F.col("ae"), by_label()).cast(DOUBLE) / W.running_sum(F.col("market"), by_label()) * 100, 4).alias("ytd_share"))


@query("""WITH m AS (SELECT week_end, median(CAST(ae AS DOUBLE) / share) AS market FROM panel WHERE share > 0 GROUP BY 1)
    SELECT label, week_end, floor(CAST(sum(ae) OVER w AS DOUBLE) / sum(market) OVER w * 100 * 100 + 1e-9) / 100 AS ytd_share FROM panel JOIN m USING (week_end) WINDOW w AS (PARTITION BY label, year ORDER BY week_end)""")
def share_ytd_median(t: Tables) -> DataFrame:
    """The older report: market as the median over all labels, the share cut to two decimals."""
    m = panel(t).filter("share > 0").groupBy("week_end").agg(F.median(F.col("ae") / F.col("share")).alias("market"))
    x = t.panel.join(m, "week_end")
    return x.select("label", "week_end", C.trunc2(W.running_sum(F.col("ae"), by_label()).cast(DOUBLE) / W.running_sum(F.col("market"), by_label()) * 100).alias("ytd_share"))


def forecast_rows(t: Tables) -> DataFrame:
    """A naive forecast: the share of 52 weeks before."""
    before = panel(t).select("label", F.date_add("week_end", 364).alias("week_end"), F.col("share").alias("forecast"), (F.col("ae") / F.col("share")).alias("forecast_market"))
    return before.filter(F.col("week_end") >= FORECAST_FROM).filter("forecast > 0")


@query(f"""WITH f AS (SELECT label, CAST(week_end + 364 AS DATE) AS week_end, share * 100 AS forecast, CAST(ae AS DOUBLE) / share AS fm FROM panel WHERE share > 0), g AS (SELECT * FROM f WHERE week_end >= DATE '{FORECAST_FROM}'),
    x AS (SELECT g.label, g.week_end, coalesce(p.share * 100, forecast) AS s, coalesce(CAST(p.ae AS DOUBLE) / nullif(p.share, 0), fm) AS m, CASE WHEN p.share IS NULL THEN 'Forecast' ELSE 'Actual' END AS kind FROM g LEFT JOIN panel p ON p.label = g.label AND p.week_end = g.week_end),
    y AS (SELECT *, round(sum(s * m) OVER w / sum(m) OVER w, 4) AS ytd FROM x WINDOW w AS (PARTITION BY label ORDER BY week_end))
    SELECT label, week_end, kind, ytd, CASE WHEN kind = 'Forecast' THEN round(ytd + {BAND}, 4) ELSE ytd END AS upper, CASE WHEN kind = 'Forecast' THEN round(ytd - {BAND}, 4) ELSE ytd END AS lower FROM y""")
def share_overlay(t: Tables) -> DataFrame:
    """Forecast rows with actuals where there are any; year to date over both, bands for forecasts only."""
    actual = panel(t).select("label", "week_end", (F.col("share") * 100).alias("actual"), (F.col("ae") / F.nullif(F.col("share"), F.lit(0.0))).alias("actual_market"))
    x = forecast_rows(t).join(actual, ["label", "week_end"], "left")
    x = x.withColumn("kind", F.when(F.col("actual").isNull(), "Forecast").otherwise("Actual")).withColumn("s", F.coalesce("actual", F.col("forecast") * 100)).withColumn("m", F.coalesce("actual_market", "forecast_market"))
    w = Window.partitionBy("label").orderBy("week_end")
    x = x.withColumn("ytd", F.round(W.running_sum(F.col("s") * F.col("m"), w) / W.running_sum(F.col("m"), w), 4))
    band = F.when(F.col("kind") == "Forecast", F.lit(BAND)).otherwise(F.lit(0.0))
    return x.select("label", "week_end", "kind", "ytd", F.round(F.col("ytd") + band, 4).alias("upper"), F.round(F.col("ytd") - band, 4).alias("lower"))


@query(f"""WITH f AS (SELECT week_end AS w0, title_id, CAST(ae AS DOUBLE) AS ae FROM title_weeks), s AS (SELECT title_id, first_sale_date AS street FROM titles),
    c AS (SELECT title_id, street, w0, ae, lead(w0) OVER w AS w1, lead(ae) OVER w AS ae1 FROM s JOIN f USING (title_id) WHERE w0 >= street WINDOW w AS (PARTITION BY title_id ORDER BY w0)),
    k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY w0) = 1)
    SELECT title_id, CASE WHEN w1 = w0 + 7 AND ae1 > 0 AND ae <= 0.1 * ae1 THEN w1 ELSE w0 END AS week_end, CASE WHEN w1 = w0 + 7 AND ae1 > 0 AND ae <= 0.1 * ae1 THEN ae1 ELSE ae END AS first_week, coalesce(w1 = w0 + 7 AND ae1 > 0 AND ae <= 0.1 * ae1, FALSE) AS skipped_stub FROM k""")
def first_week_resolver(t: Tables) -> DataFrame:
    """The chart week of the street date; the next one if it follows at once and this is a stub of at most a tenth of it."""
    streets = t.titles.select("title_id", F.col("first_sale_date").alias("street"))
    return first_weeks(t.title_weeks.select("title_id", "week_end", F.col("ae").cast(DOUBLE).alias("ae")), streets)


@query()
def first_week_resolver_all(t: Tables) -> DataFrame:
    """The same as ``first_week_resolver``, kept under its older name."""
    streets = t.titles.select("title_id", F.col("first_sale_date").alias("street"))
    return first_weeks(t.title_weeks.select("title_id", "week_end", F.col("ae").cast(DOUBLE).alias("ae")), streets)


def first_weeks(weeks: DataFrame, streets: DataFrame, stub: float = 0.1) -> DataFrame:
    w = Window.partitionBy("title_id").orderBy("week_end")
    x = weeks.join(streets, "title_id").filter("week_end >= street").withColumn("w1", F.lead("week_end").over(w)).withColumn("ae1", F.lead("ae").over(w))
    k = W.top_n_per_group(x, ["title_id"], [F.col("week_end")])
    skip = F.coalesce((F.col("w1") == F.date_add("week_end", 7)) & (F.col("ae1") > 0) & (F.col("ae") <= stub * F.col("ae1")), F.lit(False))
    return k.select("title_id", F.when(skip, F.col("w1")).otherwise(F.col("week_end")).alias("week_end"), F.when(skip, F.col("ae1")).otherwise(F.col("ae")).alias("first_week"), skip.alias("skipped_stub"))


@query("""WITH l AS (SELECT week_end, CAST(sum(CASE WHEN level_1 = 'ASIA' THEN ae ELSE 0 END) AS DOUBLE) AS own, CAST(sum(ae) AS DOUBLE) AS market FROM title_weeks LEFT JOIN owners USING (title_id) WHERE ae >= 75000 GROUP BY 1),
    p AS (SELECT week_end, CAST(sum(CASE WHEN label = 'BUILDING' THEN ae END) AS DOUBLE) AS own_ae, CAST(sum(ae) AS DOUBLE) AS total FROM panel GROUP BY 1)
    SELECT week_end, round(own_ae - coalesce(own, 0), 4) AS base_ae, round(total - coalesce(market, 0), 4) AS base_market, round((own_ae - coalesce(own, 0)) / nullif(total - coalesce(market, 0), 0), 6) AS base_share FROM p LEFT JOIN l USING (week_end) WHERE week_end >= (SELECT min(week_end) FROM l)""")
def scrub_alist(t: Tables) -> DataFrame:
    """Share without the large titles, from the first week on for which they are known."""
    from .domain import LARGE, sums

    rows = t.title_weeks.filter(F.col("ae") >= LARGE).join(t.owners, "title_id", "left")
    large = rows.groupBy("week_end").agg(*sums("ae", "level_1", {"ASIA": "own"}), F.sum("ae").cast(DOUBLE).alias("market"))
    p = t.panel.groupBy("week_end").agg(F.sum(F.when(F.col("label") == ANCHOR, F.col("ae"))).cast(DOUBLE).alias("own_ae"), F.sum("ae").cast(DOUBLE).alias("total"))
    first = large.agg(F.min("week_end").alias("first_week"))
    x = p.join(F.broadcast(first), F.col("week_end") >= F.col("first_week")).join(large, "week_end", "left").na.fill(0, ["own", "market"])  # one row
    base, rest = F.col("own_ae") - F.col("own"), F.col("total") - F.col("market")
    return x.select("week_end", F.round(base, 4).alias("base_ae"), F.round(rest, 4).alias("base_market"), F.round(base / F.nullif(rest, F.lit(0.0)), 6).alias("base_share"))


@query("""WITH x AS (SELECT label, week_end, CAST(ae AS DOUBLE) AS ae, lag(CAST(ae AS DOUBLE), 1) OVER w AS l1, lag(CAST(ae AS DOUBLE), 2) OVER w AS l2 FROM panel WINDOW w AS (PARTITION BY label ORDER BY week_end))
    SELECT label, week_end, CAST(ae > 1.5 * l1 AS BIGINT) AS spike, CAST(l1 > 1.5 * l2 AS BIGINT) AS spike_before FROM x WHERE l2 IS NOT NULL""")
def share_spikes(t: Tables) -> DataFrame:
    w = Window.partitionBy("label").orderBy("week_end")
    x = panel(t).select("label", "week_end", "ae", F.lag("ae", 1).over(w).alias("l1"), F.lag("ae", 2).over(w).alias("l2")).filter("l2 is not null")
    return x.select("label", "week_end", (F.col("ae") > 1.5 * F.col("l1")).cast("long").alias("spike"), (F.col("l1") > 1.5 * F.col("l2")).cast("long").alias("spike_before"))


@query(f"""WITH k AS (SELECT title_id FROM title_weeks GROUP BY 1 HAVING max(ae) >= {INJECTION_GATE}), i AS (SELECT week_end, coalesce(level_1, 'Other') AS owner, CAST(sum(greatest(ae - {INJECTION_FLOOR}, 0)) AS DOUBLE) AS injected FROM title_weeks JOIN k USING (title_id) LEFT JOIN owners USING (title_id) GROUP BY ALL),
    m AS (SELECT week_end, CAST(sum(ae) AS DOUBLE) AS total FROM panel GROUP BY 1), a AS (SELECT week_end, sum(injected) AS all_injected FROM i GROUP BY 1)
    SELECT week_end, owner, round(injected, 4) AS injected, round(injected / (total + all_injected), 8) AS share FROM i JOIN m USING (week_end) JOIN a USING (week_end)""")
def injection_scenario(t: Tables) -> DataFrame:
    """What titles of a peak above the gate add beyond the floor, by owner, with the market grown by it."""
    known = t.title_weeks.groupBy("title_id").agg(F.max("ae").alias("peak")).filter(F.col("peak") >= INJECTION_GATE).select("title_id")
    rows = t.title_weeks.join(known, "title_id", "left_semi").join(t.owners, "title_id", "left")
    i = rows.groupBy("week_end", F.coalesce("level_1", F.lit("Other")).alias("owner")).agg(F.sum(F.greatest(F.col("ae") - INJECTION_FLOOR, F.lit(0).cast("decimal(18,4)"))).cast(DOUBLE).alias("injected"))
    m, a = t.panel.groupBy("week_end").agg(F.sum("ae").cast(DOUBLE).alias("total")), i.groupBy("week_end").agg(F.sum("injected").alias("all_injected"))
    x = i.join(m, "week_end").join(a, "week_end")
    return x.select("week_end", "owner", F.round("injected", 4).alias("injected"), F.round(F.col("injected") / (F.col("total") + F.col("all_injected")), 8).alias("share"))


@query("""WITH q AS (SELECT CAST(year(day) + CASE WHEN month(day) >= 9 THEN 1 ELSE 0 END AS BIGINT) AS fy, CAST(ceil(((month(day) + 3) % 12 + 1) / 3.0) AS BIGINT) AS fq, label, CAST(sum(ae) AS DOUBLE) AS ae FROM order_rows GROUP BY ALL)
    SELECT b.fq, b.label, b.ae AS comparison, a.ae AS baseline, round(b.ae / nullif(a.ae, 0) - 1, 6) AS growth FROM q b LEFT JOIN q a ON a.fq = b.fq AND a.label = b.label AND a.fy = b.fy - 1 WHERE b.fy = 2000""")
def share_period_comparison(t: Tables) -> DataFrame:
    q = t.orders.groupBy(C.fiscal_year("day").alias("fy"), C.fiscal_quarter("day").alias("fq"), "label").agg(F.sum("ae").cast(DOUBLE).alias("ae"))
    a = q.filter("fy = 1999").select("fq", "label", F.col("ae").alias("baseline"))
    return q.filter("fy = 2000").join(a, ["fq", "label"], "left").select("fq", "label", F.col("ae").alias("comparison"), "baseline", F.round(F.col("ae") / F.nullif(F.col("baseline"), F.lit(0.0)) - 1, 6).alias("growth"))


@query("SELECT nation_id, label, CAST(year(day) AS BIGINT) AS y, CAST(sum(ae) AS DOUBLE) AS ae FROM order_rows WHERE lower(label) = 'building' AND day BETWEEN DATE '1997-03-01' AND DATE '1999-02-28' GROUP BY ALL")
def share_platform_query(t: Tables) -> DataFrame:
    """Optional facets: a label in any case, a date range; a facet not given filters nothing."""
    from ..operators.relational import facets

    rows = facets(t.orders, {"label": " Building ", "status": None}, {"day": "1997-03-01"}, {"day": "1999-02-28"})
    return rows.groupBy("nation_id", "label", F.year("day").cast("long").alias("y")).agg(F.sum("ae").cast(DOUBLE).alias("ae"))


#: Fixed value: revenue of a stream.
REVENUE = 0.004
#: Datasets of the platform report: the service, and the level at which labels are reported.
PLATFORMS = {"on demand by owner": ("OnDemand", "level_1"), "on demand by label": ("OnDemand", "level_2"), "programmed by owner": ("Programmed", "level_1"), "programmed by label": ("Programmed", "level_2")}


def platform_sql(name: str, service: str, level: str) -> str:
    return f"""SELECT '{name}' AS dataset, date_trunc('month', report_date)::DATE AS period, {level} AS bucket, CAST(sum(quantity) AS DOUBLE) AS streams FROM daily_fact JOIN suppliers USING (product_id) WHERE category = 'Streams' AND service = '{service}' GROUP BY ALL"""


@query(f"""WITH x AS ({' UNION ALL '.join(platform_sql(n, *v) for n, v in PLATFORMS.items())}), y AS (SELECT *, sum(streams) OVER (PARTITION BY dataset, period) AS total FROM x), z AS (SELECT *, streams / total * 100 AS share FROM y),
    g AS (SELECT a.*, b.share AS prev_share, b.total AS prev_total FROM z a LEFT JOIN z b ON b.dataset = a.dataset AND b.bucket = a.bucket AND b.period = CAST(a.period - INTERVAL 1 YEAR AS DATE))
    SELECT dataset, period, bucket, CAST(streams AS BIGINT) AS streams, CAST(total AS BIGINT) AS total, round(share, 6) AS share, round(streams * {REVENUE}, 4) AS revenue, round((share - prev_share) * 100, 4) AS share_change_bps,
    round((share - prev_share) / prev_share * 100, 6) AS share_growth, round((total - prev_total) / prev_total * 100, 6) AS market_growth, round((share - prev_share) / prev_share * 100 + (total - prev_total) / prev_total * 100, 6) AS total_growth FROM g""")
def share_platforms(t: Tables) -> DataFrame:
    """The four datasets of the platform report by month: streams, share and revenue of each label, with growth over the same month a year before."""
    month = F.trunc("report_date", "MM").alias("period")
    parts = []
    for name, (service, level) in PLATFORMS.items():
        rows = t.facts("Streams", service).join(t.suppliers, "product_id")
        parts.append(rows.groupBy(month, F.col(level).alias("bucket")).agg(F.sum("quantity").alias("streams")).select(F.lit(name).alias("dataset"), "*"))
    x = reduce(DataFrame.unionByName, parts)
    x = x.withColumn("total", F.sum("streams").over(Window.partitionBy("dataset", "period"))).withColumn("share", F.col("streams") / F.col("total") * 100)
    before = x.select("dataset", "bucket", F.add_months("period", 12).alias("period"), F.col("share").alias("prev_share"), F.col("total").alias("prev_total"))
    g = x.join(before, ["dataset", "bucket", "period"], "left")
    share, market = (F.col("share") - F.col("prev_share")) / F.col("prev_share") * 100, (F.col("total") - F.col("prev_total")) / F.col("prev_total") * 100
    return g.select(
        "dataset", "period", "bucket", "streams", "total", F.round("share", 6).alias("share"), F.round(F.col("streams") * REVENUE, 4).alias("revenue"), F.round((F.col("share") - F.col("prev_share")) * 100, 4).alias("share_change_bps"),
        F.round(share, 6).alias("share_growth"), F.round(market, 6).alias("market_growth"), F.round(share + market, 6).alias("total_growth"),
    )


def share_platform_dataset(t: Tables, dataset: str, bucket: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """One dataset of the platform report, for a label in any case and a range of months."""
    from ..operators.relational import facets

    return facets(share_platforms(t).filter(F.col("dataset") == dataset), {"bucket": bucket}, {"period": since}, {"period": until})
