"""Scans, filters, projections, joins, aggregations, windows, sorting, set operations and scalars, one query for each."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import windows as W
from ..functions.folding import folded
from ..operators import relational as R
from ..operators.ordered import counts_between
from ..sources.tables import LABELS, Tables
from .registry import query

DOUBLE = "double"


@query("SELECT title_id, category, report_date, quantity FROM daily_fact WHERE category IN ('Streams', 'ProductSales') AND service = 'OnDemand' AND report_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
def scan_filter_inlist(t: Tables) -> DataFrame:
    f = t.facts(("Streams", "ProductSales"), "OnDemand")
    return f.filter(f.report_date.between("1997-01-01", "1998-06-30")).select("title_id", "category", "report_date", "quantity")


@query("SELECT title_id, title, release_type FROM titles WHERE title NOT LIKE '%bolt%' AND release_type NOT IN ('PROMO', 'SMALL') AND title ILIKE '%RED%'")
def scan_not_like(t: Tables) -> DataFrame:
    x = t.titles
    return x.filter(~x.title.like("%bolt%") & ~x.release_type.isin("PROMO", "SMALL") & x.title.ilike("%RED%")).select("title_id", "title", "release_type")


@query(r"SELECT title_id, artist FROM titles WHERE artist LIKE 'Brand\#1%' ESCAPE '\'")
def scan_like_escape(t: Tables) -> DataFrame:
    return t.titles.filter(F.col("artist").like(C.like_literal("Brand#1") + "%")).select("title_id", "artist")


@query(r"SELECT 'document' AS kind, doc_id AS id FROM documents WHERE text LIKE '%\%\%\%%' ESCAPE '\' UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE n_name ILIKE 'nation\_1%' ESCAPE '\'")
def scan_like_wildcards(t: Tables) -> DataFrame:
    """A text that is asked for may hold the wildcards themselves: they are escaped."""
    d = t.raw("documents").filter(F.col("text").like("%" + C.like_literal("%%%") + "%")).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    n = t.raw("nation").filter(F.col("n_name").ilike(C.like_literal("nation_1") + "%")).select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"))
    return d.unionByName(n)


@query("""SELECT product_id, CASE WHEN level_2 = 'NATION_3' THEN 'NATION_1' WHEN level_2 IN ('NATION_1', 'NATION_2') THEN level_2 ELSE coalesce(level_1, 'Unknown') END AS owner,
    CASE WHEN level_2 IN ('NATION_1', 'NATION_2') THEN level_2 ELSE coalesce(level_1, 'Unknown') END AS owner_unmerged FROM suppliers""")
def case_owner(t: Tables) -> DataFrame:
    named = ("NATION_1", "NATION_2")
    return t.suppliers.select("product_id", C.owner_case("level_1", "level_2", named, {"NATION_3": "NATION_1"}).alias("owner"), C.owner_case("level_1", "level_2", named).alias("owner_unmerged"))


@query("""SELECT title_id, CASE WHEN street <= DATE '1996-01-05' THEN street ELSE coalesce(first_sale_date, street) END AS effective_date
    FROM (SELECT title_id, first_sale_date, DATE '1996-01-01' + CAST(title_id % 10 AS INTEGER) AS street FROM titles)""")
def effective_date(t: Tables) -> DataFrame:
    x = t.titles.withColumn("street", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("title_id") % 10).cast("int")))
    return x.select("title_id", C.effective_release_date("street", "first_sale_date", "1996-01-05").alias("effective_date"))


@query("SELECT title_id, coalesce(nullif(trim(CASE WHEN title_id % 3 = 0 THEN ' ' ELSE release_type END), ''), 'Album') AS release_type FROM titles")
def text_default(t: Tables) -> DataFrame:
    return t.titles.select("title_id", C.text_or(F.when(F.col("title_id") % 3 == 0, " ").otherwise(F.col("release_type")), "Album").alias("release_type"))


WIDE_SQL = "wide AS (SELECT week_end, " + ", ".join(f"sum(CASE WHEN label = '{x}' THEN ae ELSE 0 END) AS {x.lower()}" for x in LABELS) + " FROM panel GROUP BY week_end)"


def wide_panel(t: Tables) -> DataFrame:
    return t.panel.groupBy("week_end").agg(*[F.sum(F.when(F.col("label") == x, F.col("ae")).otherwise(F.lit(0).cast("decimal(28,2)"))).alias(x.lower()) for x in LABELS])


@query(f"WITH {WIDE_SQL} SELECT week_end, " + ", ".join(f"CAST({x.lower()} AS DOUBLE) AS {x.lower()}" for x in LABELS) + " FROM wide")
def pivot_labels(t: Tables) -> DataFrame:
    return wide_panel(t).select("week_end", *(F.col(x.lower()).cast(DOUBLE).alias(x.lower()) for x in LABELS))


@query(f"WITH {WIDE_SQL} SELECT week_end, upper(label) AS label, CAST(ae AS DOUBLE) AS ae, CAST(ae > 1000000 AS BIGINT) AS big FROM (UNPIVOT wide ON {', '.join(x.lower() for x in LABELS)} INTO NAME label VALUE ae)")
def unpivot_labels(t: Tables) -> DataFrame:
    names = [x.lower() for x in LABELS]
    long = wide_panel(t).unpivot("week_end", names, "label", "ae")
    return long.select("week_end", F.upper("label").alias("label"), F.col("ae").cast(DOUBLE).alias("ae"), (F.col("ae") > 1_000_000).cast("long").alias("big"))


@query("SELECT d.week_end, r.level_1, CAST(sum(d.quantity) AS BIGINT) AS quantity FROM daily_fact d JOIN suppliers r USING (product_id) JOIN titles t USING (title_id) WHERE t.release_type = 'ECONOMY' GROUP BY ALL")
def join_inner_chain(t: Tables) -> DataFrame:
    chosen = t.titles.filter("release_type = 'ECONOMY'").select("title_id")
    return t.daily_fact.join(t.suppliers, "product_id").join(chosen, "title_id").groupBy("week_end", "level_1").agg(F.sum("quantity").alias("quantity"))


@query("SELECT t.title_id, CAST(coalesce(sum(d.quantity), 0) AS BIGINT) AS quantity FROM titles t LEFT JOIN daily_fact d ON d.title_id = t.title_id AND d.category = 'Streams' AND d.report_date >= DATE '2001-06-01' GROUP BY t.title_id")
def join_left_on_filter(t: Tables) -> DataFrame:
    recent = t.facts("Streams").filter("report_date >= date'2001-06-01'").select("title_id", "quantity")
    return t.titles.select("title_id").join(recent, "title_id", "left").groupBy("title_id").agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"))


@query("SELECT o.title_id, o.product_id, o.units FROM ownership o WHERE EXISTS (SELECT 1 FROM title_weeks w WHERE w.title_id = o.title_id AND w.ae >= 150000)")
def join_semi_exists(t: Tables) -> DataFrame:
    return t.ownership.select("title_id", "product_id", "units").join(t.title_weeks.filter("ae >= 150000"), "title_id", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(t: Tables) -> DataFrame:
    pending = t.raw("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.raw("customer").select("c_custkey").join(pending, "c_custkey", "left_anti")


@query("SELECT title_id, CAST(count(*) AS BIGINT) AS n FROM daily_fact WHERE title_id IN (3, 5, 8, 13, 21, 34, 55, 89) GROUP BY 1")
def join_id_list(t: Tables) -> DataFrame:
    return R.with_ids(t.daily_fact, "title_id", (3, 5, 8, 13, 21, 34, 55, 89)).groupBy("title_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT year(day) AS y, month(day) AS m, label, sum(ae) AS ae FROM order_rows GROUP BY ALL), b AS (SELECT y, m, sum(ae) AS total FROM a GROUP BY ALL)
    SELECT CAST(a.y AS BIGINT) AS y, CAST(a.m AS BIGINT) AS m, label, round(CAST(ae AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share FROM a JOIN b ON a.y = b.y AND a.m = b.m""")
def join_composite(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.year("day").cast("long").alias("y"), F.month("day").cast("long").alias("m"), "label").agg(F.sum("ae").alias("ae"))
    b = a.groupBy("y", "m").agg(F.sum("ae").alias("total"))
    return a.join(b, ["y", "m"]).select("y", "m", "label", F.round(F.col("ae").cast(DOUBLE) / F.col("total").cast(DOUBLE), 6).alias("share"))


@query("SELECT t.title_id, w.week_end, CAST(w.ae AS DOUBLE) AS ae FROM titles t JOIN title_weeks w ON w.title_id = t.title_id AND t.first_sale_date BETWEEN w.week_end - 7 AND w.week_end")
def join_range_debut(t: Tables) -> DataFrame:
    """Weeks of a debut: eight days, both ends included, so a Thursday counts for two."""
    both = t.titles.select("title_id", "first_sale_date").join(t.title_weeks, "title_id")
    return both.filter(F.col("first_sale_date").between(F.date_sub("week_end", 7), F.col("week_end"))).select("title_id", "week_end", F.col("ae").cast(DOUBLE).alias("ae"))


@query("SELECT a.title_id, a.week_end, CAST(a.ae AS DOUBLE) AS ae, CAST(b.ae AS DOUBLE) AS prev_ae FROM title_weeks a LEFT JOIN title_weeks b ON a.title_id = b.title_id AND b.week_end = a.week_end - 7 WHERE a.ae >= 100000")
def join_date_shift(t: Tables) -> DataFrame:
    """The week before by date: null if the title has a gap."""
    before = t.title_weeks.select("title_id", F.date_add("week_end", 7).alias("week_end"), F.col("ae").cast(DOUBLE).alias("prev_ae"))
    return t.title_weeks.filter("ae >= 100000").join(before, ["title_id", "week_end"], "left").select("title_id", "week_end", F.col("ae").cast(DOUBLE).alias("ae"), "prev_ae")


def title_artists(t: Tables) -> DataFrame:
    """Products of a title as an array of (product, role) by identifier; the one with most units is the main one."""
    rank = F.row_number().over(Window.partitionBy("title_id").orderBy(F.col("units").desc(), "product_id"))
    role = F.when(F.col("rn") == 1, "main").otherwise("guest")
    rows = t.ownership.select("title_id", "product_id", "units").withColumn("rn", rank)
    return rows.groupBy("title_id").agg(F.array_sort(F.collect_list(F.struct("product_id", role.alias("role")))).alias("artists"))


ARTISTS_SQL = "artists AS (SELECT title_id, list({'product_id': product_id, 'role': CASE WHEN rn = 1 THEN 'main' ELSE 'guest' END} ORDER BY product_id) AS artists FROM (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY units DESC, product_id) AS rn FROM ownership) GROUP BY title_id)"


@query(f"WITH {ARTISTS_SQL}, f AS (SELECT title_id, unnest(artists) AS a, generate_subscripts(artists, 1) - 1 AS pos FROM artists) SELECT title_id, CAST(pos AS BIGINT) AS pos, a.product_id AS product_id, a.role AS role FROM f")
def join_explode_index(t: Tables) -> DataFrame:
    x = title_artists(t).select("title_id", F.posexplode("artists").alias("pos", "a"))
    return x.select("title_id", F.col("pos").cast("long").alias("pos"), "a.product_id", "a.role")


@query(f"WITH {ARTISTS_SQL} SELECT title_id, list_filter(artists, lambda x: x.role = 'main')[1].product_id AS main_id, CAST(len(artists) AS BIGINT) AS n FROM artists")
def arr_filter_get(t: Tables) -> DataFrame:
    return title_artists(t).select("title_id", F.get(F.filter("artists", lambda x: x["role"] == "main"), 0)["product_id"].alias("main_id"), F.size("artists").cast("long").alias("n"))


@query("WITH latest AS (SELECT max(week_end) AS week_end FROM panel) SELECT label, CAST(ae AS DOUBLE) AS ae FROM panel JOIN latest USING (week_end)")
def join_single_row(t: Tables) -> DataFrame:
    latest = t.panel.agg(F.max("week_end").alias("week_end"))
    return t.panel.join(latest, "week_end").select("label", F.col("ae").cast(DOUBLE).alias("ae"))


@query("SELECT label, CASE label WHEN 'BUILDING' THEN 40.0::DOUBLE WHEN 'MACHINERY' THEN 60.0::DOUBLE ELSE 75.0::DOUBLE END AS tau, CAST(count(*) AS BIGINT) AS n FROM panel GROUP BY ALL")
def join_map_lookup(t: Tables) -> DataFrame:
    taus = F.create_map(F.lit("BUILDING"), F.lit(40.0), F.lit("MACHINERY"), F.lit(60.0))
    return t.panel.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.coalesce(F.element_at(taus, F.col("label")), F.lit(75.0)).alias("tau"), "n")


@query("""WITH last AS (SELECT label, max(week_end) AS d FROM panel GROUP BY 1) SELECT label, CAST(d + CAST(7 * k AS INTEGER) AS DATE) AS week_end FROM last, range(1, 79) r(k)""")
def join_horizon_grid(t: Tables) -> DataFrame:
    last = t.panel.groupBy("label").agg(F.max("week_end").alias("d"))
    return R.week_grid(t.spark, last, "d", 78).select("label", "week_end")


@query("""WITH tot AS (SELECT title_id, sum(ae) AS ae FROM daily_fact GROUP BY 1), c AS (SELECT title_id, ae, floor(log10(CAST(ae AS DOUBLE)) / 0.05) AS b FROM tot WHERE title_id % 20 = 0)
    SELECT a.title_id, CAST(count(b.title_id) AS BIGINT) AS near FROM c a JOIN tot b ON b.title_id <> a.title_id AND b.ae BETWEEN CAST(a.ae AS DOUBLE) / 1.05 AND CAST(a.ae AS DOUBLE) * 1.05 GROUP BY 1""")
def join_range_band(t: Tables) -> DataFrame:
    """Titles with a volume within a factor: a search, asked for every title whose number is divisible by 20 against all."""
    tot = title_volumes(t)
    return within_factor(tot.filter("title_id % 20 = 0"), tot)


@query()
def join_range_band_all(t: Tables) -> DataFrame:
    """The same for every title that has others within the factor."""
    tot = title_volumes(t)
    return within_factor(tot, tot)


def title_volumes(t: Tables) -> DataFrame:
    return t.daily_fact.groupBy("title_id").agg(F.sum("ae").cast(DOUBLE).alias("ae"))


def within_factor(asked: DataFrame, tot: DataFrame) -> DataFrame:
    """Of titles how many others are within a factor of 1.05, without pairs: a range holds the titles up to its end less those before its start, less the title itself."""
    asked, tot = (x.filter("ae >= 0 and title_id is not null") for x in (asked, tot))
    known = tot.select("title_id", F.lit(0).alias("one_group"), F.col("ae").alias("value"))
    at = asked.select("title_id", F.lit(0).alias("one_group"), (F.col("ae") / 1.05).alias("low"), (F.col("ae") * 1.05).alias("high"))
    near = counts_between(known, at, "one_group", "value", "low", "high", "title_id")
    return near.select("title_id", (F.col("n") - 1).alias("near")).filter("near > 0")


# Aggregations.


@query("SELECT week_end, title_id, CAST(sum(ae) AS DOUBLE) AS volume FROM daily_fact GROUP BY ALL HAVING volume >= 120000")
def agg_having(t: Tables) -> DataFrame:
    return t.daily_fact.groupBy("week_end", "title_id").agg(F.sum("ae").cast(DOUBLE).alias("volume")).filter("volume >= 120000")


CHANNELS = ("Streams", "ProductSales", "RecordingSales")


@query("SELECT week_end, " + ", ".join(f"CAST(sum(CASE WHEN category = '{c}' THEN ae ELSE 0 END) AS DOUBLE) AS {c.lower()}" for c in CHANNELS) + ", CAST(sum(ae) AS DOUBLE) AS total FROM daily_fact GROUP BY 1")
def agg_cond_sum(t: Tables) -> DataFrame:
    sums = [F.sum(F.when(F.col("category") == c, F.col("ae")).otherwise(F.lit(0).cast("decimal(18,4)"))).cast(DOUBLE).alias(c.lower()) for c in CHANNELS]
    return t.daily_fact.groupBy("week_end").agg(*sums, F.sum("ae").cast(DOUBLE).alias("total"))


@query("SELECT title_id, max(CASE WHEN category = 'Streams' AND quantity > 45 THEN 1 ELSE 0 END)::BIGINT AS any_big, bool_or(service = 'OnDemand') AS any_on_demand FROM daily_fact GROUP BY 1")
def agg_cond_flag(t: Tables) -> DataFrame:
    return t.daily_fact.groupBy("title_id").agg(R.any_flag((F.col("category") == "Streams") & (F.col("quantity") > 45)).alias("any_big"), F.bool_or(F.col("service") == "OnDemand").alias("any_on_demand"))


@query("SELECT week_end, CAST(count(DISTINCT title_id) AS BIGINT) AS titles, CAST(count(DISTINCT product_id) AS BIGINT) AS products FROM daily_fact GROUP BY 1")
def agg_distinct(t: Tables) -> DataFrame:
    return t.daily_fact.groupBy("week_end").agg(F.countDistinct("title_id").alias("titles"), F.countDistinct("product_id").alias("products"))


@query("SELECT level_1, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS n FROM (SELECT level_1, level_2, count(*) AS n FROM ownership GROUP BY ALL) GROUP BY 1")
def agg_two_level(t: Tables) -> DataFrame:
    return t.ownership.groupBy("level_1", "level_2").agg(F.count(F.lit(1)).alias("n")).groupBy("level_1").agg(F.max("n").alias("most"), F.sum("n").alias("n"))


@query("SELECT min(report_date) AS first_day, max(report_date) AS last_day FROM daily_fact")
def agg_watermark(t: Tables) -> DataFrame:
    return t.daily_fact.agg(F.min("report_date").alias("first_day"), F.max("report_date").alias("last_day"))


@query("SELECT week_end, median(CAST(ae AS DOUBLE)) AS median_ae FROM panel GROUP BY 1")
def agg_median(t: Tables) -> DataFrame:
    return t.panel.groupBy("week_end").agg(F.median(F.col("ae").cast(DOUBLE)).alias("median_ae"))


@query("SELECT label, " + ", ".join(f"round(quantile_cont(CAST(ae AS DOUBLE), {p / 100}), 4) AS p{p}" for p in (10, 20, 50, 80, 90)) + " FROM panel GROUP BY 1")
def agg_quantiles(t: Tables) -> DataFrame:
    return t.panel.groupBy("label").agg(*[F.round(F.expr(f"percentile(cast(ae as double), {p / 100})"), 4).alias(f"p{p}") for p in (10, 20, 50, 80, 90)])


@query("SELECT release_type, artist, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY release_type), 8) AS p FROM (SELECT release_type, artist, count(*) AS n FROM titles GROUP BY ALL)")
def agg_mixture_prob(t: Tables) -> DataFrame:
    n = t.titles.groupBy("release_type", "artist").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("release_type")), 8))


@query("SELECT release_type, round(sum(sqrt(n) * m) / sum(sqrt(n)), 4) AS weighted FROM (SELECT release_type, artist, count(*) AS n, median(size) AS m FROM titles GROUP BY ALL) GROUP BY 1")
def agg_weighted_mean(t: Tables) -> DataFrame:
    g = t.titles.groupBy("release_type", "artist").agg(F.count(F.lit(1)).alias("n"), F.median("size").alias("m"))
    return g.groupBy("release_type").agg(F.round(F.sum(F.sqrt("n") * F.col("m")) / F.sum(F.sqrt("n")), 4).alias("weighted"))


@query("""WITH c AS (SELECT status, priority, count(*) AS n FROM order_rows GROUP BY ALL), r AS (SELECT status, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT priority, sum(n) AS cn FROM c GROUP BY 1), g AS (SELECT sum(n) AS t FROM c),
    f AS (SELECT status, priority, CAST(rn AS DOUBLE) * cn / t AS e, t FROM r, k, g), x AS (SELECT sum((coalesce(n, 0) - e) ** 2 / e) AS chi, max(t) AS t, count(DISTINCT status) AS a, count(DISTINCT priority) AS b FROM f LEFT JOIN c USING (status, priority))
    SELECT round(chi, 6) AS chi_square, round(sqrt(chi / t / (least(a, b) - 1)), 6) AS cramers_v, CAST(t AS BIGINT) AS n FROM x""")
def agg_chi_square(t: Tables) -> DataFrame:
    return R.crosstab_association(t.orders, "status", "priority").select(F.round("chi_square", 6).alias("chi_square"), F.round("cramers_v", 6).alias("cramers_v"), "n")


@query("SELECT artist, CAST(count(*) AS BIGINT) AS n FROM titles GROUP BY 1 ORDER BY n DESC, artist LIMIT 12")
def agg_top_counts(t: Tables) -> DataFrame:
    return t.titles.groupBy("artist").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "artist").limit(12)


@query("""WITH s AS (SELECT week_end, level_1, list(DISTINCT product_id) AS ids FROM daily_fact JOIN suppliers USING (product_id) GROUP BY ALL)
    SELECT a.week_end, a.level_1, round(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))), 8) AS overlap FROM s a JOIN s b ON a.level_1 = b.level_1 AND b.week_end = a.week_end - 7""")
def agg_set_overlap(t: Tables) -> DataFrame:
    """Overlap of the products sold in a week and in the week before: counts of shared products, no sets in one row."""
    rows = t.daily_fact.join(t.suppliers, "product_id").select("week_end", "level_1", "product_id").distinct()
    n = rows.groupBy("week_end", "level_1").agg(F.count(F.lit(1)).alias("n"))
    before = rows.withColumn("week_end", F.date_add("week_end", 7))
    both = rows.join(before, ["week_end", "level_1", "product_id"]).groupBy("week_end", "level_1").agg(F.count(F.lit(1)).alias("both"))
    prev = n.select(F.date_add("week_end", 7).alias("week_end"), "level_1", F.col("n").alias("prev"))
    out = n.join(prev, ["week_end", "level_1"]).join(both, ["week_end", "level_1"], "left")
    shared = F.coalesce("both", F.lit(0))
    return out.select("week_end", "level_1", F.round(shared / (F.col("n") + F.col("prev") - shared), 8).alias("overlap"))


@query("""WITH p AS (SELECT label, week_end, CAST(ae AS DOUBLE) AS y, lag(CAST(ae AS DOUBLE)) OVER (PARTITION BY label ORDER BY week_end) AS f FROM panel)
    SELECT label, round(avg(abs(y - f)), 4) AS mae, round(sum(abs(y - f)) / sum(abs(y)), 8) AS wape, round(avg(f - y), 4) AS bias, round(median(abs(y - f) / y), 8) AS median_ape, round(sqrt(avg((y - f) ** 2)), 4) AS rmse FROM p WHERE f IS NOT NULL GROUP BY 1""")
def agg_backtest_scores(t: Tables) -> DataFrame:
    w = Window.partitionBy("label").orderBy("week_end")
    y = F.col("ae").cast(DOUBLE)
    p = t.panel.select("label", y.alias("y"), F.lag(y).over(w).alias("f")).filter("f is not null")
    return p.groupBy("label").agg(*backtest_scores(F.col("y"), F.col("f")))


def backtest_scores(y, f) -> list:
    e = F.abs(y - f)
    return [F.round(F.avg(e), 4).alias("mae"), F.round(F.sum(e) / F.sum(F.abs(y)), 8).alias("wape"), F.round(F.avg(f - y), 4).alias("bias"), F.round(F.median(e / y), 8).alias("median_ape"), F.round(F.sqrt(F.avg((y - f) ** 2)), 4).alias("rmse")]


# Windows.


@query("SELECT title_id, product_id, level_1 FROM owners")
def win_majority_owner(t: Tables) -> DataFrame:
    return t.owners.select("title_id", "product_id", "level_1")


@query("SELECT title_id, product_id, level_1 FROM ownership QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY CASE WHEN level_1 IN ('ASIA', 'EUROPE') THEN 0 ELSE 1 END, units DESC NULLS LAST, product_id) = 1")
def win_priority_dedupe(t: Tables) -> DataFrame:
    listed = F.when(F.col("level_1").isin("ASIA", "EUROPE"), 0).otherwise(1)
    return W.top_n_per_group(t.ownership, ["title_id"], [listed, F.col("units").desc_nulls_last(), F.col("product_id")]).select("title_id", "product_id", "level_1")


@query("SELECT c_custkey, order_id, day, CAST(ae AS DOUBLE) AS ae FROM order_rows QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY day DESC NULLS LAST, order_id) = 1")
def win_latest(t: Tables) -> DataFrame:
    return W.latest_by(t.orders, ["c_custkey"], "day", F.col("order_id")).select("c_custkey", "order_id", "day", F.col("ae").cast(DOUBLE).alias("ae"))


@query("SELECT title_id, week_end, CAST(ae AS DOUBLE) AS peak FROM title_weeks WHERE ae >= 90000 QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY ae DESC, week_end) = 1")
def win_peak_week(t: Tables) -> DataFrame:
    return W.top_n_per_group(t.title_weeks.filter("ae >= 90000"), ["title_id"], [F.col("ae").desc(), F.col("week_end")]).select("title_id", "week_end", F.col("ae").cast(DOUBLE).alias("peak"))


@query("""WITH r AS (SELECT artist, title_id, sum(ae) AS revenue FROM daily_fact JOIN titles USING (title_id) GROUP BY ALL)
    SELECT artist, title_id, CAST(revenue AS DOUBLE) AS revenue, CAST(sum(revenue) OVER (PARTITION BY artist) AS DOUBLE) AS total FROM r QUALIFY row_number() OVER (PARTITION BY artist ORDER BY revenue DESC, title_id) <= 5""")
def win_topn_total(t: Tables) -> DataFrame:
    """The best titles of each artist next to the total over all of its titles."""
    r = t.daily_fact.groupBy("title_id").agg(F.sum("ae").alias("revenue")).join(t.titles.select("title_id", "artist"), "title_id")
    all_ = r.withColumn("total", F.sum("revenue").over(Window.partitionBy("artist")).cast(DOUBLE))
    return W.top_n_per_group(all_, ["artist"], [F.col("revenue").desc(), F.col("title_id")], 5).select("artist", "title_id", F.col("revenue").cast(DOUBLE).alias("revenue"), "total")


@query("""WITH m AS (SELECT CAST(year(day) + CASE WHEN month(day) >= 9 THEN 1 ELSE 0 END AS BIGINT) AS fy, CAST((month(day) + 3) % 12 + 1 AS BIGINT) AS fm, label, sum(ae) AS ae FROM order_rows GROUP BY ALL)
    SELECT fy, fm, label, CAST(ae AS DOUBLE) AS ae, CAST(lag(ae) OVER (PARTITION BY label, fm ORDER BY fy) AS DOUBLE) AS prev FROM m""")
def win_lag_yoy(t: Tables) -> DataFrame:
    m = t.orders.groupBy(C.fiscal_year("day").alias("fy"), C.fiscal_month("day").alias("fm"), "label").agg(F.sum("ae").cast(DOUBLE).alias("ae"))
    return m.withColumn("prev", F.lag("ae").over(Window.partitionBy("label", "fm").orderBy("fy")))


@query("""WITH g AS (SELECT title_id, week_end, quantity AS g, lead(quantity) OVER (PARTITION BY title_id ORDER BY week_end) AS nxt, row_number() OVER (PARTITION BY title_id ORDER BY week_end) AS rn FROM title_weeks)
    SELECT title_id, week_end, CAST(g AS BIGINT) AS g FROM g WHERE NOT (rn = 1 AND coalesce(CAST(nxt AS DOUBLE) / nullif(g, 0), 0) > 10)""")
def win_lead_spike(t: Tables) -> DataFrame:
    """Weekly units without a first week that the next one exceeds tenfold (a stub before the release)."""
    w = Window.partitionBy("title_id").orderBy("week_end")
    g = t.title_weeks.select("title_id", "week_end", F.col("quantity").alias("g")).withColumn("nxt", F.lead("g").over(w)).withColumn("rn", F.row_number().over(w))
    return g.filter(~((F.col("rn") == 1) & (C.ratio_or("nxt", "g") > 10))).select("title_id", "week_end", "g")


def _label_week(t: Tables):
    return t.panel.select("label", "week_end", F.col("ae").cast(DOUBLE).alias("ae")), Window.partitionBy("label").orderBy("week_end")


@query("""SELECT label, week_end, CASE WHEN count(*) OVER w = 4 THEN round(avg(CAST(ae AS DOUBLE)) OVER w, 4) END AS roll4,
    CAST(lag(ae, 1) OVER o AS DOUBLE) AS lag1, CAST(lag(ae, 4) OVER o AS DOUBLE) AS lag4 FROM panel WINDOW o AS (PARTITION BY label ORDER BY week_end), w AS (PARTITION BY label ORDER BY week_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def win_roll4(t: Tables) -> DataFrame:
    p, w = _label_week(t)
    return p.select("label", "week_end", F.round(W.rolling_mean(F.col("ae"), w, 4), 4).alias("roll4"), F.lag("ae", 1).over(w).alias("lag1"), F.lag("ae", 4).over(w).alias("lag4"))


@query("SELECT label, week_end, CASE WHEN count(*) OVER w >= 8 THEN round(median(CAST(ae AS DOUBLE)) OVER w, 4) END AS roll52 FROM panel WINDOW w AS (PARTITION BY label ORDER BY week_end ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)")
def win_roll52_median(t: Tables) -> DataFrame:
    p, w = _label_week(t)
    return p.select("label", "week_end", F.round(W.rolling_median(F.col("ae"), w, 52, 8), 4).alias("roll52"))


@query("SELECT label, week_end, CASE WHEN count(*) OVER w = 4 THEN round(stddev_pop(CAST(ae AS DOUBLE)) OVER w / greatest(avg(CAST(ae AS DOUBLE)) OVER w, 1e-9), 6) END AS cv FROM panel WINDOW w AS (PARTITION BY label ORDER BY week_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
def win_cv4(t: Tables) -> DataFrame:
    p, w = _label_week(t)
    return p.select("label", "week_end", F.round(W.rolling_cv(F.col("ae"), w, 4), 6).alias("cv"))


@query("SELECT label, week_end, CAST(sum(ae) OVER (PARTITION BY label, year ORDER BY week_end) AS DOUBLE) AS ytd FROM panel")
def win_ytd(t: Tables) -> DataFrame:
    return t.panel.select("label", "week_end", W.running_sum(F.col("ae"), Window.partitionBy("label", "year").orderBy("week_end")).cast(DOUBLE).alias("ytd"))


@query("SELECT label, week_end, CAST(ae AS DOUBLE) AS ae, CAST(min(ae) OVER (PARTITION BY label) AS DOUBLE) AS low, CAST(max(ae) OVER (PARTITION BY label) AS DOUBLE) AS high FROM panel")
def win_group_extent(t: Tables) -> DataFrame:
    p, _ = _label_week(t)
    g = Window.partitionBy("label")
    return p.select("*", F.min("ae").over(g).alias("low"), F.max("ae").over(g).alias("high"))


PEAKS_SQL = "p AS (SELECT label, week_end, ae, CAST(coalesce(ae > max(ae) OVER (PARTITION BY label ORDER BY week_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS INTEGER) AS flag FROM panel)"


@query(f"""WITH {PEAKS_SQL}, i AS (SELECT *, sum(flag) OVER (PARTITION BY label ORDER BY week_end) AS island FROM p)
    SELECT label, week_end, CAST(row_number() OVER (PARTITION BY label, island ORDER BY week_end) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS BIGINT) AS since_peak FROM i""")
def win_reset_counter(t: Tables) -> DataFrame:
    p, w = _label_week(t)
    best = F.max("ae").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = p.withColumn("flag", F.coalesce(F.col("ae") > best, F.lit(False)))
    return W.rows_since(flagged, F.col("flag"), ["label"], ["week_end"], "since_peak").select("label", "week_end", "since_peak")


@query("""WITH s AS (SELECT label, week_end, CASE WHEN isodow(week_end) = 4 AND week(week_end) % 5 IN (1, 2) THEN CAST(ae AS DOUBLE) END AS x FROM panel)
    SELECT label, week_end, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY label ORDER BY week_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY label ORDER BY week_end ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM s""")
def win_ffill(t: Tables) -> DataFrame:
    p, w = _label_week(t)
    x = F.when(F.weekofyear("week_end") % 5 < 3, F.when(F.weekofyear("week_end") % 5 > 0, F.col("ae")))
    return p.withColumn("x", x).select("label", "week_end", W.filled(F.col("x"), w).alias("filled"))


@query("SELECT label, min(week_end) FILTER (WHERE c >= 50000000) AS crossed FROM (SELECT label, week_end, sum(ae) OVER (PARTITION BY label ORDER BY week_end) AS c FROM panel) GROUP BY 1")
def win_first_cross(t: Tables) -> DataFrame:
    w = Window.partitionBy("label").orderBy("week_end")
    c = t.panel.select("label", "week_end", W.running_sum(F.col("ae"), w).alias("c"))
    return c.groupBy("label").agg(F.min(F.when(F.col("c") >= 50_000_000, F.col("week_end"))).alias("crossed"))


@query("SELECT label, week_end, CAST(ae AS DOUBLE) AS ae FROM panel QUALIFY row_number() OVER (PARTITION BY label ORDER BY week_end DESC) <= 24")
def win_tail(t: Tables) -> DataFrame:
    return W.top_n_per_group(t.panel, ["label"], [F.col("week_end").desc()], 24).select("label", "week_end", F.col("ae").cast(DOUBLE).alias("ae"))


# Sorting and paging.


@query("WITH n AS (SELECT count(*) AS n FROM titles WHERE artist <= 'Brand#25') SELECT title_id, title, first_sale_date, n > 60 AS has_more, CASE WHEN n > 60 THEN CAST(60 AS BIGINT) END AS next_offset FROM titles, n WHERE artist <= 'Brand#25' ORDER BY first_sale_date DESC NULLS LAST, title_id LIMIT 20 OFFSET 40")
def sort_nulls_last_page(t: Tables) -> DataFrame:
    rows = t.titles.filter("artist <= 'Brand#25'").select("title_id", "title", "first_sale_date")
    return R.page(rows, [F.col("first_sale_date").desc_nulls_last(), F.col("title_id")], 20, 40)


@query("SELECT level_2, CAST(row_number() OVER (ORDER BY lower(level_2), level_2) AS BIGINT) AS pos FROM (SELECT DISTINCT level_2 FROM suppliers)")
def sort_nocase(t: Tables) -> DataFrame:
    names = t.suppliers.select("level_2").distinct()  # a short list of distributors
    return names.withColumn("pos", F.row_number().over(Window.orderBy(F.lower("level_2"), "level_2")).cast("long"))


@query("SELECT label, week_end, CAST(pos AS BIGINT) AS pos FROM (SELECT label, week_end, row_number() OVER (PARTITION BY week_end ORDER BY greatest(abs(share), abs(share - 0.2)) DESC, label) AS pos FROM panel) WHERE pos <= 3")
def sort_by_greatest(t: Tables) -> DataFrame:
    w = Window.partitionBy("week_end").orderBy(F.greatest(F.abs("share"), F.abs(F.col("share") - 0.2)).desc(), "label")
    return t.panel.withColumn("pos", F.row_number().over(w).cast("long")).filter("pos <= 3").select("label", "week_end", "pos")


@query("SELECT title_id, title, artist FROM titles WHERE title_id = 42 LIMIT 1")
def point_lookup(t: Tables) -> DataFrame:
    return t.titles.filter("title_id = 42").select("title_id", "title", "artist").limit(1)


# Set operations.


@query("SELECT title_id AS id, title AS name, 'title' AS kind FROM titles UNION ALL SELECT product_id, level_3, 'product' FROM suppliers")
def set_union_all(t: Tables) -> DataFrame:
    a = t.titles.select(F.col("title_id").alias("id"), F.col("title").alias("name"), F.lit("title").alias("kind"))
    return a.unionByName(t.suppliers.select(F.col("product_id").alias("id"), F.col("level_3").alias("name"), F.lit("product").alias("kind")))


@query("SELECT title_id AS id FROM title_weeks WHERE ae > 100000 UNION SELECT title_id FROM titles WHERE release_type = 'PROMO'")
def set_union_distinct(t: Tables) -> DataFrame:
    big = t.title_weeks.filter("ae > 100000").select(F.col("title_id").alias("id"))
    return big.union(t.titles.filter("release_type = 'PROMO'").select("title_id")).distinct()


@query("SELECT 'titles' AS check_name, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS DATE) AS day FROM titles UNION ALL SELECT 'last_day', NULL, max(report_date) FROM daily_fact UNION ALL SELECT 'products', count(DISTINCT product_id), NULL FROM daily_fact")
def set_union_padded(t: Tables) -> DataFrame:
    a = t.titles.agg(F.count(F.lit(1)).alias("n")).withColumn("check_name", F.lit("titles"))
    b = t.daily_fact.agg(F.max("report_date").alias("day")).withColumn("check_name", F.lit("last_day"))
    c = t.daily_fact.agg(F.countDistinct("product_id").alias("n")).withColumn("check_name", F.lit("products"))
    return R.union_padded(a, b, c).select("check_name", "n", "day")


# Scalars.


@query(r"SELECT DISTINCT priority, regexp_extract(priority, '[1-3]') AS digit, regexp_extract(priority, '^([0-9])-([A-Z]+)', 2) AS word, ltrim(priority, '0123456789-') AS rest FROM order_rows")
def str_regexp(t: Tables) -> DataFrame:
    p = t.orders.select("priority").distinct()
    return p.select("priority", F.coalesce(F.regexp_substr("priority", F.lit("[1-3]")), F.lit("")).alias("digit"), F.regexp_extract("priority", "^([0-9])-([A-Z]+)", 2).alias("word"), F.expr("trim(LEADING '0123456789-' FROM priority)").alias("rest"))


@query(r"SELECT doc_id, trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžœæßø', 'aaaaaaceeeeiiiinooooouuuuyyszoaso'), '[^\p{L}\p{N}]+', ' ', 'g')) AS search FROM documents")
def str_normalize(t: Tables) -> DataFrame:
    """The whole normalised text of every document."""
    return t.raw("documents").select("doc_id", C.search_text("text").alias("search"))


@query()
def str_normalize_whole(t: Tables) -> DataFrame:
    """The same with exact decomposition of every character, in the JVM."""
    return t.raw("documents").select("doc_id", folded("text").alias("search"))


@query(r"""WITH k AS (SELECT title_id, artist, list_distinct(list_filter(string_split(title, ' '), lambda x: length(x) >= 2)) AS words FROM titles)
    SELECT a.title_id, round(len(list_intersect(a.words, ['small', 'red', 'ring'])) / len(list_distinct(list_concat(a.words, ['small', 'red', 'ring']))), 8) AS overlap FROM k a""")
def str_jaccard(t: Tables) -> DataFrame:
    asked = F.array(*map(F.lit, ("small", "red", "ring")))
    return t.titles.select("title_id", F.round(C.jaccard(C.search_tokens("title"), asked), 8).alias("overlap"))


@query("SELECT DISTINCT artist, lower(artist) AS low, artist = upper(artist) AND artist <> lower(artist) AS caps, trim(regexp_replace(lower(artist), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CASE WHEN instr(artist, '|') > 0 THEN split_part(artist, '|', 1) WHEN instr(artist, '#') > 0 THEN split_part(artist, '#', 1) ELSE artist END AS head FROM titles")
def str_cleanup(t: Tables) -> DataFrame:
    a = t.titles.select("artist").distinct()
    return a.select("artist", F.lower("artist").alias("low"), C.all_caps("artist").alias("caps"), C.slug("artist").alias("slug"), C.first_part("artist", ("|", "#")).alias("head"))


@query("""WITH d AS (SELECT DISTINCT day FROM order_rows) SELECT day, CAST(year(day) + CASE WHEN month(day) >= 9 THEN 1 ELSE 0 END AS BIGINT) AS fy, CAST((month(day) + 3) % 12 + 1 AS BIGINT) AS fm,
    CAST(ceil(((month(day) + 3) % 12 + 1) / 3.0) AS BIGINT) AS fq, CASE WHEN day < last_day(day) THEN strftime(day, '%b') || ' - (END ' || strftime(day, '%b %d') || ')' ELSE strftime(day, '%b') END AS label FROM d""")
def date_fiscal(t: Tables) -> DataFrame:
    d = t.orders.select("day").distinct()
    return d.select("day", C.fiscal_year("day").alias("fy"), C.fiscal_month("day").alias("fm"), C.fiscal_quarter("day").alias("fq"), C.fiscal_month_label("day").alias("label"))


@query("""WITH d AS (SELECT title_id, report_date, first_sale_date FROM daily_fact JOIN titles USING (title_id))
    SELECT title_id, report_date, CAST(max(ceil((report_date - first_sale_date) / 7.0)) AS BIGINT) AS weeks, CAST(max(round_even((report_date - first_sale_date) / 7.0, 0)) + 1 AS BIGINT) AS week_no FROM d GROUP BY ALL""")
def date_week_index(t: Tables) -> DataFrame:
    d = t.daily_fact.join(t.titles.select("title_id", "first_sale_date"), "title_id").select("title_id", "report_date", "first_sale_date").distinct()
    return d.select("title_id", "report_date", C.weeks_since("report_date", "first_sale_date").alias("weeks"), C.week_number("report_date", "first_sale_date").alias("week_no"))


@query("""WITH d AS (SELECT DISTINCT day FROM order_rows) SELECT day, day + CAST((4 - isodow(day) + 7) % 7 AS INTEGER) AS week_end, day - CAST((isodow(day) + 2) % 7 + 1 AS INTEGER) AS expected,
    CAST(date_trunc('year', day) AS DATE) - 84 AS floor_day, CAST(week(day) AS BIGINT) AS iso_week, CAST(quarter(day) AS BIGINT) AS q,
    CAST(ceil((CAST(date_trunc('year', day) + INTERVAL 1 YEAR AS DATE) - day) / 7.0) AS BIGINT) AS weeks_left, CAST(day - INTERVAL 18 MONTH AS DATE) AS current_from FROM d""")
def date_chart_week(t: Tables) -> DataFrame:
    d = t.orders.select("day").distinct()
    year = F.trunc("day", "YEAR")
    return d.select(
        "day", C.week_end("day").alias("week_end"), C.expected_week("day").alias("expected"), F.date_sub(year, 84).alias("floor_day"), F.weekofyear("day").cast("long").alias("iso_week"),
        F.quarter("day").cast("long").alias("q"), F.ceil(F.datediff(F.add_months(year, 12), F.col("day")) / F.lit(7.0)).cast("long").alias("weeks_left"), F.add_months("day", -18).alias("current_from"),
    )


@query("""WITH x AS (SELECT title_id, CAST(sum(CASE WHEN category = 'Streams' THEN quantity ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN service = 'OnDemand' AND category = 'ProductSales' THEN quantity ELSE 0 END) AS BIGINT) AS b FROM daily_fact GROUP BY 1)
    SELECT title_id, CASE WHEN b = 0 THEN 0.0 ELSE round(a / b, 8) END AS r0, round(coalesce(a / nullif(b, 0), 0), 8) AS r1, CASE WHEN b > 0 THEN round(a / b, 8) ELSE 1.0 END AS r2 FROM x""")
def math_div0(t: Tables) -> DataFrame:
    a = F.sum(F.when(F.col("category") == "Streams", F.col("quantity")).otherwise(0)).alias("a")
    b = F.sum(F.when((F.col("service") == "OnDemand") & (F.col("category") == "ProductSales"), F.col("quantity")).otherwise(0)).alias("b")
    x = t.daily_fact.groupBy("title_id").agg(a, b)
    return x.select("title_id", F.round(C.div0("a", "b"), 8).alias("r0"), F.round(C.ratio_or("a", "b"), 8).alias("r1"), F.round(C.safe_ratio("a", "b"), 8).alias("r2"))


@query("SELECT order_id, floor(CAST(ae AS DOUBLE) / 7 * 100 + 1e-9) / 100 AS cut, round(ln(1 + CAST(ae AS DOUBLE)), 8) AS log1p, least(greatest(CAST(ae AS DOUBLE), 1000), 90000) AS clipped FROM order_rows")
def math_trunc2(t: Tables) -> DataFrame:
    ae = F.col("ae").cast(DOUBLE)
    return t.orders.select("order_id", C.trunc2(ae / 7).alias("cut"), F.round(F.log1p(ae), 8).alias("log1p"), C.clip(ae, 1000, 90000).alias("clipped"))


@query("""WITH s AS (SELECT label, week_end, share, share * CASE WHEN week(week_end) % 3 = 0 THEN 1 WHEN week(week_end) % 3 = 1 THEN 100 ELSE 10000 END AS raw FROM panel), m AS (SELECT median(raw) AS md FROM s)
    SELECT label, week_end, round(CASE WHEN raw > 100 THEN raw / 10000 WHEN raw > 1 THEN raw / 100 ELSE raw END, 8) AS by_row, round(CASE WHEN md <= 1 THEN raw * 100 ELSE raw END, 6) AS pct, round(CASE WHEN md > 1 THEN raw / 100 ELSE raw END, 6) AS frac FROM s, m""")
def math_share_units(t: Tables) -> DataFrame:
    k = F.weekofyear("week_end") % 3
    s = t.panel.select("label", "week_end", (F.col("share") * F.when(k == 0, 1).when(k == 1, 100).otherwise(10000)).alias("raw"))
    s = s.crossJoin(F.broadcast(s.agg(F.median("raw").alias("md"))))  # one row
    return s.select("label", "week_end", F.round(C.share_fraction("raw"), 8).alias("by_row"), F.round(C.share_percent_by_median("raw", "md"), 6).alias("pct"), F.round(C.share_fraction_by_median("raw", "md"), 6).alias("frac"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS not_a_number FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def variant_path(t: Tables) -> DataFrame:
    v = t.events.select("event_id", F.parse_json("props").alias("v"), F.col("event_type").try_cast("bigint").alias("not_a_number"))
    return v.select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"), "not_a_number").filter("k > 50")


@query("SELECT label, round(list_aggregate(list_slice(xs, -8, -1), 'avg'), 4) AS tail_mean FROM (SELECT label, list(CAST(ae AS DOUBLE) ORDER BY week_end) AS xs FROM panel GROUP BY 1)")
def arr_tail_mean(t: Tables) -> DataFrame:
    xs = t.panel.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("week_end", "ae"))), lambda x: x["ae"].cast(DOUBLE)).alias("xs"))
    tail = F.slice("xs", -8, 8)
    return xs.select("label", F.round(F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail), 4).alias("tail_mean"))


@query(r"""SELECT title_id, json_extract_string(doc, '$.credits[0].roles[1].name') AS role, CAST(json_extract(doc, '$.credits[1].share') AS BIGINT) AS share FROM (SELECT title_id, '{"credits":[{"artist":"' || artist || '","roles":[{"name":"main"},{"name":"writer ' || (size % 3)::VARCHAR || '"}]}' ||
    CASE WHEN title_id % 2 = 0 THEN ',{"artist":"other","share":' || size::VARCHAR || '}' ELSE '' END || ']}' AS doc FROM titles)""")
def variant_nested_path(t: Tables) -> DataFrame:
    """Values at paths through arrays of a document; null where the path ends early."""
    more = F.when(F.col("title_id") % 2 == 0, F.concat(F.lit(',{"artist":"other","share":'), F.col("size").cast("string"), F.lit("}"))).otherwise("")
    doc = F.concat(F.lit('{"credits":[{"artist":"'), "artist", F.lit('","roles":[{"name":"main"},{"name":"writer '), (F.col("size") % 3).cast("string"), F.lit('"}]}'), more, F.lit("]}"))
    v = F.parse_json(doc)
    return t.titles.select("title_id", F.variant_get(v, "$.credits[0].roles[1].name", "string").alias("role"), F.variant_get(v, "$.credits[1].share", "bigint").alias("share"))


@query("SELECT title_id, week_end, CAST(ae AS DOUBLE) AS ae FROM title_weeks WHERE ae >= 50000 AND week_end BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND title_id IN (SELECT title_id FROM titles WHERE release_type = 'PROMO')")
def sql_with_parameters(t: Tables) -> DataFrame:
    """A template in SQL over the relations, its values bound as parameters, never put into the text."""
    template = "SELECT title_id, week_end, CAST(ae AS DOUBLE) AS ae FROM {weeks} WHERE ae >= :least AND week_end BETWEEN :first AND :last AND title_id IN (SELECT title_id FROM {titles} WHERE release_type = :kind)"
    return t.spark.sql(template, args={"least": 50_000, "first": date(1996, 1, 1), "last": date(1996, 12, 31), "kind": "PROMO"}, weeks=t.title_weeks, titles=t.titles)
