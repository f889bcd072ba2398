"""The domain's reports (Q-01 to Q-40), bound to the tables of ``Tables``.

Each is set-based: a report over many titles is one job, never a loop over titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import windows as W
from ..operators import relational as R
from ..sources.tables import ANCHOR, LABELS, Tables
from .registry import query
from .relational import ARTISTS_SQL, title_artists

DOUBLE = "double"
#: Volume from which a title's week counts, for the title floor, the list of large titles and the roster.
FLOOR, LARGE, ROSTER = 50_000, 75_000, 100_000
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def d(x: str):
    return F.col(x).cast(DOUBLE).alias(x)


def sql_sums(value: str, by: str, names: dict[str, str], cast: str = "DOUBLE") -> str:
    return ", ".join(f"CAST(sum(CASE WHEN {by} = '{v}' THEN {value} ELSE 0 END) AS {cast}) AS {n}" for v, n in names.items())


def sums(value: str, by: str, names: dict[str, str]) -> list:
    return [F.sum(F.when(F.col(by) == v, F.col(value)).otherwise(F.lit(0).cast("decimal(18,4)"))).cast(DOUBLE).alias(n) for v, n in names.items()]


@query("""SELECT week_end, CAST(sum(CASE WHEN level_1 = 'ASIA' THEN ae ELSE 0 END) AS DOUBLE) AS asia, CAST(sum(CASE WHEN level_1 = 'EUROPE' THEN ae ELSE 0 END) AS DOUBLE) AS europe, CAST(sum(ae) AS DOUBLE) AS market
    FROM title_weeks LEFT JOIN owners USING (title_id) WHERE ae >= 50000 GROUP BY 1 ORDER BY 1""")
def q_19_lite(t: Tables) -> DataFrame:
    """Weekly volume of qualifying titles by owner, with the market total."""
    rows = t.title_weeks.filter(F.col("ae") >= FLOOR).join(t.owners.select("title_id", "level_1"), "title_id", "left")
    return rows.groupBy("week_end").agg(*sums("ae", "level_1", {"ASIA": "asia", "EUROPE": "europe"}), F.sum("ae").cast(DOUBLE).alias("market")).orderBy("week_end")


def title_floor(t: Tables) -> DataFrame:
    rows = t.title_weeks.filter(F.col("ae") >= FLOOR)
    return rows.join(t.dealt_titles, "title_id").filter("week_end >= first_sale_date").join(t.owners, "title_id", "left").select("week_end", "title_id", "title", "artist", "first_sale_date", "ae", F.coalesce("level_1", F.lit("Unknown")).alias("owner"), "level_2", "level_3")


FLOOR_SQL = "title_floor AS (SELECT w.week_end, title_id, title, artist, first_sale_date, w.ae, coalesce(level_1, 'Unknown') AS owner, level_2, level_3 FROM title_weeks w JOIN titles USING (title_id) LEFT JOIN owners USING (title_id) WHERE w.ae >= 50000 AND w.week_end >= first_sale_date)"


@query(f"WITH {FLOOR_SQL} SELECT * REPLACE (CAST(ae AS DOUBLE) AS ae) FROM title_floor")
def q_01_title_weeks(t: Tables) -> DataFrame:
    return title_floor(t).withColumn("ae", d("ae"))


@query("SELECT week_end, label, CAST(ae AS DOUBLE) AS ae, share FROM panel WHERE label IN ('BUILDING', 'MACHINERY') AND week_end >= DATE '1996-01-01'")
def q_02_panel(t: Tables) -> DataFrame:
    return t.panel_since("1996-01-01").filter(F.col("label").isin(ANCHOR, "MACHINERY")).select("week_end", "label", d("ae"), "share")


@query("SELECT level_1, CASE WHEN level_2 IN ('NATION_1', 'NATION_2') THEN level_2 ELSE coalesce(level_1, 'Unknown') END AS owner, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT title_id) AS BIGINT) AS titles FROM ownership WHERE level_1 ILIKE '%a%' GROUP BY ALL")
def q_03_owner_audit(t: Tables) -> DataFrame:
    owner = C.owner_case("level_1", "level_2", ("NATION_1", "NATION_2")).alias("owner")
    return t.ownership.filter(F.col("level_1").ilike("%a%")).groupBy("level_1", owner).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title_id").alias("titles"))


@query("""WITH l AS (SELECT max(week_end) AS w FROM title_weeks), r AS (SELECT * FROM title_weeks JOIN l ON week_end = w)
    SELECT 'titles' AS check_name, CAST(count(DISTINCT title_id) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS ae FROM r UNION ALL SELECT 'volume', NULL, CAST(sum(ae) AS DOUBLE) FROM r UNION ALL SELECT 'labels', count(DISTINCT label), NULL FROM panel""")
def q_04_confirm(t: Tables) -> DataFrame:
    latest = t.title_weeks.agg(F.max("week_end").alias("week_end"))
    r = t.title_weeks.join(latest, "week_end")
    a = r.agg(F.countDistinct("title_id").alias("n")).withColumn("check_name", F.lit("titles"))
    b = r.agg(F.sum("ae").cast(DOUBLE).alias("ae")).withColumn("check_name", F.lit("volume"))
    c = t.panel.agg(F.countDistinct("label").alias("n")).withColumn("check_name", F.lit("labels"))
    return R.union_padded(a, b, c).select("check_name", "n", "ae")


RATES_SQL = "rates AS (SELECT c_custkey AS artist_id, day AS calculated, order_id, CAST(ae AS DOUBLE) / 1000000 AS rate FROM order_rows)"


def rates(t: Tables) -> DataFrame:
    return t.orders.select(F.col("c_custkey").alias("artist_id"), F.col("day").alias("calculated"), "order_id", (F.col("ae").cast(DOUBLE) / 1_000_000).alias("rate"))


@query(f"WITH {ARTISTS_SQL}, {RATES_SQL}, u AS (SELECT DISTINCT list_filter(artists, lambda x: x.role = 'main')[1].product_id AS artist_id FROM artists) SELECT artist_id, calculated, rate FROM rates JOIN u USING (artist_id) QUALIFY row_number() OVER (PARTITION BY artist_id ORDER BY calculated DESC NULLS LAST, order_id) = 1")
def q_05_current_rate(t: Tables) -> DataFrame:
    """The latest rate of every main artist: the universe first, as a semi-join."""
    universe = title_artists(t).select(F.get(F.filter("artists", lambda x: x["role"] == "main"), 0)["product_id"].alias("artist_id")).distinct()
    return W.latest_by(rates(t).join(universe, "artist_id", "left_semi"), ["artist_id"], "calculated", F.col("order_id")).select("artist_id", "calculated", "rate")


@query(f"WITH {RATES_SQL} SELECT artist_id, calculated, rate FROM rates WHERE artist_id = 7 ORDER BY calculated DESC, order_id LIMIT 1")
def q_06_live_rate(t: Tables) -> DataFrame:
    return rates(t).filter("artist_id = 7").orderBy(F.desc("calculated"), "order_id").limit(1).select("artist_id", "calculated", "rate")


@query("SELECT product_id AS artist_id FROM owners UNION SELECT c_custkey FROM order_rows WHERE status = 'F'")
def q_07_universe(t: Tables) -> DataFrame:
    return t.owners.select(F.col("product_id").alias("artist_id")).union(t.orders.filter("status = 'F'").select("c_custkey")).distinct()


@query("""WITH r AS (SELECT product_id AS artist_id, title_id, sum(ae) AS revenue FROM daily_fact WHERE year(report_date) = 1999 GROUP BY ALL)
    SELECT artist_id, title_id, CAST(revenue AS DOUBLE) AS revenue, CAST(sum(revenue) OVER (PARTITION BY artist_id) AS DOUBLE) AS artist_total FROM r QUALIFY row_number() OVER (PARTITION BY artist_id ORDER BY revenue DESC, title_id) <= 10""")
def q_08_artist_revenue(t: Tables) -> DataFrame:
    r = t.daily_fact.filter(F.col("report_date").between("1999-01-01", "1999-12-31")).groupBy(F.col("product_id").alias("artist_id"), "title_id").agg(F.sum("ae").alias("revenue"))
    with_total = r.withColumn("artist_total", F.sum("revenue").over(Window.partitionBy("artist_id")).cast(DOUBLE))
    return W.top_n_per_group(with_total, ["artist_id"], [F.col("revenue").desc(), F.col("title_id")], 10).withColumn("revenue", d("revenue"))


@query("""WITH a AS (SELECT max(report_date) AS as_of FROM daily_fact) SELECT title_id, report_date, CAST(sum(quantity) AS BIGINT) AS streams FROM daily_fact, a
    WHERE category = 'Streams' AND report_date >= CAST(date_trunc('year', as_of) AS DATE) - 84 GROUP BY ALL""")
def q_09_daily_streams(t: Tables) -> DataFrame:
    """Daily streams since twelve weeks before the year; the date comes from the data."""
    as_of = t.daily_fact.agg(F.date_sub(F.trunc(F.max("report_date"), "YEAR"), 84).alias("floor_day"))
    rows = t.facts("Streams").join(F.broadcast(as_of), F.col("report_date") >= F.col("floor_day"))  # one row
    return rows.groupBy("title_id", "report_date").agg(F.sum("quantity").alias("streams"))


@query("""WITH s AS (SELECT title_id, week_end, sum(quantity) AS q FROM daily_fact WHERE category = 'Streams' GROUP BY ALL), g AS (SELECT *, lead(q) OVER w AS nxt, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY title_id ORDER BY week_end))
    SELECT title_id, week_end, CAST(q AS BIGINT) AS streams FROM g WHERE NOT (rn = 1 AND coalesce(CAST(nxt AS DOUBLE) / nullif(q, 0), 0) > 100)""")
def q_10_weekly_streams(t: Tables) -> DataFrame:
    w = Window.partitionBy("title_id").orderBy("week_end")
    s = t.facts("Streams").groupBy("title_id", "week_end").agg(F.sum("quantity").alias("streams"))
    g = s.withColumn("nxt", F.lead("streams").over(w)).withColumn("rn", F.row_number().over(w))
    return g.filter(~((F.col("rn") == 1) & (C.ratio_or("nxt", "streams") > 100))).select("title_id", "week_end", "streams")


@query("SELECT nation_id, c_custkey, day FROM order_rows QUALIFY row_number() OVER (PARTITION BY nation_id ORDER BY day DESC, order_id) = 1")
def q_11_canonical_name(t: Tables) -> DataFrame:
    """The latest row of each nation; ``q_11_artist_names`` resolves names."""
    return W.latest_by(t.orders, ["nation_id"], "day", F.col("order_id")).select("nation_id", "c_custkey", "day")


#: Names as sources have written them over the years: by the last digit of the order, in upper case, with spaces around, blank, or as they are.
SPELLINGS_SQL = "CASE o_orderkey % 5 WHEN 0 THEN upper(s_name) WHEN 1 THEN '  ' || s_name || ' ' WHEN 2 THEN ' ' WHEN 3 THEN NULL ELSE s_name END"


@query(f"""WITH v AS (SELECT ' ' || s_suppkey || ' ' AS artist_id, {SPELLINGS_SQL} AS artist_name, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS modified FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT '  ', 'nobody', NULL),
    n AS (SELECT trim(artist_id) AS artist_id, trim(artist_name) AS artist_name FROM v WHERE trim(artist_id) <> '' AND trim(artist_name) <> '' QUALIFY row_number() OVER (PARTITION BY trim(artist_id) ORDER BY modified DESC NULLS LAST, artist_name) = 1),
    l AS (SELECT CAST(s_suppkey AS VARCHAR) AS artist_id, s_name AS billed FROM supplier)
    SELECT artist_id, coalesce(artist_name, billed) AS artist_name, artist_name IS NOT NULL AS canonical FROM l LEFT JOIN n USING (artist_id)""")
def q_11_artist_names(t: Tables) -> DataFrame:
    """The name that each supplier goes by: of those that sources gave, without spaces around, the latest that is not blank (undated last, then the first in order); else the one that is billed."""
    spelt = F.col("o_orderkey") % 5
    name = F.when(spelt == 0, F.upper("s_name")).when(spelt == 1, F.concat(F.lit("  "), "s_name", F.lit(" "))).when(spelt == 2, " ").when(spelt == 4, F.col("s_name"))
    orders = t.raw("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate").cast("date")).alias("modified"))
    given = t.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).join(orders, "o_orderkey").join(t.raw("supplier").select("s_suppkey", "s_name"), "s_suppkey")
    given = given.select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("artist_id"), name.alias("artist_name"), "modified")
    given = given.unionByName(t.spark.createDataFrame([("  ", "nobody", None)], "artist_id string, artist_name string, modified date"))
    names = canonical_names(given)
    billed = t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("artist_id"), F.col("s_name").alias("billed"))
    return billed.join(names, "artist_id", "left").select("artist_id", F.coalesce("artist_name", "billed").alias("artist_name"), F.col("artist_name").isNotNull().alias("canonical"))


def canonical_names(given: DataFrame) -> DataFrame:
    """artist_id, artist_name, modified -> one name an artist; blank ones and those without an artist do not count."""
    known = given.withColumns({"artist_id": F.trim("artist_id"), "plain": F.trim("artist_name")}).filter("artist_id <> '' AND plain <> ''")
    return W.latest_by(known, ["artist_id"], "modified", F.col("artist_name")).select("artist_id", F.col("plain").alias("artist_name"))


FOUR = {"Streams": "streaming", "ProductSales": "product_sales", "RecordingSales": "song_sales"}


@query(f"SELECT title_id, week_end, CAST(ceil(sum(ae)) AS BIGINT) AS total, {sql_sums('ae', 'category', FOUR)} FROM daily_fact JOIN titles USING (title_id) WHERE report_date >= first_sale_date AND title_id IN (1, 2, 3, 5, 7, 11, 13) GROUP BY ALL")
def q_12_release_metrics(t: Tables) -> DataFrame:
    rows = R.with_ids(t.daily_fact, "title_id", (1, 2, 3, 5, 7, 11, 13)).join(t.titles.select("title_id", "first_sale_date"), "title_id").filter("report_date >= first_sale_date")
    return rows.groupBy("title_id", "week_end").agg(F.ceil(F.sum("ae")).cast("long").alias("total"), *sums("ae", "category", FOUR))


def search_snapshot(t: Tables, types: tuple[str, ...]) -> DataFrame:
    as_of = t.daily_fact.agg(F.max("report_date").alias("as_of"))
    recent = t.facts("Streams").join(F.broadcast(as_of), F.col("report_date") >= F.date_sub("as_of", 28)).groupBy("title_id").agg(F.sum("quantity").alias("daily"))  # one row
    owner = W.top_n_per_group(t.ownership, ["title_id"], [F.when(F.col("level_1").isin("ASIA", "EUROPE"), 0).otherwise(1), F.col("units").desc_nulls_last(), F.col("product_id")])
    main = title_artists(t).select("title_id", F.get(F.filter("artists", lambda x: x["role"] == "main"), 0)["product_id"].alias("artist_id"))
    rows = t.titles.filter(F.col("release_type").isin(*types)).join(owner.select("title_id", "level_1"), "title_id", "left").join(main, "title_id", "left").join(recent, "title_id", "left")
    return rows.select("title_id", "title", "artist", "artist_id", "release_type", F.col("level_1").alias("label"), C.effective_release_date(F.lit("1996-06-01").cast("date"), "first_sale_date", "1996-01-05").alias("release_date"), F.coalesce("daily", F.lit(0)).alias("daily_streams"), C.search_text("artist").alias("artist_search"), C.search_text("title").alias("title_search"))


def snapshot_sql(types: str) -> str:
    return rf"""WITH {ARTISTS_SQL}, a AS (SELECT max(report_date) AS as_of FROM daily_fact), s AS (SELECT title_id, CAST(sum(quantity) AS BIGINT) AS daily FROM daily_fact, a WHERE category = 'Streams' AND report_date >= as_of - 28 GROUP BY 1),
    o AS (SELECT title_id, level_1 FROM ownership QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY CASE WHEN level_1 IN ('ASIA', 'EUROPE') THEN 0 ELSE 1 END, units DESC NULLS LAST, product_id) = 1)
    SELECT t.title_id, t.title, t.artist, list_filter(artists, lambda x: x.role = 'main')[1].product_id AS artist_id, t.release_type, o.level_1 AS label, coalesce(first_sale_date, DATE '1996-06-01') AS release_date, coalesce(daily, 0) AS daily_streams,
    trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')) AS artist_search, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_search
    FROM titles t LEFT JOIN o USING (title_id) LEFT JOIN artists USING (title_id) LEFT JOIN s USING (title_id) WHERE release_type IN ({types})"""


@query(snapshot_sql("'ECONOMY', 'LARGE', 'STANDARD', 'MEDIUM', 'PROMO'"))
def q_13_search_snapshot(t: Tables) -> DataFrame:
    return search_snapshot(t, ("ECONOMY", "LARGE", "STANDARD", "MEDIUM", "PROMO"))


@query(snapshot_sql("'SMALL'"))
def q_13_search_singles(t: Tables) -> DataFrame:
    return search_snapshot(t, ("SMALL",))


@query("SELECT title_id, title, artist, first_sale_date AS release_date FROM titles, (SELECT max(first_sale_date) AS m FROM titles) WHERE first_sale_date BETWEEN m - 21 AND m")
def q_14_snapshot_delta(t: Tables) -> DataFrame:
    m = t.titles.agg(F.max("first_sale_date").alias("m"))
    return t.titles.join(F.broadcast(m), F.col("first_sale_date").between(F.date_sub("m", 21), F.col("m"))).select("title_id", "title", "artist", F.col("first_sale_date").alias("release_date"))  # one row


def snapshot_delta(t: Tables, types: tuple[str, ...], days: int = 21, keyed: bool = False) -> DataFrame:
    """The search snapshot, without streams, of titles released in the last days; ``keyed``: only those with a main artist."""
    newest = t.titles.agg(F.date_sub(F.max("first_sale_date"), days).alias("since"))
    x = search_snapshot(t, types).drop("daily_streams").join(F.broadcast(newest), F.col("release_date") >= F.col("since")).drop("since")  # one row
    return x.filter("artist_id is not null") if keyed else x


def delta_sql(types: str, more: str = "") -> str:
    return f"SELECT * EXCLUDE (daily_streams) FROM ({snapshot_sql(types)}) WHERE release_date >= (SELECT max(first_sale_date) FROM titles) - 21{more}"


@query(delta_sql("'ECONOMY', 'LARGE', 'STANDARD', 'MEDIUM', 'PROMO'"))
def q_14_search_delta(t: Tables) -> DataFrame:
    return snapshot_delta(t, ("ECONOMY", "LARGE", "STANDARD", "MEDIUM", "PROMO"))


@query(delta_sql("'SMALL'", " AND artist_id IS NOT NULL"))
def q_14_singles_delta(t: Tables) -> DataFrame:
    return snapshot_delta(t, ("SMALL",), keyed=True)


@query("""WITH s AS (SELECT artist_id, artist, count(*) AS n, sum(streams) AS streams FROM (SELECT o.product_id AS artist_id, t.artist, (SELECT 1) AS one, coalesce(w.q, 0) AS streams FROM titles t JOIN owners o USING (title_id) LEFT JOIN (SELECT title_id, sum(quantity) AS q FROM title_weeks GROUP BY 1) w USING (title_id)) GROUP BY ALL),
    r AS (SELECT artist_id, artist, row_number() OVER (PARTITION BY artist_id ORDER BY n DESC, streams DESC, artist) AS rn FROM s)
    SELECT artist_id, max(CASE WHEN rn = 1 THEN artist END) AS name, CAST(sum(n) AS BIGINT) AS releases, CAST(sum(streams) AS BIGINT) AS streams FROM s JOIN r USING (artist_id, artist) GROUP BY 1""")
def q_15_artist_rollup(t: Tables) -> DataFrame:
    """Per artist: releases, streams, and the billing name that most releases carry."""
    total = t.title_weeks.groupBy("title_id").agg(F.sum("quantity").alias("q"))
    rows = t.titles.join(t.owners.select("title_id", F.col("product_id").alias("artist_id")), "title_id").join(total, "title_id", "left")
    s = rows.groupBy("artist_id", "artist").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("q", F.lit(0))).alias("streams"))
    rank = F.row_number().over(Window.partitionBy("artist_id").orderBy(F.desc("n"), F.desc("streams"), "artist"))
    return s.withColumn("rn", rank).groupBy("artist_id").agg(F.max(F.when(F.col("rn") == 1, F.col("artist"))).alias("name"), F.sum("n").alias("releases"), F.sum("streams").alias("streams"))


@query("SELECT level_2, CAST(count(*) AS BIGINT) AS releases, CAST(sum(q) AS BIGINT) AS streams FROM owners JOIN (SELECT title_id, sum(quantity) AS q FROM title_weeks GROUP BY 1) USING (title_id) WHERE level_2 IS NOT NULL GROUP BY 1")
def q_16_distributor_rollup(t: Tables) -> DataFrame:
    total = t.title_weeks.groupBy("title_id").agg(F.sum("quantity").alias("q"))
    return t.owners.filter("level_2 is not null").join(total, "title_id").groupBy("level_2").agg(F.count(F.lit(1)).alias("releases"), F.sum("q").alias("streams"))


@query("SELECT week_end, CAST(sum(CASE WHEN level_1 = 'ASIA' THEN ae ELSE 0 END) AS DOUBLE) AS asia, CAST(sum(CASE WHEN level_1 = 'AMERICA' THEN ae ELSE 0 END) AS DOUBLE) AS america, CAST(sum(ae) AS DOUBLE) AS market FROM title_weeks LEFT JOIN owners USING (title_id) WHERE ae >= 75000 GROUP BY 1")
def q_17_large_titles(t: Tables) -> DataFrame:
    rows = t.title_weeks.filter(F.col("ae") >= LARGE).join(t.owners, "title_id", "left")
    return rows.groupBy("week_end").agg(*sums("ae", "level_1", {"ASIA": "asia", "AMERICA": "america"}), F.sum("ae").cast(DOUBLE).alias("market"))


def debut_flags(t: Tables) -> DataFrame:
    rows = t.title_weeks.filter(F.col("ae") >= LARGE).join(t.titles.select("title_id", "first_sale_date"), "title_id")
    return rows.filter(F.col("first_sale_date").between(F.date_sub("week_end", 7), F.col("week_end"))).join(t.owners.select("title_id", "level_1"), "title_id", "left")


FLAGS = {x: "big_" + x.lower().replace(" ", "_") for x in REGIONS}
FLAG_SQL = ", ".join(f"CAST(max(CASE WHEN level_1 = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {v}" for k, v in FLAGS.items())
DEBUT_SQL = "debuts AS (SELECT w.week_end, level_1 FROM title_weeks w JOIN titles t ON t.title_id = w.title_id AND t.first_sale_date BETWEEN w.week_end - 7 AND w.week_end LEFT JOIN owners o ON o.title_id = w.title_id WHERE w.ae >= 75000)"


@query(f"WITH {DEBUT_SQL} SELECT week_end, {FLAG_SQL} FROM debuts GROUP BY 1")
def q_18_big_release_flags(t: Tables) -> DataFrame:
    return debut_flags(t).groupBy("week_end").agg(*[R.any_flag(F.col("level_1") == k).alias(v) for k, v in FLAGS.items()])


VOLUMES = {x: x.lower().replace(" ", "_") + "_albums" for x in REGIONS}


@query(f"""WITH {DEBUT_SQL}, v AS (SELECT week_end, {sql_sums('ae', 'level_1', VOLUMES)}, CAST(sum(ae) AS DOUBLE) AS market_albums FROM title_weeks LEFT JOIN owners USING (title_id) WHERE ae >= 75000 GROUP BY 1), f AS (SELECT week_end, {FLAG_SQL} FROM debuts GROUP BY 1)
    SELECT v.*, {', '.join(f'coalesce({x}, 0) AS {x}' for x in FLAGS.values())} FROM v LEFT JOIN f USING (week_end)""")
def q_19_large_titles_with_flags(t: Tables) -> DataFrame:
    rows = t.title_weeks.filter(F.col("ae") >= LARGE).join(t.owners, "title_id", "left")
    v = rows.groupBy("week_end").agg(*sums("ae", "level_1", VOLUMES), F.sum("ae").cast(DOUBLE).alias("market_albums"))
    return v.join(q_18_big_release_flags(t), "week_end", "left").na.fill(0, list(FLAGS.values()))


@query("SELECT week_end, label, CAST(ae AS DOUBLE) AS ae, share FROM panel WHERE label IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') AND year >= 1998")
def q_20_panel_all(t: Tables) -> DataFrame:
    return t.panel_since("1998-01-01").filter(F.col("label").isin(*LABELS)).select("week_end", "label", d("ae"), "share")


@query(f"""WITH q AS (SELECT DISTINCT w.title_id FROM title_weeks w JOIN titles t ON t.title_id = w.title_id AND t.first_sale_date BETWEEN w.week_end - 7 AND w.week_end)
    SELECT f.title_id, week_end, CAST(ceil((week_end - first_sale_date) / 7.0) AS BIGINT) AS weeks_since_release, {sql_sums('ae', 'category', FOUR)}, CAST(sum(ae) AS DOUBLE) AS total FROM daily_fact f JOIN q USING (title_id) JOIN titles USING (title_id)
    WHERE report_date >= first_sale_date AND report_date < first_sale_date + INTERVAL 18 MONTH GROUP BY ALL""")
def q_21_lifecycle_panel(t: Tables) -> DataFrame:
    """Weeks of the first eighteen months of titles that debut within the data."""
    dates = t.titles.select("title_id", "first_sale_date")
    debuts = t.title_weeks.join(dates, "title_id").filter(F.col("first_sale_date").between(F.date_sub("week_end", 7), F.col("week_end"))).select("title_id").distinct()
    rows = t.daily_fact.join(dates, "title_id").filter((F.col("report_date") >= F.col("first_sale_date")) & (F.col("report_date") < F.add_months("first_sale_date", 18))).join(debuts, "title_id", "left_semi")
    return rows.groupBy("title_id", "week_end", C.weeks_since("week_end", "first_sale_date").alias("weeks_since_release")).agg(*sums("ae", "category", FOUR), F.sum("ae").cast(DOUBLE).alias("total"))


@query("""WITH s AS (SELECT title_id, week_end, CAST(sum(CASE WHEN category = 'Streams' THEN quantity ELSE 0 END) AS BIGINT) AS streams FROM daily_fact GROUP BY ALL)
    SELECT *, lag(streams) OVER (PARTITION BY title_id ORDER BY week_end) AS lag_1 FROM s WHERE streams > 0""")
def q_22_worldwide_panel(t: Tables) -> DataFrame:
    s = t.daily_fact.groupBy("title_id", "week_end").agg(F.sum(F.when(F.col("category") == "Streams", F.col("quantity")).otherwise(0)).alias("streams")).filter("streams > 0")
    return s.withColumn("lag_1", F.lag("streams").over(Window.partitionBy("title_id").orderBy("week_end")))


def fiscal_shares(t: Tables, period: str) -> DataFrame:
    """Share of each label in a fiscal month or quarter, growth over the year before, and the change in basis points."""
    p = C.fiscal_month("day") if period == "month" else C.fiscal_quarter("day")
    g = t.orders.groupBy(C.fiscal_year("day").alias("fy"), p.alias("period"), "label").agg(F.sum("ae").alias("ae"), F.max("day").alias("last_day"))
    m = t.orders.groupBy(C.fiscal_year("day").alias("fy"), p.alias("period")).agg(F.sum("ae").alias("market"))
    x = g.join(m, ["fy", "period"]).withColumn("ae", d("ae")).withColumn("market", d("market")).withColumn("share", C.div0("ae", "market"))
    w = Window.partitionBy("label", "period").orderBy("fy")
    prev = F.lag("ae").over(w)
    return x.select(
        "fy", "period", "label", "last_day", "ae", F.round("share", 8).alias("share"), F.round(C.div0(F.col("ae") - prev, prev), 6).alias("growth"), F.round((F.col("share") - F.lag("share").over(w)) * 10000, 4).alias("share_change_bps"),
    )


def fiscal_sql(period: str) -> str:
    p = "(month(day) + 3) % 12 + 1" if period == "month" else "ceil(((month(day) + 3) % 12 + 1) / 3.0)"
    return f"""WITH g AS (SELECT CAST(year(day) + CASE WHEN month(day) >= 9 THEN 1 ELSE 0 END AS BIGINT) AS fy, CAST({p} AS BIGINT) AS period, label, CAST(sum(ae) AS DOUBLE) AS ae, max(day) AS last_day FROM order_rows GROUP BY ALL),
    x AS (SELECT *, ae / sum(ae) OVER (PARTITION BY fy, period) AS share FROM g)
    SELECT fy, period, label, last_day, ae, round(share, 8) AS share, round((ae - lag(ae) OVER w) / nullif(lag(ae) OVER w, 0), 6) AS growth, round((share - lag(share) OVER w) * 10000, 4) AS share_change_bps FROM x WINDOW w AS (PARTITION BY label, period ORDER BY fy)"""


@query(fiscal_sql("month"))
def q_24_fiscal_month_shares(t: Tables) -> DataFrame:
    return fiscal_shares(t, "month")


@query(fiscal_sql("quarter"))
def q_25_fiscal_quarter_shares(t: Tables) -> DataFrame:
    return fiscal_shares(t, "quarter")


@query(f"WITH x AS ({fiscal_sql('month')}) SELECT fy, period, CAST(sum(ae) AS DOUBLE) AS ae, round(sum(share), 6) AS share, CASE WHEN max(last_day) < last_day(max(last_day)) THEN strftime(max(last_day), '%b') || ' - (END ' || strftime(max(last_day), '%b %d') || ')' ELSE strftime(max(last_day), '%b') END AS label FROM x WHERE label IN ('BUILDING', 'MACHINERY') GROUP BY ALL".replace("CAST(sum(ae) AS DOUBLE) AS ae, round(sum(share)", "round(sum(ae), 2) AS ae, round(sum(share)"))
def q_23_fiscal_group_share(t: Tables) -> DataFrame:
    x = fiscal_shares(t, "month").filter(F.col("label").isin(ANCHOR, "MACHINERY"))
    return x.groupBy("fy", "period").agg(F.round(F.sum("ae"), 2).alias("ae"), F.round(F.sum("share"), 6).alias("share"), C.fiscal_month_label(F.max("last_day")).alias("label"))


@query("SELECT max(day) AS max_day FROM order_rows WHERE label = 'BUILDING'")
def q_25_max_day(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("label") == ANCHOR).agg(F.max("day").alias("max_day"))


@query("SELECT title_id, title, artist, first_sale_date, CASE WHEN size % 5 = 0 THEN NULL ELSE 'genre ' || CAST(size % 7 AS VARCHAR) END AS genre FROM titles")
def q_26_metadata_genre(t: Tables) -> DataFrame:
    """Genre of the preferred provider from a JSON list; null where only others have one."""
    provider = F.when(F.col("size") % 5 == 0, F.lit("other")).otherwise(F.lit("main"))
    doc = F.to_json(F.array(F.struct(F.lit("third").alias("domain"), F.lit("x").alias("genre")), F.struct(provider.alias("domain"), F.concat(F.lit("genre "), (F.col("size") % 7).cast("string")).alias("genre"))))
    parsed = F.from_json(doc, "array<struct<domain: string, genre: string>>")
    return t.titles.select("title_id", "title", "artist", "first_sale_date", F.get(F.filter(parsed, lambda x: x["domain"] == "main"), 0)["genre"].alias("genre"))


@query("""WITH s AS (SELECT title_id, CAST(sum(quantity) AS BIGINT) AS streams FROM daily_fact WHERE category = 'Streams' GROUP BY 1)
    SELECT title_id, level_1, round(CAST(any_value(streams) * sum(units) AS DOUBLE) / CAST(any_value(tot) AS DOUBLE), 4) AS weighted FROM (SELECT *, sum(units) OVER (PARTITION BY title_id) AS tot FROM ownership) JOIN s USING (title_id) GROUP BY ALL""")
def q_27_weighted_share(t: Tables) -> DataFrame:
    s = t.facts("Streams").groupBy("title_id").agg(F.sum("quantity").alias("streams"))
    total = F.sum("units").over(Window.partitionBy("title_id"))
    owned = t.ownership.withColumn("total", total).groupBy("title_id", "level_1", "total").agg(F.sum("units").alias("units"))
    return owned.join(s, "title_id").select("title_id", "level_1", F.round((F.col("streams") * F.col("units")).cast(DOUBLE) / F.col("total").cast(DOUBLE), 4).alias("weighted"))


def peaks_since(t: Tables, floor: int) -> DataFrame:
    as_of = t.daily_fact.agg(F.max("report_date").alias("as_of"))
    weeks = t.title_weeks.filter(F.col("ae") >= floor).join(F.broadcast(as_of), F.col("week_end") >= F.date_sub("as_of", 7 * 78))  # one row
    best = W.top_n_per_group(weeks, ["title_id"], [F.col("ae").desc(), F.col("week_end")])
    return best.join(t.titles, "title_id").join(t.owners, "title_id", "left").select("title_id", "title", "artist", F.col("level_1").alias("owner"), "first_sale_date", F.col("week_end").alias("peak_week"), F.col("ae").cast(DOUBLE).alias("peak"))


def peaks_sql(floor: int) -> str:
    return f"""WITH w AS (SELECT title_id, week_end, ae FROM title_weeks, (SELECT max(report_date) AS as_of FROM daily_fact) WHERE ae >= {floor} AND week_end >= as_of - 546 QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY ae DESC, week_end) = 1)
    SELECT title_id, title, artist, level_1 AS owner, first_sale_date, week_end AS peak_week, CAST(w.ae AS DOUBLE) AS peak FROM w JOIN titles USING (title_id) LEFT JOIN owners USING (title_id)"""


@query(peaks_sql(75000))
def q_28_backfill_candidates(t: Tables) -> DataFrame:
    return peaks_since(t, LARGE)


@query("SELECT title_id, title, coalesce(nullif(trim(release_type), ''), 'Album') AS release_type, first_sale_date FROM titles WHERE artist = 'Brand#17' ORDER BY first_sale_date DESC NULLS LAST, title_id LIMIT 50")
def q_29_discography(t: Tables) -> DataFrame:
    rows = t.titles.filter("artist = 'Brand#17'").select("title_id", "title", C.text_or("release_type", "Album").alias("release_type"), "first_sale_date")
    return rows.orderBy(F.col("first_sale_date").desc_nulls_last(), "title_id").limit(50)


@query("WITH n AS (SELECT count(*) AS n FROM titles JOIN owners USING (title_id) WHERE level_1 = 'ASIA') SELECT title_id, title, level_2, n > 50 AS has_more, CASE WHEN n > 50 THEN CAST(50 AS BIGINT) END AS next_offset FROM titles JOIN owners USING (title_id), n WHERE level_1 = 'ASIA' ORDER BY first_sale_date DESC NULLS LAST, title_id LIMIT 50")
def q_29_by_distributor(t: Tables) -> DataFrame:
    rows = t.titles.join(t.owners.filter("level_1 = 'ASIA'"), "title_id").select("title_id", "title", "level_2", "first_sale_date")
    return R.page(rows, [F.col("first_sale_date").desc_nulls_last(), F.col("title_id")], 50).drop("first_sale_date")


@query("SELECT DISTINCT title_id, title, level_3, CAST(year(first_sale_date) AS BIGINT) AS y, CAST(quarter(first_sale_date) AS BIGINT) AS q FROM titles JOIN owners USING (title_id) WHERE level_3 IN (SELECT level_3 FROM suppliers WHERE level_1 = 'EUROPE')")
def q_30_by_label(t: Tables) -> DataFrame:
    labels = t.suppliers.filter("level_1 = 'EUROPE'").select("level_3")
    rows = t.titles.join(t.owners.select("title_id", "level_3"), "title_id").join(labels, "level_3", "left_semi")
    return rows.select("title_id", "title", "level_3", F.year("first_sale_date").cast("long").alias("y"), F.quarter("first_sale_date").cast("long").alias("q")).distinct()


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, ltrim(CAST(page_id AS VARCHAR), '0') AS code FROM pages WHERE page_id IN (SELECT title_id FROM titles)")
def q_31_artwork_urls(t: Tables) -> DataFrame:
    """Addresses by a normalised code: leading zeros do not count."""
    pages = t.raw("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.expr("trim(LEADING '0' FROM cast(page_id as string))").alias("code"))
    known = t.titles.select(F.expr("trim(LEADING '0' FROM lpad(cast(title_id as string), 12, '0'))").alias("code"))
    return pages.join(known, "code", "left_semi").select("page_id", "host", "code")


@query(f"""WITH {ARTISTS_SQL}, m AS (SELECT DISTINCT a.product_id AS artist_id FROM (SELECT title_id, unnest(artists) AS a FROM artists) WHERE a.role = 'main')
    SELECT artist_id, s_name AS artist, url AS profile_image FROM m JOIN supplier ON s_suppkey = artist_id JOIN pages ON page_id % 1000 = artist_id WHERE trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY artist_id ORDER BY url DESC) = 1""")
def q_31_artist_artwork(t: Tables) -> DataFrame:
    """The profile image of each main artist of a title: of several addresses that are not blank, the greatest."""
    main = title_artists(t).select(F.explode("artists").alias("a")).filter("a.role = 'main'").select(F.col("a.product_id").alias("artist_id")).distinct()
    names = t.raw("supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("artist"))
    images = t.raw("pages").filter(F.trim("url") != "").groupBy(F.pmod("page_id", F.lit(1000)).alias("artist_id")).agg(F.max("url").alias("profile_image"))
    return main.join(names, "artist_id").join(images, "artist_id").select("artist_id", "artist", "profile_image")


@query(f"WITH {ARTISTS_SQL} SELECT title_id, a.product_id AS artist_id FROM (SELECT title_id, unnest(artists) AS a FROM artists WHERE title_id IN (2, 4, 8, 16, 32, 64)) WHERE a.role = 'main'")
def q_32_main_artists(t: Tables) -> DataFrame:
    rows = R.with_ids(title_artists(t), "title_id", (2, 4, 8, 16, 32, 64)).select("title_id", F.posexplode("artists").alias("pos", "a")).filter("a.role = 'main'")
    return W.top_n_per_group(rows, ["title_id"], [F.col("pos")]).select("title_id", F.col("a.product_id").alias("artist_id"))


@query(peaks_sql(100000))
def q_34_roster(t: Tables) -> DataFrame:
    return peaks_since(t, ROSTER)


@query("SELECT week_end, CAST(ae AS DOUBLE) AS ae, quantity FROM title_weeks WHERE title_id = 11 ORDER BY week_end")
def q_35_series_read(t: Tables) -> DataFrame:
    return t.title_weeks.filter("title_id = 11").select("week_end", d("ae"), "quantity").orderBy("week_end")


@query("SELECT week_end, year, label, share FROM panel WHERE week_end > DATE '2000-06-01'")
def q_36_panel_pull(t: Tables) -> DataFrame:
    return t.panel_since("2000-06-02").select("week_end", "year", "label", "share")


@query("""SELECT level_1, level_2, level_3, CAST(year(report_date) + CASE WHEN month(report_date) >= 9 THEN 1 ELSE 0 END AS BIGINT) AS fy, CAST(sum(quantity) AS BIGINT) AS streams, round(CAST(sum(quantity) AS DOUBLE) * 0.004::DOUBLE, 4) AS proxy_revenue
    FROM daily_fact JOIN suppliers USING (product_id) WHERE category = 'Streams' GROUP BY ALL""")
def q_37_proxy_revenue(t: Tables) -> DataFrame:
    rows = t.facts("Streams").join(t.suppliers, "product_id").groupBy("level_1", "level_2", "level_3", C.fiscal_year("report_date").alias("fy")).agg(F.sum("quantity").alias("streams"))
    return rows.withColumn("proxy_revenue", F.round(F.col("streams") * 0.004, 4))  # fixed value: money for a stream


@query("SELECT label, week_end, CAST(sum(ae) OVER (PARTITION BY label ORDER BY week_end) AS DOUBLE) AS ytd FROM panel WHERE year = (SELECT max(year) FROM panel)")
def q_38_ytd_actuals(t: Tables) -> DataFrame:
    latest = t.panel.agg(F.max("year").alias("year"))
    return t.panel.join(latest, "year").select("label", "week_end", W.running_sum(F.col("ae"), Window.partitionBy("label").orderBy("week_end")).cast(DOUBLE).alias("ytd"))


@query("""SELECT 'ALBUM' AS kind, title_id AS id, CASE WHEN total >= 1000000 THEN 'PLATINUM' ELSE 'GOLD' END AS certification FROM (SELECT title_id, sum(ae) AS total FROM title_weeks GROUP BY 1) WHERE total >= 500000
    UNION ALL SELECT 'LABEL', product_id, CASE WHEN total >= 20000000 THEN 'PLATINUM' ELSE 'GOLD' END FROM (SELECT product_id, sum(ae) AS total FROM daily_fact GROUP BY 1) WHERE total >= 10000000""")
def q_39_certifications(t: Tables) -> DataFrame:
    def award(rows: DataFrame, kind: str, key: str, gold: int) -> DataFrame:
        return rows.filter(F.col("total") >= gold).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.when(F.col("total") >= 2 * gold, "PLATINUM").otherwise("GOLD").alias("certification"))

    a = t.title_weeks.groupBy("title_id").agg(F.sum("ae").alias("total"))
    b = t.daily_fact.groupBy("product_id").agg(F.sum("ae").alias("total"))
    return award(a, "ALBUM", "title_id", 500_000).unionByName(award(b, "LABEL", "product_id", 10_000_000))


@query("SELECT title_id AS release_id, CASE WHEN title_id = 3 THEN 'renamed' ELSE title END AS title FROM titles WHERE title_id BETWEEN 1 AND 10 AND title_id <> 5 UNION ALL SELECT 1000001, 'created'")
def q_40_release_crud(t: Tables) -> DataFrame:
    """Create, update, delete and list on a keyed table: each is a new table, made by an upsert or an anti-join."""
    from ..operators.incremental import merge_upsert

    base = t.titles.filter("title_id between 1 and 10").select(F.col("title_id").alias("release_id"), "title")
    changed = t.spark.createDataFrame([(3, "renamed"), (1_000_001, "created")], base.schema)
    gone = t.spark.createDataFrame([(5,)], "release_id bigint")
    return merge_upsert(base, changed, ["release_id"]).join(gone, "release_id", "left_anti")


@query("SELECT product_id, level_2 FROM suppliers WHERE level_2 ILIKE 'nation\\_1%' ESCAPE '\\' ORDER BY lower(level_2), product_id LIMIT 20".replace("\\\\", "\\"))
def q_33_distributor_typeahead(t: Tables) -> DataFrame:
    pattern = C.like_literal("nation_1") + "%"
    return t.suppliers.filter(F.col("level_2").ilike(pattern)).orderBy(F.lower("level_2"), "product_id").limit(20).select("product_id", "level_2")
