"""Incremental refresh, upserts, search, streaming twins and the snapshot, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import incremental as I
from ..operators import search
from ..sources.models import ModelStore
from ..sources.files import csv_lines, json_records
from ..sources.stored import new_path
from ..sources.tables import Tables
from ..streaming import weekly as S
from .registry import query

DOUBLE = "double"


def stored(t: Tables) -> DataFrame:
    """What an earlier refresh left: all weeks but the last three."""
    last = t.panel.agg(F.max("week_end").alias("m"))
    return t.panel.join(F.broadcast(last), F.col("week_end") <= F.date_sub("m", 21)).select("label", "week_end", F.col("ae").cast(DOUBLE).alias("ae"), F.lit("stored").alias("source"))  # one row


STORED_SQL = "st AS (SELECT label, week_end, CAST(ae AS DOUBLE) AS ae, 'stored' AS source FROM panel WHERE week_end <= (SELECT max(week_end) FROM panel) - 21)"


def arrived(t: Tables) -> DataFrame:
    fresh = t.panel.select("label", "week_end", (F.col("ae").cast(DOUBLE) * 2).alias("ae"), F.lit("new").alias("source"))
    return I.overlap(fresh, stored(t), "week_end", 14)


ARRIVED_SQL = "ar AS (SELECT label, week_end, CAST(ae AS DOUBLE) * 2 AS ae, 'new' AS source FROM panel WHERE week_end >= (SELECT max(week_end) FROM st) - 14)"


@query(f"WITH {STORED_SQL}, {ARRIVED_SQL} SELECT * FROM ar")
def incr_overlap(t: Tables) -> DataFrame:
    """Rows to be read again: from two weeks before what is stored."""
    return arrived(t)


@query(f"WITH {STORED_SQL} SELECT coalesce(max(week_end), DATE '2018-01-01') AS anchor FROM st")
def incr_anchor(t: Tables) -> DataFrame:
    return I.anchor(stored(t), "week_end")


@query(f"WITH {STORED_SQL}, {ARRIVED_SQL} SELECT * FROM ar UNION ALL SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM ar WHERE ar.label = st.label AND ar.week_end = st.week_end)")
def upsert_full(t: Tables) -> DataFrame:
    return I.merge_upsert(stored(t), arrived(t), ["label", "week_end"])


@query(f"WITH {STORED_SQL}, {ARRIVED_SQL} SELECT label, week_end, coalesce(st.ae, ar.ae) AS ae, coalesce(ar.source, st.source) AS source FROM st FULL JOIN ar USING (label, week_end)")
def upsert_partial(t: Tables) -> DataFrame:
    """Only the source column is overwritten; volumes that are stored stay."""
    return I.merge_upsert(stored(t), arrived(t), ["label", "week_end"], ["source"])


@query(f"WITH {STORED_SQL}, {ARRIVED_SQL} SELECT label, week_end, ae, source FROM (SELECT *, 1 AS p FROM ar UNION ALL SELECT *, 0 FROM st) QUALIFY row_number() OVER (PARTITION BY label, week_end ORDER BY p DESC) = 1")
def incr_keep_last(t: Tables) -> DataFrame:
    return I.keep_last(stored(t), arrived(t), ["label", "week_end"])


@query("SELECT title_id, coalesce(nullif(trim(CASE WHEN title_id % 4 = 0 THEN ' ' ELSE title END), ''), level_3) AS title FROM titles LEFT JOIN owners USING (title_id)")
def incr_fill_missing(t: Tables) -> DataFrame:
    target = t.titles.select("title_id", F.when(F.col("title_id") % 4 == 0, " ").otherwise(F.col("title")).alias("title"))
    return I.fill_missing(target, t.owners.select("title_id", F.col("level_3").alias("title")), ["title_id"], ["title"])


@query("""WITH l AS (SELECT title_id, max(report_date) AS last_day, max(week_end) AS last_week FROM daily_fact GROUP BY 1), a AS (SELECT max(report_date) AS as_of FROM daily_fact)
    SELECT title_id, as_of - last_day <= 2 AS fresh_daily, last_week >= as_of - CAST((isodow(as_of) + 2) % 7 + 1 AS INTEGER) OR as_of - last_week <= 6 AS fresh_weekly FROM l, a""")
def freshness(t: Tables) -> DataFrame:
    latest = t.daily_fact.groupBy("title_id").agg(F.max("report_date").alias("last_day"), F.max("week_end").alias("last_week"))
    x = latest.crossJoin(F.broadcast(t.daily_fact.agg(F.max("report_date").alias("as_of"))))  # one row
    return x.select("title_id", I.fresh_daily(F.col("last_day"), F.col("as_of")).alias("fresh_daily"), I.fresh_weekly(F.col("last_week"), F.col("as_of")).alias("fresh_weekly"))


@query("""WITH w AS (SELECT label, week_end, CAST(ae AS DOUBLE) AS ae, lag(CAST(ae AS DOUBLE)) OVER (PARTITION BY label ORDER BY week_end) AS prev, row_number() OVER (PARTITION BY label ORDER BY week_end DESC) AS back FROM panel)
    SELECT label, week_end, ae FROM w WHERE NOT (back = 1 AND ae < 0.75 * prev)""")
def incr_partial_week(t: Tables) -> DataFrame:
    """Series without a last week that is far below the one before: it is not over yet."""
    w = Window.partitionBy("label")
    x = t.panel.select("label", "week_end", F.col("ae").cast(DOUBLE).alias("ae"))
    x = x.withColumn("prev", F.lag("ae").over(w.orderBy("week_end"))).withColumn("back", F.row_number().over(w.orderBy(F.desc("week_end"))))
    return x.filter(F.coalesce(~((F.col("back") == 1) & (F.col("ae") < 0.75 * F.col("prev"))), F.lit(True))).select("label", "week_end", "ae")


def both_refreshes(t: Tables) -> tuple[DataFrame, DataFrame]:
    return stored(t), t.panel.select("label", "week_end", F.col("ae").cast(DOUBLE).alias("ae"), F.lit("new").alias("source"))


@query(f"WITH {STORED_SQL} SELECT 'advanced' AS run, label, week_end, CAST(ae AS DOUBLE) AS ae, 'new' AS source FROM panel UNION ALL SELECT 'no-op', label, week_end, ae, source FROM st")
def incr_if_advanced(t: Tables) -> DataFrame:
    """A refresh whose source is ahead of what is stored takes the source; one whose source is not changes nothing."""
    old, new = both_refreshes(t)
    same = old.withColumn("source", F.lit("new"))  # as far as what is stored
    runs = I.refreshed_if_advanced(old, new, "week_end").withColumn("run", F.lit("advanced")), I.refreshed_if_advanced(old, same, "week_end").withColumn("run", F.lit("no-op"))
    return runs[0].unionByName(runs[1])


@query("SELECT label, week_end, CAST(ae AS DOUBLE) AS ae, 'new' AS source FROM panel")
def incr_delete_reload(t: Tables) -> DataFrame:
    """What is stored goes as a whole and the source comes, in one version."""
    table = I.VersionedTable(t.spark, new_path(t.spark, "reload"))
    for rows in both_refreshes(t):
        table.reload(rows)
    table.vacuum(keep=1)
    return table.read()


@query("""WITH l AS (SELECT label, max(week_end) AS last FROM panel GROUP BY 1), d AS (SELECT max(day) AS as_of FROM order_rows) SELECT label, week_end, CAST(ae AS DOUBLE) AS ae FROM panel JOIN l USING (label), d WHERE NOT (week_end = last AND last >= as_of - 3)""")
def incr_strip_partial(t: Tables) -> DataFrame:
    """Series without the week in progress: one that ends less than three days before the last day of the data."""
    as_of = t.orders.agg(F.max("day").alias("as_of"))
    x = t.panel.select("label", "week_end", F.col("ae").cast(DOUBLE).alias("ae")).crossJoin(F.broadcast(as_of))  # one row
    return I.without_partial_week(x, ["label"], "week_end", F.col("as_of")).drop("as_of")


@query(f"WITH {STORED_SQL}, {ARRIVED_SQL} SELECT label, week_end, ae, source FROM (SELECT *, 1 AS p FROM ar UNION ALL SELECT *, 0 FROM st) QUALIFY row_number() OVER (PARTITION BY label, week_end ORDER BY p DESC) = 1")
def sink_csv_merge(t: Tables) -> DataFrame:
    """A report kept as CSV: each run reads it, adds its rows, keeps the last of each key, and writes the next version."""
    table = I.VersionedTable(t.spark, new_path(t.spark, "report"), "csv", header="true")
    for rows in (stored(t), arrived(t)):
        table.append_merge(rows, ["label", "week_end"])
    return table.read()


@query("SELECT label || ',' || strftime(week_end, '%Y-%m-%d') || ',' || CAST(round(share * 100, 2) AS VARCHAR) AS line FROM panel")
def sink_csv_lines(t: Tables) -> DataFrame:
    return csv_lines(t.panel.select("label", "week_end", (F.col("share") * 100).alias("percent")), ["percent"])


@query("SELECT label, CAST(count(*) AS BIGINT) AS weeks, CAST(max(ae) AS DOUBLE) AS peak, CAST(0.82 AS DOUBLE) AS band FROM panel GROUP BY 1")
def sink_artifacts(t: Tables) -> DataFrame:
    """A model's tables and settings, saved and loaded again."""
    root = new_path(t.spark, "model")
    peaks = t.panel.groupBy("label").agg(F.count(F.lit(1)).alias("weeks"), F.max("ae").cast(DOUBLE).alias("peak"))
    I.save_artifacts(t.spark, root, {"peaks": peaks}, {"band": 0.82})
    tables, settings = I.load_artifacts(t.spark, root)
    return tables["peaks"].withColumn("band", F.lit(settings["band"]))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) + CAST((4 - isodow(ts) + 7) % 7 AS INTEGER) AS week_end, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def stream_weekly(t: Tables) -> DataFrame:
    """The streaming aggregation run to the end of the input; equals the batch one, as a table's files come in any order of time."""
    return S.drained(S.weekly(S.event_stream(t.spark, t.directory), late=None), "update", ["week_end", "event_type"])


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def stream_running_totals(t: Tables) -> DataFrame:
    return S.drained(S.running_totals(S.event_stream(t.spark, t.directory)), "update", ["user_id"])


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    """Every event once, however often it is sent."""
    events = S.event_stream(t.spark, t.directory)
    twice = events.unionByName(S.event_stream(t.spark, t.directory))
    return S.drained(S.deduplicated(twice, ["event_id"], late=None)).select("event_id", "user_id", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, CAST(count(DISTINCT k) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS events FROM s GROUP BY 1""")
def session_counts(t: Tables) -> DataFrame:
    x = t.events.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


@query()
def typeahead_titles(t: Tables) -> DataFrame:
    names = t.titles.groupBy("title").agg(F.count(F.lit(1)).alias("releases"))
    return search.typeahead(names, "title", "Red  wid", "releases")


@query("""WITH y AS (SELECT title_id, CAST(size AS DOUBLE) AS x, ln(1 + CAST(sum(ae) AS DOUBLE)) AS y FROM title_weeks JOIN titles USING (title_id) GROUP BY ALL), m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM y)
    SELECT title_id, CAST(1 AS BIGINT) AS version, round(b + a * x, 6) AS expected FROM y, m""")
def sink_model(t: Tables) -> DataFrame:
    """A fitted pipeline that is stored, and what it says to every title when it is loaded again."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = t.title_weeks.groupBy("title_id").agg(F.log1p(F.sum("ae").cast(DOUBLE)).alias("y")).join(t.titles.select("title_id", F.col("size").cast(DOUBLE).alias("x")), "title_id")
    stages = [VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y", solver="normal")]
    store = ModelStore(t.spark, new_path(t.spark, "models"))
    version = store.save(Pipeline(stages=stages).fit(rows), rows, query="sink_model")
    return store.predict(rows).select("title_id", F.lit(version).cast("long").alias("version"), F.round("prediction", 6).alias("expected"))


def misspelt(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Names of suppliers and brands, and what people might write for them: as they are, in upper case, short of a letter, with two exchanged, shortened, or others."""
    suppliers = t.raw("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("n"))
    brands = t.raw("part").select(F.col("p_brand").alias("name")).distinct().withColumn("n", F.substring("name", -1, 1).cast("long") * 3 + 2)
    known = suppliers.unionByName(brands)
    name, kind = F.col("name"), F.col("n") % 7
    cut = lambda first, size=None: F.substr(name, F.lit(first), F.lit(size) if size else F.char_length("name"))
    written_so = F.when(kind == 0, name).when(kind == 1, F.upper("name")).when(kind == 2, F.concat(cut(1, 3), cut(5))).when(kind == 3, F.concat(cut(1, 1), cut(3, 1), cut(2, 1), cut(4)))
    written_so = written_so.when(kind == 4, F.concat(F.lit("The "), name, F.lit(" Ltd."))).when(kind == 5, F.concat(F.reverse(name), F.lit("?"))).otherwise(F.concat(F.lit("x"), cut(2, 2), cut(6)))
    return known.select("name"), known.select(written_so.alias("name"))


@query()
def fuzzy_names(t: Tables) -> DataFrame:
    """What each misspelt name stands for: itself, the most similar, up to ten that are alike, or nothing."""
    known, asked = misspelt(t)
    return search.known_or_close(known, asked).withColumn("score", F.round("score", 9))


def blocks(t: Tables, *columns: str, size: int = 1000) -> DataFrame:
    """Titles of each artist in arrays of about ``size``: key, block, rows."""
    n = t.titles.groupBy(F.col("artist").alias("key")).agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    x = t.titles.withColumnRenamed("artist", "key").join(n, "key").withColumn("block", F.pmod(F.xxhash64("title_id"), F.col("blocks")))
    return x.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


@query("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(titles) AS BIGINT) AS titles FROM (SELECT artist, count(*) AS titles FROM titles GROUP BY 1)""")
def snapshot_counts(t: Tables) -> DataFrame:
    """Sections of the nested snapshot, counted after a round trip through JSON."""
    doc = blocks(t, "title_id", "title").withColumnRenamed("key", "artist").withColumnRenamed("rows", "releases")
    back = doc.select(F.from_json(F.to_json(F.struct("artist", "block", "releases")), "artist string, block bigint, releases array<struct<title_id: bigint, title: string>>").alias("d"))
    back = back.groupBy("d.artist").agg(F.sum(F.size("d.releases")).alias("titles"))
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("titles").alias("titles"))


@query()
def boot_snapshot(t: Tables) -> DataFrame:
    """JSON texts for each section and artist or label: releases in numbered blocks, weekly volumes, current rates with their day."""
    from .domain import rates

    releases = blocks(t, "title_id", "title", "first_sale_date")
    # at most a number for each week
    weeks = t.panel.groupBy(F.col("label").alias("key")).agg(F.array_sort(F.collect_list(F.struct("week_end", F.col("ae").cast(DOUBLE).alias("ae"), "share"))).alias("rows"))
    current = rates(t).groupBy("artist_id").agg(F.max_by(F.struct("rate", "calculated"), F.struct("calculated", "order_id")).alias("r")).select("artist_id", "r.*")
    r = current.select(F.lit("rates").alias("section"), F.col("artist_id").cast("string").alias("key"), F.lit(0).cast("long").alias("block"), F.to_json(F.struct("rate", F.col("calculated").alias("as_of"))).alias("value"))
    a = releases.select(F.lit("releases").alias("section"), "key", "block", F.to_json("rows").alias("value"))
    return a.unionByName(weeks.select(F.lit("weekly").alias("section"), "key", F.lit(0).cast("long").alias("block"), F.to_json("rows").alias("value"))).unionByName(r)


@query("SELECT '{\"label\":\"' || label || '\",\"week_end\":\"' || strftime(week_end, '%Y-%m-%d') || '\",\"quantity\":' || CAST(CAST(round_even(CAST(ae AS DOUBLE), 0) AS BIGINT) AS VARCHAR) || '}' AS value FROM panel")
def sink_json_records(t: Tables) -> DataFrame:
    return json_records(t.panel.select("label", "week_end", F.col("ae").cast(DOUBLE).alias("quantity")))


@query("SELECT title_id, '[{\"domain\":\"main\",\"genre\":\"' || lower(release_type) || '\"}]' AS genres FROM titles")
def json_wrap_genre(t: Tables) -> DataFrame:
    return t.titles.select("title_id", F.to_json(F.array(F.struct(F.lit("main").alias("domain"), F.lower("release_type").alias("genre")))).alias("genres"))


@query("SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS balance, lower(CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END) IN ('true', '1', 'yes', 't', 'y') AS flag, CASE WHEN c_custkey % 5 > 1 THEN CAST(c_custkey AS DOUBLE) / 4 END AS finite FROM customer")
def cast_or_null(t: Tables) -> DataFrame:
    c = t.raw("customer")
    text = F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_acctbal").cast("string"))
    flag = F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("no")
    return c.select("c_custkey", text.try_cast(DOUBLE).alias("balance"), C.truthy(flag).alias("flag"), C.number_or_null(F.when(F.col("c_custkey") % 5 == 0, "inf").when(F.col("c_custkey") % 5 == 1, "NaN").otherwise((F.col("c_custkey") / 4).cast("string"))).alias("finite"))
