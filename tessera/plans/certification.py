"""The certification panel: weeks of titles by channel with their running total, the shape of each title, and the part of its peak that it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..sources.tables import Tables
from .peers import CLASS_SQL
from .registry import query

DOUBLE = "double"
#: Weeks that the panel goes to.
HORIZON = 78
#: A title that is known beyond this week has a floor of its own, from its last weeks (most and least of them); limits of floors.
DEEP_WEEK, TAIL_MOST, TAIL_LEAST, FLOOR_LOW, FLOOR_HIGH = 52, 24, 12, 0.002, 0.15
CHANNELS = {"streams": "Streams", "sales": "ProductSales", "songs": "RecordingSales"}


def panel_weeks(t: Tables) -> DataFrame:
    """title_id, week_end, week (1 in the first week of sales), streams, sales, songs, total, cumulative."""
    zero = F.lit(0).cast("decimal(18,4)")
    channels = [F.sum(F.when(F.col("category") == c, F.col("ae")).otherwise(zero)).alias(n) for n, c in CHANNELS.items()]
    x = t.title_facts.groupBy("title_id", "week_end").agg(*channels, F.sum("ae").alias("total"))
    w = Window.partitionBy("title_id")
    x = x.withColumn("week", (F.datediff("week_end", F.min("week_end").over(w)) / 7).cast("long") + 1).filter(F.col("week") <= HORIZON)
    return x.withColumn("cumulative", W.running_sum(F.col("total"), w.orderBy("week")))


PANEL_SQL = f"""p0 AS (SELECT title_id, week_end, {", ".join(f"sum(CASE WHEN category = '{c}' THEN ae ELSE 0 END) AS {n}" for n, c in CHANNELS.items())}, sum(ae) AS total FROM daily_fact GROUP BY 1, 2),
    p1 AS (SELECT *, CAST((week_end - min(week_end) OVER (PARTITION BY title_id)) / 7 AS BIGINT) + 1 AS week FROM p0),
    cert AS (SELECT *, sum(total) OVER (PARTITION BY title_id ORDER BY week) AS cumulative FROM p1 WHERE week <= {HORIZON})"""


def title_shapes(panel: DataFrame) -> DataFrame:
    """Of titles that sold: peak, its week, first and last week against it, first week at half of it, decay, area, first week's channels, own floor, archetype by the week of the peak."""
    w = Window.partitionBy("title_id")
    x = panel.withColumns({"y": F.col("total").cast(DOUBLE), "peak": F.max(F.col("total").cast(DOUBLE)).over(w)}).filter("peak > 0")
    x = x.withColumns({"norm": F.col("y") / F.col("peak"), "peak_week": F.min(F.when(F.col("y") == F.col("peak"), F.col("week"))).over(w), "back": F.row_number().over(w.orderBy(F.desc("week")))})
    before, after = F.lag("norm").over(w.orderBy("week")), F.col("week") >= F.col("peak_week")
    x = x.withColumn("area", (F.col("norm") + before) / 2 * (F.col("week") - F.lag("week").over(w.orderBy("week"))))
    falls = after & (F.col("norm") > 0)
    first, late = F.col("week") == 1, F.col("back") <= TAIL_MOST
    one = x.groupBy("title_id").agg(
        F.max("peak").alias("peak"), F.max("peak_week").alias("peak_week"), F.max("week").alias("weeks"), F.count(F.lit(1)).alias("rows"),
        F.max(F.when(first, F.col("norm"))).alias("first"), F.max(F.when(F.col("back") == 1, F.col("norm"))).alias("last"),
        F.when(F.count(F.when(after, 1)) >= 2, F.coalesce(F.min(F.when(after & (F.col("norm") <= 0.5), F.col("week"))), F.max("week"))).alias("half_week"),
        F.when(F.count(F.when(falls, 1)) >= 3, F.regr_slope(F.when(falls, F.log("norm")), F.when(falls, F.col("week").cast(DOUBLE)))).alias("decay"),
        (F.coalesce(F.sum("area"), F.lit(0.0)) / F.max("week")).alias("area"),
        *[F.least(F.greatest(F.max(F.when(first & (F.col("total") > 0), F.col(n).cast(DOUBLE) / F.col("y"))), F.lit(0.0)), F.lit(1.0)).alias(f"{n}_ratio") for n in CHANNELS],
        F.median(F.when(late, F.col("y"))).alias("middle"), F.count(F.when(late, 1)).alias("late_rows"),
    )
    own = (F.col("weeks") > DEEP_WEEK) & (F.col("late_rows") >= TAIL_LEAST) & (F.col("middle") > 0)
    at = F.col("peak_week")
    one = one.withColumn("own_floor", F.when(own, F.least(F.greatest(F.col("middle") / F.col("peak"), F.lit(FLOOR_LOW)), F.lit(FLOOR_HIGH))))
    return one.withColumn("cluster", F.when(at <= 4, 0).when(at <= 12, 1).when(at <= 24, 2).otherwise(3).cast("long"))


def stored_shapes(t: Tables) -> DataFrame:
    """A row for each title, which its floor reads three times."""
    return t.stored("certification-shapes", lambda: title_shapes(t.stored("certification-panel", lambda: panel_weeks(t))))


def with_floor(shapes: DataFrame) -> DataFrame:
    """The floor of a title of its own, else the median of its archetype's, else of all; and which."""
    limited = lambda c: F.least(F.greatest(c, F.lit(FLOOR_LOW)), F.lit(FLOOR_HIGH))
    clusters = shapes.groupBy("cluster").agg(limited(F.median("own_floor")).alias("of_cluster"))
    every = shapes.agg(limited(F.coalesce(F.median("own_floor"), F.lit(FLOOR_LOW))).alias("of_all"))
    x = shapes.join(clusters, "cluster").crossJoin(F.broadcast(every))  # one row
    other = F.when(F.col("of_cluster").isNotNull(), "cluster_median").otherwise("global_median")
    source = F.when(F.col("own_floor").isNotNull(), "deep_catalog").when(F.col("weeks") <= DEEP_WEEK, other).otherwise(F.concat(other, F.lit("_insufficient_tail")))
    return x.withColumns({"floor_rate": F.coalesce("own_floor", "of_cluster", "of_all"), "floor_source": source})


SHAPES_SQL = f"""s0 AS (SELECT title_id, week, streams, sales, songs, total, CAST(total AS DOUBLE) AS y, max(CAST(total AS DOUBLE)) OVER (PARTITION BY title_id) AS peak, row_number() OVER (PARTITION BY title_id ORDER BY week DESC) AS back FROM cert),
    s1 AS (SELECT *, y / peak AS norm, min(week) FILTER (WHERE y = peak) OVER (PARTITION BY title_id) AS peak_week, (y / peak + lag(y / peak) OVER (PARTITION BY title_id ORDER BY week)) / 2 * (week - lag(week) OVER (PARTITION BY title_id ORDER BY week)) AS area FROM s0 WHERE peak > 0),
    s2 AS (SELECT title_id, max(peak) AS peak, max(peak_week) AS peak_week, max(week) AS weeks, count(*) AS n, max(norm) FILTER (WHERE week = 1) AS first, max(norm) FILTER (WHERE back = 1) AS last,
        CASE WHEN count(*) FILTER (WHERE week >= peak_week) >= 2 THEN coalesce(min(week) FILTER (WHERE week >= peak_week AND norm <= 0.5), max(week)) END AS half_week,
        CASE WHEN count(*) FILTER (WHERE week >= peak_week AND norm > 0) >= 3 THEN regr_slope(ln(norm), CAST(week AS DOUBLE)) FILTER (WHERE week >= peak_week AND norm > 0) END AS decay, coalesce(sum(area), 0) / max(week) AS area,
        {", ".join(f"least(greatest(max(CAST({n} AS DOUBLE) / y) FILTER (WHERE week = 1 AND total > 0), 0.0), 1.0) AS {n}_ratio" for n in CHANNELS)}, median(y) FILTER (WHERE back <= {TAIL_MOST}) AS middle, count(*) FILTER (WHERE back <= {TAIL_MOST}) AS late FROM s1 GROUP BY 1),
    s3 AS (SELECT *, CASE WHEN weeks > {DEEP_WEEK} AND late >= {TAIL_LEAST} AND middle > 0 THEN least(greatest(middle / peak, {FLOOR_LOW}), {FLOOR_HIGH}) END AS own, {CLASS_SQL} AS cluster FROM s2),
    c AS (SELECT cluster, least(greatest(median(own), {FLOOR_LOW}), {FLOOR_HIGH}) AS of_cluster FROM s3 WHERE own IS NOT NULL GROUP BY 1), g AS (SELECT least(greatest(coalesce(median(own), {FLOOR_LOW}), {FLOOR_LOW}), {FLOOR_HIGH}) AS of_all FROM s3),
    cert_titles AS (SELECT s3.*, coalesce(own, of_cluster, of_all) AS floor_rate, CASE WHEN own IS NOT NULL THEN 'deep_catalog' ELSE CASE WHEN of_cluster IS NOT NULL THEN 'cluster_median' ELSE 'global_median' END || CASE WHEN weeks > {DEEP_WEEK} THEN '_insufficient_tail' ELSE '' END END AS floor_source
        FROM s3 LEFT JOIN c ON c.cluster = s3.cluster, g)"""


@query(f"""WITH {PANEL_SQL}, {SHAPES_SQL} SELECT title_id, round(peak, 4) AS peak, CAST(peak_week AS BIGINT) AS peak_week, CAST(weeks AS BIGINT) AS weeks, CAST(n AS BIGINT) AS n, round(first, 6) AS first, round(last, 6) AS last, CAST(half_week AS BIGINT) AS half_week, round(decay, 6) AS decay, round(area, 6) AS area,
    round(streams_ratio, 6) AS streams_ratio, round(sales_ratio, 6) AS sales_ratio, round(songs_ratio, 6) AS songs_ratio, CAST(cluster AS BIGINT) AS cluster, round(floor_rate, 6) AS floor_rate, floor_source FROM cert_titles""")
def certification_titles(t: Tables) -> DataFrame:
    """Shape, channels of the first week, archetype and floor of every title of the panel."""
    x = with_floor(stored_shapes(t))
    return x.select("title_id", F.round("peak", 4).alias("peak"), "peak_week", "weeks", F.col("rows").alias("n"), *[F.round(c, 6).alias(c) for c in ("first", "last")], "half_week",
                    *[F.round(c, 6).alias(c) for c in ("decay", "area", "streams_ratio", "sales_ratio", "songs_ratio")], "cluster", F.round("floor_rate", 6).alias("floor_rate"), "floor_source")


@query(f"""WITH {PANEL_SQL}, {SHAPES_SQL} SELECT title_id, week_end, week, CAST(cert.streams AS DOUBLE) AS streams, CAST(cert.sales AS DOUBLE) AS sales, CAST(cert.songs AS DOUBLE) AS songs, CAST(total AS DOUBLE) AS total, CAST(cumulative AS DOUBLE) AS cumulative,
    round(CAST(cumulative AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY title_id) AS DOUBLE), 6) AS part, round(CAST(total AS DOUBLE) / peak, 6) AS norm, CAST(cluster AS BIGINT) AS cluster, round(floor_rate * peak, 6) AS floor, floor_source FROM cert JOIN cert_titles USING (title_id)""")
def certification_panel(t: Tables) -> DataFrame:
    """Every week with its title's features: what the certification model learns from. ``part``: the running total over all weeks, the cumulative shape."""
    panel = t.stored("certification-panel", lambda: panel_weeks(t))
    titles = with_floor(stored_shapes(t)).select("title_id", "peak", "cluster", "floor_rate", "floor_source")
    x = panel.join(titles, "title_id").withColumn("all", F.sum("total").over(Window.partitionBy("title_id")))
    volumes = [F.col(c).cast(DOUBLE).alias(c) for c in ("streams", "sales", "songs", "total", "cumulative")]
    return x.select("title_id", "week_end", "week", *volumes, F.round(F.col("cumulative").cast(DOUBLE) / F.col("all").cast(DOUBLE), 6).alias("part"), F.round(F.col("total").cast(DOUBLE) / F.col("peak"), 6).alias("norm"),
                    "cluster", F.round(F.col("floor_rate") * F.col("peak"), 6).alias("floor"), "floor_source")
