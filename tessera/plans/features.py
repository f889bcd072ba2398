"""Feature tables for models: priors by peak, scenario multipliers, release shapes, catalog features, samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import relational as R
from ..sources.tables import Tables
from .registry import query

DOUBLE = "double"
#: Upper edges of the bins of peak weeks.
PEAK_BINS = (40_000, 60_000, 80_000, 100_000, 120_000, 150_000)


def peak_bin(x):
    out = F.when(x < PEAK_BINS[0], 0)
    for k, edge in enumerate(PEAK_BINS[1:], 1):
        out = out.when(x < edge, k)
    return out.otherwise(len(PEAK_BINS)).cast("long")


BIN_SQL = "CAST(CASE " + " ".join(f"WHEN peak < {e} THEN {k}" for k, e in enumerate(PEAK_BINS)) + f" ELSE {len(PEAK_BINS)} END AS BIGINT)"
LIFE_SQL = "life AS (SELECT title_id, release_type, week_end, CAST(ae AS DOUBLE) AS ae, row_number() OVER (PARTITION BY title_id ORDER BY week_end) AS k FROM title_weeks JOIN titles USING (title_id))"


def life(t: Tables) -> DataFrame:
    """Weeks of a title, numbered by row."""
    rows = t.title_weeks.join(t.titles.select("title_id", "release_type"), "title_id")
    return rows.select("title_id", "release_type", "week_end", F.col("ae").cast(DOUBLE).alias("ae"), F.row_number().over(Window.partitionBy("title_id").orderBy("week_end")).alias("k"))


def series(rows: DataFrame, least: int, *columns: str) -> DataFrame:
    """One row a title of ``least`` weeks or more: its ``columns`` as arrays in the order of weeks (``k``), at most a few hundred numbers each.

    As many tasks as the cluster has use for: what is fitted takes long for its size, by which AQE would join tasks.
    """
    n = 4 * rows.sparkSession.sparkContext.defaultParallelism
    weeks = rows.repartition(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "title_id").groupBy("title_id")
    one = weeks.agg(F.array_sort(F.collect_list(F.struct("k", *columns))).alias("weeks")).filter(F.size("weeks") >= least)
    return one.select("title_id", *[F.col(f"weeks.{c}").alias(c) for c in columns])


@query(f"""WITH {LIFE_SQL}, r AS (SELECT title_id, release_type, max(ae) AS peak, avg(ae) FILTER (WHERE k > 8) / max(ae) AS ret FROM life GROUP BY ALL), q AS (SELECT *, {BIN_SQL} AS bin FROM r WHERE ret IS NOT NULL AND ret <= 0.8)
    SELECT bin, release_type, CAST(count(*) AS BIGINT) AS n, round(median(ret), 6) AS med, round(quantile_cont(ret, 0.1), 6) AS p10, round(quantile_cont(ret, 0.9), 6) AS p90 FROM q GROUP BY ALL HAVING count(*) >= 5""")
def floor_priors(t: Tables) -> DataFrame:
    """What part of its peak a title keeps later on, by peak and kind; small groups are left out."""
    r = life(t).groupBy("title_id", "release_type").agg(F.max("ae").alias("peak"), (F.avg(F.when(F.col("k") > 8, F.col("ae"))) / F.max("ae")).alias("ret"))
    q = r.filter("ret <= 0.8").withColumn("bin", peak_bin(F.col("peak")))
    return q.groupBy("bin", "release_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("ret"), 6).alias("med"), F.round(F.expr("percentile(ret, 0.1)"), 6).alias("p10"), F.round(F.expr("percentile(ret, 0.9)"), 6).alias("p90")).filter("n >= 5")


@query(f"""WITH {LIFE_SQL}, r AS (SELECT title_id, release_type, sum(ae) FILTER (WHERE k <= 12) / nullif(sum(ae) FILTER (WHERE k <= 4), 0) AS m FROM life GROUP BY ALL HAVING max(k) >= 12)
    SELECT release_type, round(quantile_cont(m, 0.2), 6) AS bear, round(quantile_cont(m, 0.5), 6) AS base, round(quantile_cont(m, 0.8), 6) AS bull FROM r GROUP BY 1""")
def scenario_multipliers(t: Tables) -> DataFrame:
    """Low, middle and high growth from the first four weeks to twelve, by kind."""
    upto = lambda n: F.sum(F.when(F.col("k") <= n, F.col("ae")))
    r = life(t).groupBy("title_id", "release_type").agg((upto(12) / F.nullif(upto(4), F.lit(0.0))).alias("m"), F.max("k").alias("weeks")).filter("weeks >= 12")
    return r.groupBy("release_type").agg(*[F.round(F.expr(f"percentile(m, {p})"), 6).alias(n) for p, n in ((0.2, "bear"), (0.5, "base"), (0.8, "bull"))])


@query(f"""WITH {LIFE_SQL}, x AS (SELECT *, max(ae) OVER (PARTITION BY title_id) AS peak, (ae + lag(ae) OVER (PARTITION BY title_id ORDER BY k)) / 2 AS trap FROM life),
    p AS (SELECT title_id, min(k) AS peak_k FROM x WHERE ae = peak GROUP BY 1)
    SELECT title_id, round(any_value(peak), 4) AS peak, CAST(any_value(peak_k) AS BIGINT) AS peak_week, CAST(min(k) FILTER (WHERE k > peak_k AND ae <= peak / 2) AS BIGINT) AS half_week, round(coalesce(sum(trap), 0), 5) AS auc,
    round(regr_slope(ln(1 + ae), CAST(k AS DOUBLE)), 6) AS log_slope, round(CAST(sum(CAST(ae AS DECIMAL(18,4))) FILTER (WHERE k > 26) AS DOUBLE) / nullif(count(*) FILTER (WHERE k > 26), 0), 8) AS tail FROM x JOIN p USING (title_id) GROUP BY 1 HAVING count(*) > 3""")
def release_shapes(t: Tables) -> DataFrame:
    """Peak, week of the peak, first week at half of it, area, slope of the logarithm and tail of every title."""
    w = Window.partitionBy("title_id")
    x = life(t).withColumn("peak", F.max("ae").over(w)).withColumn("trap", (F.col("ae") + F.lag("ae").over(w.orderBy("k"))) / 2)
    x = x.withColumn("peak_k", F.min(F.when(F.col("ae") == F.col("peak"), F.col("k"))).over(w))
    late = F.col("k") > 26
    return x.groupBy("title_id").agg(
        F.round(F.max("peak"), 4).alias("peak"), F.max("peak_k").cast("long").alias("peak_week"), F.min(F.when((F.col("k") > F.col("peak_k")) & (F.col("ae") <= F.col("peak") / 2), F.col("k"))).cast("long").alias("half_week"),
        F.round(F.coalesce(F.sum("trap"), F.lit(0.0)), 5).alias("auc"), F.round(F.regr_slope(F.log1p("ae"), F.col("k").cast(DOUBLE)), 6).alias("log_slope"), F.round(F.sum(F.when(late, F.col("ae").cast("decimal(18,4)"))).cast(DOUBLE) / F.nullif(F.count(F.when(late, 1)), F.lit(0)), 8).alias("tail"), F.count(F.lit(1)).alias("n"),
    ).filter("n > 3").drop("n")


@query(f"""WITH {LIFE_SQL}, f AS (SELECT *, lag(ae) OVER w AS l1, CASE WHEN count(*) OVER w4 = 4 THEN avg(ae) OVER w4 END AS m4, CASE WHEN count(*) OVER w12 = 12 THEN avg(ae) OVER w12 END AS m12 FROM life
    WINDOW w AS (PARTITION BY title_id ORDER BY k), w4 AS (PARTITION BY title_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), w12 AS (PARTITION BY title_id ORDER BY k ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
    SELECT title_id, week_end, round(sin(2 * pi() * week(week_end) / 52), 8) + 0.0 AS season_sin, round(cos(2 * pi() * week(week_end) / 52), 8) + 0.0 AS season_cos, CAST(quarter(week_end) = 4 AS BIGINT) AS q4, CAST(release_type = 'PROMO' AS BIGINT) AS is_promo,
    round(CASE WHEN m4 > 0 THEN l1 / m4 ELSE 1.0 END, 6) AS short, round(CASE WHEN m12 > 0 THEN l1 / m12 ELSE 1.0 END, 6) AS long, CAST(CASE WHEN m4 > 0 THEN l1 / m4 ELSE 1.0 END > 1.5 AND CASE WHEN m12 > 0 THEN l1 / m12 ELSE 1.0 END > 2.0 AS BIGINT) AS anomaly, round(coalesce(m4, l1, ae), 6) AS level FROM f""")
def catalog_features(t: Tables) -> DataFrame:
    """Season, kind, momentum against the last 4 and 12 weeks, anomaly, and the level with its fallbacks."""
    w = Window.partitionBy("title_id").orderBy("k")
    ratio = lambda m: F.when(F.col(m) > 0, F.col("l1") / F.col(m)).otherwise(F.lit(1.0))
    x = life(t).withColumn("l1", F.lag("ae").over(w)).withColumn("m4", W.rolling_mean(F.col("ae"), w, 4)).withColumn("m12", W.rolling_mean(F.col("ae"), w, 12))
    turn = 2 * math.pi * F.weekofyear("week_end") / 52
    return x.select(
        "title_id", "week_end", F.round(F.sin(turn), 8).alias("season_sin"), F.round(F.cos(turn), 8).alias("season_cos"), (F.quarter("week_end") == 4).cast("long").alias("q4"), (F.col("release_type") == "PROMO").cast("long").alias("is_promo"),
        F.round(ratio("m4"), 6).alias("short"), F.round(ratio("m12"), 6).alias("long"), ((ratio("m4") > 1.5) & (ratio("m12") > 2.0)).cast("long").alias("anomaly"), F.round(F.coalesce("m4", "l1", "ae"), 6).alias("level"),
    )


@query(f"""WITH {LIFE_SQL} SELECT title_id, max(CASE WHEN k = 1 THEN ae END) AS w1, max(CASE WHEN k = 2 THEN ae END) AS w2, max(CASE WHEN k = 3 THEN ae END) AS w3, round(CASE WHEN max(CASE WHEN k = 1 THEN ae END) >= 0.1 * max(CASE WHEN k = 2 THEN ae END)
    THEN max(CASE WHEN k = 2 THEN ae END) / max(CASE WHEN k = 1 THEN ae END) ELSE max(CASE WHEN k = 3 THEN ae END) / nullif(max(CASE WHEN k = 2 THEN ae END), 0) END, 6) AS retention FROM life WHERE k <= 3 GROUP BY 1""")
def week_two_retention(t: Tables) -> DataFrame:
    """Second over first week; where the first is a stub, third over second."""
    x = life(t).filter("k <= 3").groupBy("title_id").pivot("k", [1, 2, 3]).agg(F.max("ae")).toDF("title_id", "w1", "w2", "w3")
    stub = F.col("w1") < 0.1 * F.col("w2")
    whole = F.col("w2") / F.col("w1")
    return x.withColumn("retention", F.round(F.when(F.coalesce(stub, F.lit(True)), F.col("w3") / F.nullif(F.col("w2"), F.lit(0.0))).otherwise(whole), 6))


@query("SELECT title_id, CAST(max(c) AS DOUBLE) AS total, CAST(max(n) AS BIGINT) AS weeks FROM (SELECT title_id, sum(ae) OVER w AS c, count(*) OVER w AS n FROM title_weeks WINDOW w AS (PARTITION BY title_id ORDER BY week_end)) GROUP BY 1 HAVING max(c) >= 500000 AND max(n) >= 12")
def training_eligible(t: Tables) -> DataFrame:
    """Titles with enough volume and weeks to learn from."""
    w = Window.partitionBy("title_id").orderBy("week_end")
    x = t.title_weeks.select("title_id", W.running_sum(F.col("ae"), w).alias("c"), F.row_number().over(w).alias("n"))
    return x.groupBy("title_id").agg(F.max("c").cast(DOUBLE).alias("total"), F.max("n").cast("long").alias("weeks")).filter("total >= 500000 and weeks >= 12")


@query()
def weighted_sample(t: Tables) -> DataFrame:
    """500 title weeks without replacement, chances by log1p of the volume."""
    rows = t.title_weeks.withColumn("key", F.xxhash64("title_id", "week_end"))
    return R.weighted_sample(rows, F.log1p(F.col("ae").cast(DOUBLE)), 500, "key").select("title_id", "week_end", F.col("ae").cast(DOUBLE).alias("ae"))


@query(f"""WITH {LIFE_SQL}, s AS (SELECT title_id, release_type, k, avg(ae) OVER (PARTITION BY title_id ORDER BY k ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) / nullif(max(ae) OVER (PARTITION BY title_id), 0) AS own, count(*) OVER (PARTITION BY title_id) AS n FROM life),
    l AS (SELECT title_id, release_type, own, n FROM s QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY k DESC) = 1), g AS (SELECT release_type, median(own) AS kind FROM l WHERE n >= 24 GROUP BY 1), a AS (SELECT median(own) AS every FROM l WHERE n >= 24)
    SELECT title_id, round(least(greatest(coalesce(CASE WHEN n >= 24 THEN own END, kind, every), 0.002), 0.15), 6) AS floor_rate FROM l LEFT JOIN g USING (release_type), a""")
def floor_ladder(t: Tables) -> DataFrame:
    """A title's own late level if it is long enough, else that of its kind, else of all; kept within limits."""
    w = Window.partitionBy("title_id")
    x = life(t).withColumn("own", F.avg("ae").over(w.orderBy("k").rowsBetween(-11, 0)) / F.nullif(F.max("ae").over(w), F.lit(0.0))).withColumn("n", F.count(F.lit(1)).over(w))
    last = W.top_n_per_group(x, ["title_id"], [F.col("k").desc()]).select("title_id", "release_type", "own", "n")
    long = last.filter("n >= 24")
    kinds, every = long.groupBy("release_type").agg(F.median("own").alias("kind")), long.agg(F.median("own").alias("every"))
    x = last.join(kinds, "release_type", "left").crossJoin(F.broadcast(every))  # one row
    rate = F.coalesce(F.when(F.col("n") >= 24, F.col("own")), "kind", "every")
    return x.select("title_id", F.round(F.least(F.greatest(rate, F.lit(0.002)), F.lit(0.15)), 6).alias("floor_rate"))
