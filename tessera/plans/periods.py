"""Fiscal periods: labels, windows from labels, group shares with growth, normalised period reports and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import windows as W
from ..sources.tables import ANCHOR, Tables
from .registry import query

DOUBLE = "double"
FY_SQL = "CAST(year(day) + CASE WHEN month(day) >= 9 THEN 1 ELSE 0 END AS BIGINT)"
FQ_SQL = "CAST(ceil(((month(day) + 3) % 12 + 1) / 3.0) AS BIGINT)"
NAMES_SQL = "CASE fq WHEN 1 THEN 'Q1 (Sep-Nov)' WHEN 2 THEN 'Q2 (Dec-Feb)' WHEN 3 THEN 'Q3 (Mar-May)' ELSE 'Q4 (Jun-Aug)' END"
QUARTERS_SQL = f"""q0 AS (SELECT {FY_SQL} AS fy, {FQ_SQL} AS fq, label, ae, day, CASE WHEN month(day) IN (9, 10, 11) THEN make_date(year(day), 11, 30) WHEN month(day) IN (12, 1, 2) THEN last_day(make_date(year(day), 2, 1)) WHEN month(day) IN (3, 4, 5) THEN make_date(year(day), 5, 31) ELSE make_date(year(day), 8, 31) END AS complete FROM order_rows),
    q1 AS (SELECT fy, fq, sum(CASE WHEN label = 'BUILDING' THEN ae ELSE 0 END) AS own, sum(ae) AS total, max(day) AS p_day, max(complete) AS complete FROM q0 GROUP BY ALL),
    quarters AS (SELECT fy, fq, CAST(own AS DOUBLE) AS own, CAST(total AS DOUBLE) AS total, p_day, CASE WHEN p_day < complete THEN {NAMES_SQL} || ' - (END ' || strftime(p_day, '%b %d') || ')' ELSE {NAMES_SQL} END AS fiscal_quarter FROM q1)"""


def quarters(t: Tables) -> DataFrame:
    """One row a fiscal quarter: volume of the anchor's label and of all, the last day that there is, and the label."""
    q = t.orders.groupBy(C.fiscal_year("day").alias("fy"), C.fiscal_quarter("day").alias("fq")).agg(
        F.sum(F.when(F.col("label") == ANCHOR, F.col("ae")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast(DOUBLE).alias("own"),
        F.sum("ae").cast(DOUBLE).alias("total"), F.max("day").alias("p_day"), F.max(C.fiscal_quarter_last_day("day")).alias("complete"),
    )
    return q.select("fy", "fq", "own", "total", "p_day", C.fiscal_quarter_label("fq", "p_day", "complete").alias("fiscal_quarter"))


def with_growth(x: DataFrame, period: str) -> DataFrame:
    """Share in percent and growth of share, market and both against the same period a year before."""
    w = Window.partitionBy(period).orderBy("fy")
    x = x.withColumn("share", C.div0("own", "total") * 100)
    prev_share, prev_total = F.lag("share").over(w), F.lag("total").over(w)
    x = x.withColumn("share_growth", C.div0(F.col("share") - prev_share, prev_share) * 100).withColumn("market_growth", C.div0(F.col("total") - prev_total, prev_total) * 100)
    rounded = [F.round(c, 6).alias(c) for c in ("share", "share_growth", "market_growth")]
    return x.select("fy", period, "own", "total", *rounded, F.round(F.col("share_growth") + F.col("market_growth"), 6).alias("total_growth"), "p_day")


def growth_sql(period: str) -> str:
    div0 = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / {b} END"
    return f"""y AS (SELECT *, lag(share) OVER w AS ps, lag(total) OVER w AS pt FROM (SELECT *, {div0('own', 'total')} * 100 AS share FROM x) WINDOW w AS (PARTITION BY {period} ORDER BY fy)),
    z AS (SELECT *, {div0('share - ps', 'ps')} * 100 AS sg, {div0('total - pt', 'pt')} * 100 AS mg FROM (SELECT * FROM y))
    SELECT fy, {period}, own, total, round(share, 6) AS share, round(CASE WHEN ps IS NOT NULL THEN sg END, 6) AS share_growth, round(CASE WHEN pt IS NOT NULL THEN mg END, 6) AS market_growth, round(CASE WHEN ps IS NOT NULL THEN sg + mg END, 6) AS total_growth, p_day FROM z"""


@query(f"WITH {QUARTERS_SQL} SELECT fy, fiscal_quarter, p_day FROM quarters")
def date_fiscal_quarter_label(t: Tables) -> DataFrame:
    return quarters(t).select("fy", "fiscal_quarter", "p_day")


@query(f"WITH {QUARTERS_SQL}, x AS (SELECT * FROM quarters), {growth_sql('fq')}")
def q_25_group_quarter_growth(t: Tables) -> DataFrame:
    return with_growth(quarters(t), "fq")


@query(f"WITH x AS (SELECT {FY_SQL} AS fy, CAST((month(day) + 3) % 12 + 1 AS BIGINT) AS fm, CAST(sum(CASE WHEN label = 'BUILDING' THEN ae ELSE 0 END) AS DOUBLE) AS own, CAST(sum(ae) AS DOUBLE) AS total, max(day) AS p_day FROM order_rows GROUP BY ALL), {growth_sql('fm')}")
def q_23_group_month_growth(t: Tables) -> DataFrame:
    """Fiscal months: volume and share of the anchor's label, with growth of share, market and both."""
    x = t.orders.groupBy(C.fiscal_year("day").alias("fy"), C.fiscal_month("day").alias("fm")).agg(
        F.sum(F.when(F.col("label") == ANCHOR, F.col("ae")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast(DOUBLE).alias("own"), F.sum("ae").cast(DOUBLE).alias("total"), F.max("day").alias("p_day")
    )
    return with_growth(x, "fm")


#: Labels as they come, and how many fiscal years after the first of the data: whole quarters, marked ones, other spellings, and some that name nothing.
LABELS_GIVEN = (
    "Q2 (Dec-Feb)", "q2", "Q1 (Sep-Nov)", "Q3 (Mar-May)", "Q4 (Jun-Aug)", "Q1 (Sep-Nov) - (END Oct 07)", "Q2 (Dec-Feb) - (END Dec 31)", "Q2 (Dec-Feb) - (END Feb 29)", "Q5", "", "Q3 - (END Foo 3)",
)
_LABELS_SQL = ", ".join(f"('{x}')" for x in LABELS_GIVEN)


@query(f"""WITH {QUARTERS_SQL}, g AS (SELECT fy, label, TRY_CAST(regexp_extract(label, '(?i)Q\\s*([1-4])', 1) AS INTEGER) AS q, regexp_extract(label, '(?i)END\\s+([A-Za-z]{{3}})', 1) AS mon, regexp_extract(label, '(?i)END\\s+[A-Za-z]{{3}}\\s+([0-9]{{1,2}})', 1) AS dd FROM (SELECT DISTINCT fy FROM quarters), (VALUES {_LABELS_SQL}) v(label)),
    m AS (SELECT *, list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(mon)) AS mm FROM g)
    SELECT fy, label, CASE q WHEN 1 THEN make_date(fy - 1, 9, 1) WHEN 2 THEN make_date(fy - 1, 12, 1) WHEN 3 THEN make_date(fy, 3, 1) WHEN 4 THEN make_date(fy, 6, 1) END AS first_day,
    CASE WHEN mon <> '' THEN TRY_CAST(CAST(CASE WHEN mm >= 9 THEN fy - 1 ELSE fy END AS VARCHAR) || '-' || lpad(CAST(mm AS VARCHAR), 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) ELSE CASE q WHEN 1 THEN make_date(fy - 1, 11, 30) WHEN 2 THEN make_date(fy, 2, 28) WHEN 3 THEN make_date(fy, 5, 31) WHEN 4 THEN make_date(fy, 8, 31) END END AS final_day FROM m""")
def date_fiscal_windows(t: Tables) -> DataFrame:
    """First and last day that labels name, in every fiscal year of the data."""
    first, final = C.fiscal_window("fy", "label")
    years = quarters(t).select("fy").distinct().withColumn("label", F.explode(F.array(*map(F.lit, LABELS_GIVEN))))
    return years.select("fy", "label", first.alias("first_day"), final.alias("final_day"))


@query(f"""WITH {QUARTERS_SQL}, d AS (SELECT fy, fiscal_quarter, CASE WHEN fiscal_quarter LIKE '%END%' THEN p_day WHEN fq = 2 THEN make_date(fy, 2, 28) WHEN fq = 1 THEN make_date(fy - 1, 11, 30) WHEN fq = 3 THEN make_date(fy, 5, 31) ELSE make_date(fy, 8, 31) END AS final_day FROM quarters UNION ALL SELECT 2000, 'no period', NULL)
    SELECT *, CAST(row_number() OVER (ORDER BY final_day NULLS FIRST, fy, fiscal_quarter) AS BIGINT) AS pos FROM d""")
def sort_period_nulls_first(t: Tables) -> DataFrame:
    """Periods by the day that their label ends on; those that name none come first."""
    given = quarters(t).select("fy", "fiscal_quarter").unionByName(t.spark.createDataFrame([(2000, "no period")], "fy bigint, fiscal_quarter string"))
    x = given.withColumn("final_day", C.fiscal_window("fy", "fiscal_quarter")[1])
    w = Window.orderBy(F.col("final_day").asc_nulls_first(), "fy", "fiscal_quarter")  # a row for each fiscal quarter
    return x.withColumn("pos", F.row_number().over(w).cast("long"))


def normalised_periods(raw: DataFrame, order: str, names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A period report as it comes in text: columns by name or older name whatever the case, numbers or null, periods trimmed.

    Rows without year, period or volumes go; of rows for one period, the last by ``order`` stays.
    """
    names = names or {"fiscal_year": (), "fiscal_month": ("fiscal_quarter",), "own": (), "total": (), "growth": ()}
    found = {c.strip().lower(): c for c in raw.columns}
    columns = [F.col(f"`{next(found[n] for n in (name, *older) if n in found)}`").alias(name) for name, older in names.items()]
    x = raw.select(*columns, F.col(order).alias("__order"))
    x = x.withColumn("fiscal_year", F.col("fiscal_year").try_cast("bigint")).withColumn("fiscal_month", F.trim("fiscal_month"))
    for c in ("own", "total", "growth"):
        x = x.withColumn(c, C.number_or_null(c))
    x = x.filter("fiscal_year is not null and fiscal_month is not null and own is not null and total is not null")
    return W.top_n_per_group(x, ["fiscal_year", "fiscal_month"], [F.col("__order").desc()]).drop("__order")


@query(f"""WITH {QUARTERS_SQL} SELECT fy AS fiscal_year, fiscal_quarter AS fiscal_month, own * 2 AS own, total, CASE WHEN fq = 1 THEN NULL ELSE CAST(fq AS DOUBLE) END AS growth FROM quarters WHERE fq <> 4""")
def share_period_normalised(t: Tables) -> DataFrame:
    """A report that was written twice, with blanks around periods, infinite growth, and a quarter without volume."""
    q = quarters(t).select("fy", "fiscal_quarter", "own", "total", "fq")
    text = lambda factor, seq: q.select(
        F.col("fy").cast("string").alias(" Fiscal_Year"), F.concat(F.lit(" "), "fiscal_quarter").alias("FISCAL_QUARTER"), F.when(F.col("fq") != 4, F.col("own") * factor).cast("string").alias("own"),
        F.col("total").cast("string").alias("Total "), F.when(F.col("fq") == 1, "inf").otherwise(F.col("fq").cast("string")).alias("growth"), F.lit(seq).alias("seq"),
    )
    return normalised_periods(text(1, 1).unionByName(text(2, 2)), "seq")


def period_releases(t: Tables, level_3: str, baseline: tuple[int, str], comparison: tuple[int, str]) -> DataFrame:
    """Titles of a distributor first sold in either of two fiscal quarters, which labels name."""
    windows = t.spark.createDataFrame([("baseline", *baseline), ("comparison", *comparison)], "window string, fy bigint, label string")
    first, final = C.fiscal_window("fy", "label")
    windows = windows.select("window", first.alias("first_day"), final.alias("final_day"))
    titles = t.titles.join(t.owners.filter(F.lower(F.trim("level_3")) == level_3.strip().lower()), "title_id")
    inside = F.col("first_sale_date").between(F.col("first_day"), F.col("final_day"))
    return titles.join(F.broadcast(windows), inside).select("window", "title_id", "title", "level_3", "first_sale_date")  # two rows


@query("""SELECT CASE WHEN first_sale_date <= DATE '1995-05-31' THEN 'baseline' ELSE 'comparison' END AS window, title_id, title, level_3, first_sale_date FROM titles JOIN owners USING (title_id)
    WHERE level_3 = 'Supplier#000000003' AND (first_sale_date BETWEEN DATE '1995-03-01' AND DATE '1995-05-31' OR first_sale_date BETWEEN DATE '1995-09-01' AND DATE '1995-10-15')""")
def share_period_releases(t: Tables) -> DataFrame:
    return period_releases(t, " supplier#000000003 ", (1995, "Q3 (Mar-May)"), (1996, "Q1 (Sep-Nov) - (END Oct 15)"))


@query("""WITH r AS (SELECT product_id AS artist_id, title_id, sum(ae) AS revenue FROM daily_fact WHERE report_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' GROUP BY ALL)
    SELECT artist_id, title_id, CAST(revenue AS DOUBLE) AS revenue FROM r QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY revenue DESC, artist_id) = 1""")
def q_08_title_revenue(t: Tables) -> DataFrame:
    """Revenue of each title in a year, under the artist with most of it: the report of one title, for all titles at once."""
    year = t.daily_fact.filter(F.col("report_date").between("1999-01-01", "1999-12-31"))
    r = year.groupBy(F.col("product_id").alias("artist_id"), "title_id").agg(F.sum("ae").alias("revenue"))
    return W.top_n_per_group(r, ["title_id"], [F.col("revenue").desc(), F.col("artist_id")]).select("artist_id", "title_id", F.col("revenue").cast(DOUBLE).alias("revenue"))
