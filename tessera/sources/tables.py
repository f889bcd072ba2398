"""The domain's relations, bound to the tables of a directory, and the same relations as SQL.

A title is a part, a product a supplier's share in it, sales are line items, labels are market segments of orders. Money is
decimal, so that sums do not depend on their order. Every time window takes its date from the data, never from the clock.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import week_end
from ..functions.windows import top_n_per_group
from .stored import list_names, shared_table, signature

ANCHOR = "BUILDING"
#: Codes of the source by category; all other rows, those without a code too, are of the last.
CATEGORY_CODES, OTHER_CATEGORY = {"Streams": "A", "ProductSales": "N"}, "RecordingSales"
#: The tables that relations are made of.
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Fixed value: bytes of the sources for each task that holds titles.
TITLE_TASK_BYTES = 4 << 20
LABELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def money(x):
    return F.round(x, 4).cast("decimal(18,4)")


class Tables:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that several parts of a report read, or several reports: made once and kept as Parquet in the shared folder, until a file of the sources changes.

        ``name`` stands for what ``make`` makes, with all that it depends on besides the sources.
        """
        if name not in self._stored:
            self._stored[name] = shared_table(self.spark, (self.directory, self.signature, name), make, name)
        return self._stored[name]

    @cached_property
    def signature(self) -> tuple[int, int, int]:
        there = set(list_names(self.spark, self.directory))
        return signature(self.spark, [f"{self.directory}/{x}.parquet" for x in SOURCES if f"{x}.parquet" in there])

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def facts(self, categories: str | tuple[str, ...] | None = None, service: str | None = None) -> DataFrame:
        """Sales of a title's product on a day; of some categories or one service, by the codes of the source, so that the scan filters."""
        rows = self.raw("lineitem")
        if categories is not None:
            wanted = (categories,) if isinstance(categories, str) else categories
            code = F.col("l_returnflag")
            hit = code.isin(*(CATEGORY_CODES[c] for c in wanted if c in CATEGORY_CODES))
            rows = rows.filter(hit | code.isNull() | ~code.isin(*CATEGORY_CODES.values()) if OTHER_CATEGORY in wanted else hit)
        if service is not None:
            rows = rows.filter(F.col("l_linestatus") == "F" if service == "OnDemand" else F.col("l_linestatus") != "F")
        category = F.when(F.col("l_returnflag") == "A", "Streams").when(F.col("l_returnflag") == "N", "ProductSales").otherwise(OTHER_CATEGORY)
        day = F.col("l_shipdate").cast("date")
        return rows.select(
            day.alias("report_date"),
            week_end(day).alias("week_end"),
            F.col("l_partkey").alias("title_id"),
            F.col("l_suppkey").alias("product_id"),
            category.alias("category"),
            F.when(F.col("l_linestatus") == "F", "OnDemand").otherwise("Programmed").alias("service"),
            F.col("l_quantity").cast("long").alias("quantity"),
            money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("ae"),
        )

    @cached_property
    def daily_fact(self) -> DataFrame:
        return self.facts()

    @cached_property
    def title_facts(self) -> DataFrame:
        """Sales dealt by title, once: weeks, products and windows of a title need no other shuffle, and its joins by title none of this side.

        The number of tasks grows with the sources, so that what a task holds does not.
        """
        return self.daily_fact.repartition(max(self.spark.sparkContext.defaultParallelism, -(-self.signature[1] // TITLE_TASK_BYTES)), "title_id")

    @cached_property
    def titles(self) -> DataFrame:
        return self._titles(self.daily_fact)

    @cached_property
    def dealt_titles(self) -> DataFrame:
        """The same rows, dealt as ``title_facts`` are: for joins with what comes from them."""
        return self._titles(self.title_facts)

    def _titles(self, facts: DataFrame) -> DataFrame:
        first = facts.groupBy("title_id").agg(F.min("report_date").alias("first_sale_date"))
        part = self.raw("part").select(F.col("p_partkey").alias("title_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("release_type"), F.col("p_size").cast("long").alias("size"))
        return part.join(first, "title_id", "left")

    @cached_property
    def suppliers(self) -> DataFrame:
        """Distributors of a product on three levels."""
        nation, region = self.raw("nation"), self.raw("region")
        return (
            self.raw("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("product_id"), F.col("s_name").alias("level_3"), F.col("n_name").alias("level_2"), F.col("r_name").alias("level_1"))
        )

    @cached_property
    def ownership(self) -> DataFrame:
        """Units of each product of a title, with its distributors."""
        return self.daily_fact.groupBy("title_id", "product_id").agg(F.sum("quantity").alias("units")).join(self.suppliers, "product_id")

    @cached_property
    def owners(self) -> DataFrame:
        """The distributor with most units of each title."""
        region = self.raw("region").select(F.col("r_regionkey").alias("n_regionkey"))
        nation = self.raw("nation").join(region, "n_regionkey", "left_semi").select(F.col("n_nationkey").alias("s_nationkey"))
        known = self.raw("supplier").join(nation, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("product_id"))
        units = self.title_facts.groupBy("title_id", "product_id").agg(F.sum("quantity").alias("units")).join(known, "product_id", "left_semi")
        most = top_n_per_group(units, ["title_id"], [F.col("units").desc_nulls_last(), F.col("product_id")])  # names come after the ranks: a row for each title
        return most.join(self.suppliers.dropDuplicates(["product_id"]), "product_id").select("title_id", "product_id", "level_1", "level_2", "level_3")

    @cached_property
    def title_weeks(self) -> DataFrame:
        return self.title_facts.groupBy("week_end", "title_id").agg(F.sum("ae").alias("ae"), F.sum("quantity").alias("quantity"))

    @cached_property
    def orders(self) -> DataFrame:
        customer = self.raw("customer").select("c_custkey", F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("nation_id"))
        day = F.col("o_orderdate").cast("date")
        return (
            self.raw("orders")
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("order_id"), day.alias("day"), week_end(day).alias("week_end"), "label", "nation_id", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("decimal(18,2)").alias("ae"), "c_custkey")
        )

    @cached_property
    def panel(self) -> DataFrame:
        return self.panel_since(None)

    def panel_since(self, first_week: str | None) -> DataFrame:
        """Weekly volume and share of each label; at most labels x weeks rows from here on. ``first_week``: the scan takes the days from its first on."""
        orders = self.orders
        if first_week is not None:
            orders = orders.filter((F.col("day") >= F.lit(str(date.fromisoformat(first_week) - timedelta(days=6))).cast("date")) & (F.col("week_end") >= F.lit(first_week).cast("date")))
        weekly = orders.groupBy("week_end", "label").agg(F.sum("ae").alias("ae"))
        total = weekly.groupBy("week_end").agg(F.sum("ae").alias("total"))
        return weekly.join(total, "week_end").select("week_end", F.year("week_end").cast("long").alias("year"), "label", "ae", F.round(F.col("ae").cast("double") / F.col("total").cast("double"), 8).alias("share"))

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))


#: The same relations for DuckDB, in order of dependence.
SQL = {
    "daily_fact": """SELECT CAST(l_shipdate AS DATE) AS report_date,
        CAST(l_shipdate AS DATE) + CAST((4 - isodow(l_shipdate) + 7) % 7 AS INTEGER) AS week_end,
        l_partkey AS title_id, l_suppkey AS product_id,
        CASE l_returnflag WHEN 'A' THEN 'Streams' WHEN 'N' THEN 'ProductSales' ELSE 'RecordingSales' END AS category,
        CASE WHEN l_linestatus = 'F' THEN 'OnDemand' ELSE 'Programmed' END AS service,
        CAST(l_quantity AS BIGINT) AS quantity,
        CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4)) AS ae FROM lineitem""",
    "titles": """SELECT p_partkey AS title_id, p_name AS title, p_brand AS artist, p_type AS release_type, CAST(p_size AS BIGINT) AS size, first_sale_date
        FROM part LEFT JOIN (SELECT title_id, min(report_date) AS first_sale_date FROM daily_fact GROUP BY 1) f ON f.title_id = p_partkey""",
    "suppliers": """SELECT s_suppkey AS product_id, s_name AS level_3, n_name AS level_2, r_name AS level_1
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ownership": """SELECT title_id, product_id, CAST(units AS BIGINT) AS units, level_1, level_2, level_3
        FROM (SELECT title_id, product_id, sum(quantity) AS units FROM daily_fact GROUP BY ALL) JOIN suppliers USING (product_id)""",
    "owners": """SELECT title_id, product_id, level_1, level_2, level_3 FROM ownership
        QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY units DESC NULLS LAST, product_id) = 1""",
    "title_weeks": """SELECT week_end, title_id, sum(ae) AS ae, CAST(sum(quantity) AS BIGINT) AS quantity FROM daily_fact GROUP BY ALL""",
    "order_rows": """SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS day,
        CAST(o_orderdate AS DATE) + CAST((4 - isodow(o_orderdate) + 7) % 7 AS INTEGER) AS week_end,
        c_mktsegment AS label, c_nationkey AS nation_id, o_orderstatus AS status, o_orderpriority AS priority,
        CAST(o_totalprice AS DECIMAL(18,2)) AS ae, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey""",
    "panel": """SELECT week_end, CAST(year(week_end) AS BIGINT) AS year, label, sum(ae) AS ae,
        round(CAST(sum(ae) AS DOUBLE) / CAST(sum(sum(ae)) OVER (PARTITION BY week_end) AS DOUBLE), 8) AS share
        FROM order_rows GROUP BY week_end, label""",
}


def with_relations(sql: str) -> str:
    """``sql`` preceded by the relations that it names."""
    used: set[str] = set()

    def mark(text: str) -> None:
        for name, body in SQL.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                mark(body)

    mark(sql)
    own = sql.strip()
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in used)
    if not head:
        return own
    if own[:5].upper() == "WITH ":
        return f"WITH {head}, {own[5:]}"
    return f"WITH {head} {own}"
