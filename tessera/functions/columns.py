"""Column expressions: guarded ratios, share units, chart and fiscal calendars, owner names, search text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Ratios.


def div0(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, 0 where b is 0; null if either is null."""
    a, b = _c(a), _c(b)
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(0.0))).otherwise(a / b)


def ratio_or(a: ColumnOrName, b: ColumnOrName, default: float = 0.0) -> Column:
    """a / b, the default where the ratio is null or b is 0."""
    return F.coalesce(_c(a) / F.nullif(_c(b), F.lit(0)), F.lit(default))


def safe_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b for positive b, otherwise 1."""
    return F.when(_c(b) > 0, _c(a) / _c(b)).otherwise(F.lit(1.0))


def bps(x: ColumnOrName) -> Column:
    return _c(x) * 10000


def trunc2(x: ColumnOrName) -> Column:
    """Cut to two decimals, towards zero; the slack keeps numbers like 8.85, stored a little below, as they are."""
    x = _c(x)
    return F.signum(x) * F.floor(F.abs(x) * 100 + F.lit(1e-9)) / 100


def clip(x: ColumnOrName, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


# Shares come as fractions, percents or basis points.


def share_fraction(x: ColumnOrName) -> Column:
    """Row by row: above 100 in basis points, above 1 in percent, else a fraction."""
    x = _c(x)
    return F.when(x > 100, x / 10000).when(x > 1, x / 100).otherwise(x)


def share_percent_by_median(x: ColumnOrName, median: ColumnOrName) -> Column:
    """The whole column in percent: fractions if their median is at most 1."""
    return F.when(_c(median) <= 1, _c(x) * 100).otherwise(_c(x))


def share_fraction_by_median(x: ColumnOrName, median: ColumnOrName) -> Column:
    return F.when(_c(median) > 1, _c(x) / 100).otherwise(_c(x))


# Calendars.


def week_end(d: ColumnOrName) -> Column:
    """The Thursday on or after a date."""
    d = _c(d)
    return F.date_add(d, F.pmod(3 - F.weekday(d), F.lit(7)))


def expected_week(as_of: ColumnOrName) -> Column:
    """The latest chart week to be expected: the Thursday before a date."""
    d = _c(as_of)
    return F.date_sub(d, F.pmod(F.weekday(d) - 4, F.lit(7)) + 1)


def week_number(d: ColumnOrName, first: ColumnOrName) -> Column:
    """Weeks from the first date, rounded half to even, from 1 on."""
    return F.bround(F.datediff(_c(d), _c(first)) / 7).cast("long") + 1


def weeks_since(d: ColumnOrName, start: ColumnOrName) -> Column:
    return F.ceil(F.datediff(_c(d), _c(start)) / F.lit(7.0)).cast("long")


def fiscal_year(d: ColumnOrName) -> Column:
    """Fiscal years begin in September of the calendar year before."""
    d = _c(d)
    return (F.year(d) + F.when(F.month(d) >= 9, 1).otherwise(0)).cast("long")


def fiscal_month(d: ColumnOrName) -> Column:
    """September is 1."""
    return (F.pmod(F.month(_c(d)) + 3, F.lit(12)) + 1).cast("long")


def fiscal_quarter(d: ColumnOrName) -> Column:
    return F.ceil(fiscal_month(d) / 3).cast("long")


def fiscal_month_label(last_day: ColumnOrName) -> Column:
    """Month name, marked with its last day as long as the month is not over."""
    d = _c(last_day)
    name = F.date_format(d, "MMM")
    return F.when(d < F.last_day(d), F.concat(name, F.lit(" - (END "), F.date_format(d, "MMM dd"), F.lit(")"))).otherwise(name)


#: Fiscal quarters by their last fiscal month.
QUARTERS = {1: "Q1 (Sep-Nov)", 2: "Q2 (Dec-Feb)", 3: "Q3 (Mar-May)", 4: "Q4 (Jun-Aug)"}


def fiscal_quarter_name(quarter: ColumnOrName) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in QUARTERS.items() for x in kv]), _c(quarter).cast("int"))


def fiscal_quarter_last_day(d: ColumnOrName) -> Column:
    """The day on which the quarter of a date is complete; days of December name the February before, so take the greatest of a quarter."""
    d = _c(d)
    month = F.element_at(F.create_map(*[F.lit(x) for kv in {1: 11, 2: 2, 3: 5, 4: 8}.items() for x in kv]), fiscal_quarter(d).cast("int"))
    return F.last_day(F.make_date(F.year(d), month, F.lit(1)))


def fiscal_quarter_label(quarter: ColumnOrName, max_day: ColumnOrName, last_day: ColumnOrName) -> Column:
    """The quarter's name, marked with the last day that there is as long as the quarter is not over."""
    name, d = fiscal_quarter_name(quarter), _c(max_day)
    return F.when(d < _c(last_day), F.concat(name, F.lit(" - (END "), F.date_format(d, "MMM dd"), F.lit(")"))).otherwise(name)


def period_end_in_label(fy: ColumnOrName, label: ColumnOrName) -> Column:
    """The day in "(END Mon DD)" of a label, in the calendar year that the month has in the fiscal year; null if there is none."""
    found = F.regexp_extract(_c(label), r"(?i)\(?END\s+([A-Za-z]{3})[a-z]*\.?\s+([0-9]{1,2})", 0)
    part = lambda k: F.regexp_extract(_c(label), r"(?i)\(?END\s+([A-Za-z]{3})[a-z]*\.?\s+([0-9]{1,2})", k)
    month = F.nullif(F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(part(1))) + 2) / 3), F.lit(0)).cast("int")
    year = _c(fy).cast("int") - F.when(month >= 9, 1).otherwise(0)
    return F.when(found != "", F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, part(2).try_cast("int")), "yyyy-MM-dd"))


def fiscal_window(fy: ColumnOrName, label: ColumnOrName) -> tuple[Column, Column]:
    """First and last day of the fiscal quarter that a label names; a day named in the label ends it. Null where nothing is named.

    Fixed value: without a day in the label, the second quarter ends on the 28th of February in leap years, too.
    """
    fy, q = _c(fy).cast("int"), F.regexp_extract(_c(label), r"(?i)Q\s*([1-4])", 1).try_cast("int")
    year_before = F.when(q <= 2, 1).otherwise(0)
    start = F.make_date(fy - year_before, F.element_at(F.array(*map(F.lit, (9, 12, 3, 6))), q), F.lit(1))
    plain = F.make_date(fy - F.when(q == 1, 1).otherwise(0), F.element_at(F.array(*map(F.lit, (11, 2, 5, 8))), q), F.element_at(F.array(*map(F.lit, (30, 28, 31, 31))), q))
    named = F.regexp_like(_c(label), F.lit(r"(?i)\(?END\s+[A-Za-z]{3}[a-z]*\.?\s+[0-9]{1,2}"))
    return F.when(q.isNotNull(), start), F.when(named, period_end_in_label(fy, label)).when(q.isNotNull(), plain)


def number_or_null(x: ColumnOrName) -> Column:
    """A number written as text; null for what is none, for NaN and for infinities."""
    v = _c(x).cast("string").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def effective_release_date(street: ColumnOrName, first_sale: ColumnOrName, since: str = "2014-01-05") -> Column:
    """Street date up to ``since``; later the first sale where known. Fixed value: data on first sales begin then."""
    return F.when(_c(street) <= F.lit(since).cast("date"), _c(street)).otherwise(F.coalesce(_c(first_sale), _c(street)))


# Names and text.


def owner_case(level_1: ColumnOrName, level_2: ColumnOrName, by_level_2: Sequence[str] = (), merged: Mapping[str, str] | None = None) -> Column:
    """The owner to report: level 2 for those listed, renamed as in ``merged``, else level 1; Unknown if there is none."""
    level_1, level_2 = _c(level_1), _c(level_2)
    out = None
    for name, to in (merged or {}).items():
        out = F.when(level_2 == name, F.lit(to)) if out is None else out.when(level_2 == name, F.lit(to))
    if by_level_2:
        out = F.when(level_2.isin(*by_level_2), level_2) if out is None else out.when(level_2.isin(*by_level_2), level_2)
    rest = F.coalesce(level_1, F.lit("Unknown"))
    return rest if out is None else out.otherwise(rest)


def text_or(x: ColumnOrName, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(_c(x)), F.lit("")), F.lit(default))


def truthy(x: ColumnOrName) -> Column:
    """Booleans written as text."""
    return F.coalesce(F.lower(F.trim(_c(x).cast("string"))).isin("true", "1", "yes", "t", "y"), F.lit(False))


def all_caps(x: ColumnOrName) -> Column:
    return (_c(x) == F.upper(_c(x))) & (_c(x) != F.lower(_c(x)))


def search_text(x: ColumnOrName) -> Column:
    """Lower-cased, without accents and punctuation, one space between words; built-in functions, so it stays in generated code.

    Accents are taken from the Latin letters of the fixed table below; ``functions.text.search_text_exact`` decomposes all.
    """
    # Letters and what they become.
    accented = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžœæßø"
    plain = "aaaaaaceeeeiiiinooooouuuuyyszoaso"
    return F.trim(F.regexp_replace(F.translate(F.lower(_c(x)), accented, plain), "[^\\p{L}\\p{N}]+", " "))


def search_tokens(x: ColumnOrName, least: int = 2) -> Column:
    """Distinct words in order, of at least ``least`` letters."""
    return F.array_distinct(F.filter(F.split(search_text(x), " "), lambda w: F.length(w) >= least))


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Of two arrays of distinct items; 0 if both are empty."""
    both, either = F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b)))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def like_literal(x: str) -> str:
    """A text with the wildcards of LIKE taken literally (escape character backslash)."""
    return x.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def slug(x: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "_"), F.lit("_"))


def first_part(x: ColumnOrName, separators: Sequence[str] = ("|", ",", ";", "/")) -> Column:
    """The text before the first separator of the list that occurs at all."""
    x = _c(x)
    out = F.when(F.instr(x, separators[0]) > 0, F.substring_index(x, separators[0], 1))
    for s in separators[1:]:
        out = out.when(F.instr(x, s) > 0, F.substring_index(x, s, 1))
    return F.trim(out.otherwise(x))
