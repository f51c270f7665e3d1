"""Dates, serial numbers, quantiles and page ranges as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def property_date(value: Column) -> Column:
    """A PDF date (D:YYYYMMDDHHmmSS+hh'mm') or ISO date as ISO text of its own precision; null if it is none."""
    shape = r"^\s*(?:D:)?(\d{4})-?(\d{2})?-?(\d{2})?[T ]?(\d{2})?:?(\d{2})?:?(\d{2})?"
    y, mo, d, h, mi, s = (F.regexp_extract(value, shape, k) for k in range(1, 7))
    zone = F.regexp_extract(value, r"(Z|[+-]\d{2}'?:?\d{2}'?)\s*$", 1)
    zone = F.when((h == "") | (zone == ""), "").when(zone == "Z", "Z").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.regexp_extract(zone, r"(\d{2})'?$", 1)))
    ok = (y != "") & ((mo == "") | mo.between("01", "12")) & ((d == "") | d.between("01", "31")) & ((h == "") | (h <= "23")) & ((mi == "") | (mi <= "59")) & ((s == "") | (s <= "59"))
    real = (d == "") | F.try_to_timestamp(F.concat_ws("-", y, mo, d), F.lit("yyyy-MM-dd")).isNotNull()
    part = lambda c, lead: F.when(c != "", F.concat(F.lit(lead), c)).otherwise("")
    return F.when(ok & real, F.concat(y, part(mo, "-"), part(d, "-"), part(h, "T"), part(mi, ":"), part(s, ":"), zone))


def property_count(value: Column) -> Column:
    """A non-negative whole number, or null."""
    n = F.regexp_extract(value, r"^\s*\+?(\d{1,18})\s*$", 1)
    return F.try_to_number(F.nullif(n, F.lit("")), F.lit("9" * 18)).cast("long")


def serial_date(serial: Column, date1904: bool = False) -> Column:
    """A spreadsheet's day number as YYYY-MM-DD; null for day 60 of the 1900 system, which never was."""
    day = F.floor(serial).cast("int")
    if date1904:
        return F.date_format(F.date_add(F.lit("1904-01-01").cast("date"), day), "yyyy-MM-dd")
    at = F.date_add(F.lit("1899-12-31").cast("date"), F.when(day > 60, day - 1).otherwise(day))
    return F.when(day != 60, F.date_format(at, "yyyy-MM-dd"))


def serial_time(serial: Column) -> Column:
    """The time of day of a day number, to the second."""
    s = F.pmod(F.round((serial - F.floor(serial)) * 86400).cast("long"), F.lit(86400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60))))


def half_up(value: Column, places: int) -> Column:
    """A decimal rounded half up."""
    return F.round(value.cast("decimal(28,10)"), places)


def to_points(value: Column) -> Column:
    """A length in whole points, half up."""
    return F.floor(value + 0.5).cast("long")


def nearest_quantile(values: Column, q: float) -> Column:
    """The sample at rank round-half-even((n - 1) q) of an array."""
    s = F.array_sort(values)
    return F.get(s, F.bround((F.size(s) - 1) * F.lit(float(q))).cast("int"))


def sample_pages(count: Column, most: int = 10) -> Column:
    """0-based pages to look at: all if there are at most ``most``, else evenly spread ones, filled up from the front."""
    every = F.sequence(F.lit(0), count - 1)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (count - 1) / (most - 1)).cast("int")))
    fill = F.slice(F.array_except(every, spread), F.lit(1), F.lit(most) - F.size(spread))
    return F.when(count <= 0, F.array().cast("array<int>")).when(count <= most, every).otherwise(F.array_sort(F.concat(spread, fill)))


def page_range(raw: Column, count: Column) -> Column:
    """The 0-based pages of a text like '1-5,8,r3-r1' or 'all' for a document of ``count`` pages; null if it is malformed."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    shape = r"^\s*(r?[1-9][0-9]{0,8})(?:\s*-\s*(r?[1-9][0-9]{0,8}))?\s*$"
    place = lambda t: F.when(t.startswith("r"), count + 1 - F.regexp_replace(t, "^r", "").cast("int")).otherwise(F.when(t.rlike("^[0-9]+$"), t).cast("int"))
    parts = F.split(text, ",")

    def pages(p: Column) -> Column:
        first, second = F.regexp_extract(p, shape, 1), F.regexp_extract(p, shape, 2)
        lo = place(first)
        hi = F.when(second == "", lo).otherwise(place(second))
        lo, hi = F.greatest(lo, F.lit(1)), F.least(hi, count)
        return F.when(lo <= hi, F.sequence(lo - 1, hi - 1)).otherwise(F.array().cast("array<int>"))

    fine = F.forall(parts, lambda p: p.rlike(shape))
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.when((text == "") | (text == "all"), every).when(fine, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages)))))


def format_pages(pages: Column) -> Column:
    """Sorted, different page numbers as compact ranges: 1-3,7."""
    zero = F.struct(F.lit("").alias("out"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def shown(a: Column) -> Column:
        run = F.when(a["lo"] == a["hi"], a["lo"].cast("string")).otherwise(F.concat(a["lo"].cast("string"), F.lit("-"), a["hi"].cast("string")))
        return F.when(a["lo"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.when(a["out"] == "", "").otherwise(","), run))

    def step(a: Column, p: Column) -> Column:
        goes_on = p == a["hi"] + 1
        return F.struct(
            F.when(goes_on, a["out"]).otherwise(shown(a)).alias("out"), F.when(goes_on, a["lo"]).otherwise(p).alias("lo"), p.alias("hi"),
        )

    return F.aggregate(F.transform(pages, lambda p: p.cast("int")), zero, step, shown)


def general(value: Column) -> Column:
    """A number as a spreadsheet's General format shows it: up to 15 significant digits, no trailing zeros."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", value), r"0+$", ""), r"\.$", "")
    return F.when(value.isNull(), None).when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(plain)
