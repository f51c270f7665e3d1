"""Inline spans, array<struct<type, content, styles, url>>, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<type:string,content:string,styles:array<string>,url:string>"
# The order in which styles are kept.
STYLE_ORDER = ("bold", "italic", "underline", "strikethrough", "superscript", "subscript")


def styles(values: Column) -> Column:
    """Known styles in their fixed order, each once."""
    return F.array_intersect(F.array(*map(F.lit, STYLE_ORDER)), F.coalesce(values, F.array().cast("array<string>")))


def span(kind: Column, content: Column, style: Column, url: Column) -> Column:
    return F.struct(kind.alias("type"), content.alias("content"), styles(style).alias("styles"), url.alias("url"))


def normalise(spans: Column) -> Column:
    """Without empty spans; neighbours of one kind, style and target are one span."""
    empty = F.array().cast(f"array<{SPAN}>")

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        same = (last["type"] == s["type"]) & (last["styles"] == s["styles"]) & last["url"].eqNullSafe(s["url"]) & s["type"].isin("text", "link")
        longer = F.struct(last["type"].alias("type"), F.concat(last["content"], s["content"]).alias("content"), last["styles"].alias("styles"), last["url"].alias("url"))
        head = F.slice(out, F.lit(1), F.size(out) - 1)
        return F.when(F.coalesce(s["content"], F.lit("")) == "", out).when((F.size(out) > 0) & F.coalesce(same, F.lit(False)), F.concat(head, F.array(longer))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, empty, step)


def plain(spans: Column) -> Column:
    """The visible text."""
    return F.array_join(F.transform(spans, lambda s: F.coalesce(s["content"], F.lit(""))), "")


def map_text(spans: Column, f) -> Column:
    """``f`` on the content of every text span."""
    return F.transform(spans, lambda s: F.struct(s["type"].alias("type"), F.when(s["type"].isin("text", "link"), f(s["content"])).otherwise(s["content"]).alias("content"), s["styles"].alias("styles"), s["url"].alias("url")))


def cut(spans: Column, start: Column, end: Column) -> Column:
    """The spans of the visible characters from ``start`` up to ``end``."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        n = F.length(s["content"])
        lo, hi = F.greatest(start - a["at"], F.lit(0)), F.least(end - a["at"], n)
        piece = F.struct(s["type"].alias("type"), F.substr(s["content"], lo + 1, hi - lo).alias("content"), s["styles"].alias("styles"), s["url"].alias("url"))
        return F.struct((a["at"] + n).alias("at"), F.when(hi > lo, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    return F.aggregate(spans, zero, step)["out"]


def trim(spans: Column) -> Column:
    """Without white space at the visible text's ends."""
    text = plain(spans)
    lead = F.length(text) - F.length(F.regexp_replace(text, r"^\s+", ""))
    end = F.length(F.regexp_replace(text, r"\s+$", ""))
    return cut(spans, lead, end)


def replace(content: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), content.alias("content"), F.array().cast("array<string>").alias("styles"), F.lit(None).cast("string").alias("url")))


def to_markdown(spans: Column, escape) -> Column:
    """Spans as Markdown: emphasis, links, code and formulas."""
    def one(s: Column) -> Column:
        text = escape(s["content"])
        text = F.when(F.array_contains(s["styles"], "italic"), F.concat(F.lit("*"), text, F.lit("*"))).otherwise(text)
        text = F.when(F.array_contains(s["styles"], "bold"), F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)
        return (
            F.when(s["type"] == "code", F.concat(F.lit("`"), s["content"], F.lit("`")))
            .when(s["type"] == "equation", F.concat(F.lit("$"), s["content"], F.lit("$")))
            .when((s["type"] == "link") & s["url"].isNotNull(), F.concat(F.lit("["), text, F.lit("]("), s["url"], F.lit(")")))
            .otherwise(text)
        )

    return F.array_join(F.transform(spans, one), "")
