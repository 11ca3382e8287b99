"""Prices in Brazilian reais as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A price with thousands and cents; a plain one; bounds of prices found in text; the most a price can be.
WITH_CENTS = r"R\$[\s ]*(\d+(?:\.\d{3})*,\d{2})(?![0-9,.])"
PLAIN = r"R\$[\s ]*(\d+(?:,\d{2})?)(?![0-9,.])"
TEXT_LEAST, TEXT_MOST, MOST = 50, 100_000, 1_000_000
NOISE = [r"(?is)<style[^>]*>.*?</style>", r"(?is)<script[^>]*>.*?</script>", r'style="[^"]*"', r"style='[^']*'", r"(?i)rgba?\s*\([^)]*\)"]


def parse_price(text: Column | str) -> Column:
    """``R$ 1.234,56`` and the like as a number with two decimals; NULL unless over 0 and at most a million."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(text, r"[R$\s ]", "")
    comma, dot = bare.contains(","), bare.contains(".")
    plain = F.when(comma & dot, F.translate(F.translate(bare, ".", ""), ",", ".")).when(comma, F.translate(bare, ",", ".")).otherwise(bare)
    value = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    return F.when((value > 0) & (value <= MOST), F.round(value, 2))


def text_prices(html: Column | str) -> Column:
    """The prices in a page's text, in order, as raw and price; plain ones only where none has cents."""
    html = F.col(html) if isinstance(html, str) else html
    for n in NOISE:
        html = F.regexp_replace(html, n, "")

    def found(pattern: str) -> Column:
        made = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda r: F.struct(r.alias("raw"), parse_price(r).alias("price")))
        return F.filter(made, lambda p: (p["price"] >= TEXT_LEAST) & (p["price"] <= TEXT_MOST))

    first = found(WITH_CENTS)
    return F.when(F.size(first) > 0, first).otherwise(found(PLAIN))


def text_price(html: Column | str) -> Column:
    """The most frequent price in a page's text, the first seen of equals, with the text that gave it first."""
    prices = text_prices(html)
    ranked = F.transform(prices, lambda p, i: F.struct(F.size(F.filter(prices, lambda q: q["price"] == p["price"])).alias("n"), (-i).alias("first"), p["price"].alias("price"), p["raw"].alias("raw")))
    best = F.array_max(ranked)
    return F.when(F.size(ranked) > 0, F.struct(best["price"].alias("price"), best["raw"].alias("raw")))


def discount_percent(price: Column, original: Column) -> Column:
    return F.when((price > 0) & (original > price), ((1 - price / original) * 100).cast("int"))


def display(price: Column | str) -> Column:
    """``R$ 1,234.56``, or - for no price."""
    price = F.col(price) if isinstance(price, str) else price
    return F.when(price.isNull() | (price == 0), "-").otherwise(F.concat(F.lit("R$ "), F.format_number(price, 2)))
