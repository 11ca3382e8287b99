"""Classes of products by the words in their names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garimpo.functions.wordlists import CATEGORIES, HARDWARE, NON_HARDWARE, REPORT_HARDWARE, REPORT_NON_HARDWARE

# Signs of a blocked page, and parts of titles that name no product.
BLOCKED = ["suspicious_traffic", "captcha", "challenge", "blocked"]
GENERIC = ["kabum!", "amazon.com.br", "mercado livre", "maior e-commerce", "prime ninja", "programas grátis", "programas gratuitos", "até 15% off", "até 15 off", "com desconto", "benefícios"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quoted(parts: list[str]) -> str:
    """One pattern for any of the parts, each as it stands."""
    special = set(r"\.[]{}()*+-?^$|/")
    return "|".join("".join("\\" + c if c in special else c for c in p) for p in parts)


def has_any(text: Column | str, parts: list[str]) -> Column:
    """Whether the lower-case text has one of the parts anywhere."""
    return F.lower(_c(text)).rlike(quoted(parts))


def category(name: Column | str) -> Column:
    """The category with most of its words in the name, the first listed of equals; NULL without any."""
    low = F.lower(_c(name))
    score = lambda ws: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0))
    best = F.array_max(F.array(*[F.struct(score(ws).alias("score"), F.lit(-k).alias("ord"), F.lit(c).alias("category")) for k, (c, ws) in enumerate(CATEGORIES.items())]))
    return F.when(best["score"] > 0, best["category"])


def hardware_class(name: Column | str) -> Column:
    """hardware, non_hardware or unknown; a word against hardware wins."""
    known = F.coalesce(_c(name), F.lit("")) != ""
    return F.when(known & has_any(name, NON_HARDWARE), "non_hardware").when(known & has_any(name, HARDWARE), "hardware").otherwise("unknown")


def report_class(name: Column | str) -> Column:
    """The product report's class: its own lists, and hardware wins."""
    known = F.coalesce(_c(name), F.lit("")) != ""
    return F.when(known & has_any(name, REPORT_HARDWARE), "hardware").when(known & has_any(name, REPORT_NON_HARDWARE), "non_hardware").otherwise("unknown")


def is_blocked(html: Column | str) -> Column:
    return F.coalesce(has_any(html, BLOCKED), F.lit(False))


def is_generic(name: Column | str) -> Column:
    return F.coalesce(has_any(name, GENERIC), F.lit(False))
