"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garimpo.functions.stores import STORES, Store

# Query keys that only track, endings of files that aren't pages, and parts of listing pages' addresses.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "ref", "src", "source", "_gl", "_ga", "mc_cid", "mc_eid"]
FILE_ENDINGS = ["pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "css", "js", "ico", "woff", "woff2", "ttf", "mp4", "mp3", "avi", "mov", "zip", "rar"]
LISTING_PARTS = ["/categoria/", "/c/", "/list", "/busca", "/search", "/hardware", "/informatica", "/s/"]
LISTING_RE = "|".join([
    r"kabum\.com\.br/(hardware|computadores|gamer|perifericos|tv|celular|electrodomesticos|esporte|ferramentas)(/[a-z-]+)*/?$",
    r"mercadolivre\.com\.br/(busca|s\?|lista\.|categoria)",
    r"lista\.mercadolivre\.com\.br/",
    r"amazon\.com\.br/s\?",
    r"amazon\.com\.br/s/",
    r"/(colecao|categorias?|departamento|vitrine|busca|search|catalog|c/)(/|$)",
])
PRODUCT_RE = "|".join([r"/produto/\d+", r"/p/[a-z0-9]+", "/product/", "/item/", r"MLB-?\d{8,}", r"/\d+/p/?$"])
#: Suffixes of two labels under which names are registered.
TWO_LABELS = ["com.br", "net.br", "org.br", "gov.br", "edu.br", "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.mx", "com.ar", "com.co", "com.pt", "co.in", "co.za", "com.tr", "com.cn"]

URL_RE = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), URL_RE, 1))


def netloc(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), URL_RE, 2))


def query_string(query: Column) -> Column:
    """Decoded pairs without tracking keys, the first of each key, in order of keys, joined again without encoding."""
    decode = lambda s: F.coalesce(F.try_url_decode(s), F.replace(s, F.lit("+"), F.lit(" ")))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING))
    first = F.filter(F.transform(kept, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))), lambda p: F.array_position(F.transform(kept, lambda q: q["k"]), p["k"]) == p["i"] + 1)
    return F.array_join(F.transform(F.array_sort(first), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def normalize(url: Column | str) -> Column:
    """Scheme and host in lower case, no fragment, no tracking keys, no ``/ref=`` segments, no trailing slash. NULL stays NULL."""
    url = _c(url)
    plain = F.regexp_replace(url, "#.*$", "")
    has = plain.rlike(URL_RE)
    body = F.when(has, F.regexp_extract(plain, URL_RE, 3)).otherwise(F.substring_index(plain, "?", 1))
    path = F.regexp_replace(F.regexp_replace(body, r";[^/]*$", ""), "/+$", "")
    path = F.regexp_replace(F.regexp_replace(path, "/ref=[^/]*", ""), "/+$", "")
    query = query_string(F.when(plain.contains("?"), F.regexp_replace(plain, r"^[^?]*\?", "")).otherwise(""))
    return F.concat(scheme(plain), F.lit("://"), netloc(plain), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def hash_url(url: Column | str) -> Column:
    return F.sha2(_c(url).cast("binary"), 256)


def host(url: Column | str) -> Column:
    """Host name without user, port and trailing dot."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r"(:\d*)?\.?$", "")


def domain(url: Column | str) -> Column:
    """The registered name: the public suffix and one label before it. Text that is no URL gives itself up to the first slash and a dot."""
    h = host(url)
    labels = F.when(F.substring_index(h, ".", -2).isin(TWO_LABELS), 3).otherwise(2)
    name = F.when(labels == 3, F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))
    return F.when(h == "", F.concat(F.regexp_extract(_c(url), "^([^/?#.]*)", 1), F.lit("."))).otherwise(name)


def price_host(url: Column | str) -> Column:
    """Host for price selectors: without ``www.`` and ``lista.`` anywhere."""
    return F.replace(F.replace(netloc(url), F.lit("www.")), F.lit("lista."))


def store_label(domain_: Column | str) -> Column:
    return F.replace(F.replace(_c(domain_), F.lit(".com.br")), F.lit("www."))


def _by_store(url: Column, pick, other: Column, stores: list[Store] | None) -> Column:
    """A value by the shop whose registered domain the URL has."""
    out = None
    for s in STORES if stores is None else stores:
        test = domain(url) == s.domain
        out = F.when(test, pick(s)) if out is None else out.when(test, pick(s))
    return out.otherwise(other)


def store_of(url: Column | str, stores: list[Store] | None = None) -> Column:
    """Key of the shop whose domain is the URL's registered domain, else NULL."""
    return _by_store(_c(url), lambda s: F.lit(s.key), F.lit(None).cast("string"), stores)


def store_mentioned(url: Column | str, stores: list[Store] | None = None) -> Column:
    """Key of the first shop whose domain is anywhere in the URL, else NULL."""
    return F.coalesce(*[F.when(F.contains(F.lower(_c(url)), F.lit(s.domain)), s.key) for s in (STORES if stores is None else stores)])


def _any(patterns: list[str]) -> str:
    return "(?i)" + "|".join(patterns)


def is_product_url(url: Column | str, stores: list[Store] | None = None) -> Column:
    url = _c(url)
    return _by_store(url, lambda s: url.rlike(_any(s.product_patterns)), F.lit(False), stores)


def is_allowed(url: Column | str, stores: list[Store] | None = None) -> Column:
    """An enabled shop's page: not ignored by the shop, http or https, no file."""
    url = _c(url)
    fine = _by_store(url, lambda s: F.lit(s.enabled) & ~url.rlike(_any(s.ignore_patterns)), F.lit(False), stores)
    return fine & url.rlike("^https?://") & ~F.lower(url).rlike(r"\.(" + "|".join(FILE_ENDINGS) + ")$")


def priority(url: Column | str, depth: Column | str, stores: list[Store] | None = None) -> Column:
    """0 for unknown shops, 100 for products, 90 for seeds, 80 for listings, else 50 less 2 a level, 10 at least."""
    url = _c(url)
    listing = F.lower(url).rlike("|".join(LISTING_PARTS))
    rest = F.greatest(F.lit(10), F.lit(50) - 2 * _c(depth))
    return _by_store(url, lambda s: F.when(url.rlike(_any(s.product_patterns)), 100).when(url.isin(s.seed_urls), 90).when(listing, 80).otherwise(rest), F.lit(0), stores).cast("int")


def is_listing_url(url: Column | str) -> Column:
    return _c(url).rlike("(?i)" + LISTING_RE)


def has_product_pattern(url: Column | str, stores: list[Store] | None = None) -> Column:
    return _c(url).rlike("(?i)" + PRODUCT_RE) | is_product_url(url, stores)


def slug_name(url: Column | str) -> Column:
    """A product's name from the last segment of its address; '' under five characters."""
    path = F.regexp_replace(F.regexp_extract(_c(url), URL_RE, 3), "/+$", "")
    path = F.regexp_replace(F.substring_index(path, "/p/MLB", 1), "/+$", "")
    slug = F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"MLB\d+", ""), r"\d{5,}", "")
    words = F.trim(F.regexp_replace(F.translate(slug, "-_", "  "), r"\s+", " "))
    # a letter is a capital after anything that isn't a letter, as in 4Gb
    titled = F.array_join(F.transform(F.regexp_extract_all(words, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")
    return F.when(F.length(titled) >= 5, titled).otherwise("")


def url_item(url: Column | str, depth: Column | str, stores: list[Store] | None = None) -> Column:
    """What the frontier holds of a URL: url, url_hash, domain, depth, priority."""
    norm = normalize(url)
    return F.struct(norm.alias("url"), hash_url(norm).alias("url_hash"), domain(norm).alias("domain"), _c(depth).cast("int").alias("depth"), priority(norm, depth, stores).alias("priority"))
