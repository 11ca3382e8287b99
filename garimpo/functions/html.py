"""Page functions: regex expressions for simple parts, and one Arrow UDF that parses a page once for the rest.

Without a tree, visible text is defined as: comments and the elements script, style, nav, footer and header out, every
other tag to a space, entities decoded, white space squeezed.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from garimpo.functions import url as U

# JSON-LD types of products, selectors of prices, names and old prices, and signs of a product page.
PRODUCT_TYPES = ["Product", "IndividualProduct", "ProductModel", "Offer"]
STORE_PRICES = {
    "kabum.com.br": ["h4.finalPrice", ".finalPrice", "[data-price]", ".priceCard"],
    "mercadolivre.com.br": [".andes-money-amount__fraction", ".price-tag-fraction", '[itemprop="price"]', ".poly-price__current .andes-money-amount__fraction"],
    "magazineluiza.com.br": ['[data-testid="price-value"]', ".price-template__text", ".price-template-price-block"],
}
GENERIC_PRICES = [".price", ".product-price", "[data-price]", ".current-price", ".sale-price"]
NAMES = ["h1.product-name", "h1.product-title", 'h1[data-testid="product-title"]', ".product-name h1", ".product-title", "h1"]
OLD_PRICES = [".original-price", ".old-price", ".price-old", ".list-price", "del", "s"]
INDICATORS = [("button", "class", "buy|comprar|adicionar|cart"), ("button", "id", "buy|comprar|add-cart"), ("a", "class", "buy-button|add-to-cart|comprar"), ("span", "class", "price|preco|valor"), ("div", "class", "product-price|price-box"), ("div", "class", "product-info|product-detail"), ("section", "class", "product")]
HIDDEN = ["script", "style", "nav", "footer", "header"]
TITLE, TEXT, ANCHOR, NAME = 512, 50_000, 512, 512

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unescape(text: Column) -> Column:
    """The common named entities; & comes last, so that nothing is decoded twice."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def title(html: Column | str) -> Column:
    found = squeeze(unescape(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(found != "", F.substring(found, 1, TITLE))


def visible_text(html: Column | str) -> Column:
    plain = F.regexp_replace(_c(html), r"(?s)<!--.*?-->", " ")
    for tag in HIDDEN:
        plain = F.regexp_replace(plain, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return F.substring(squeeze(unescape(F.regexp_replace(plain, r"<[^>]*>", " "))), 1, TEXT)


#: An address in double, single or no quotes.
HREF_RE = r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def anchors(html: Column | str) -> Column:
    """href and anchor text of each link, in order, repeats included."""
    whole = F.regexp_extract_all(_c(html), F.lit(rf"(?is)(<a\s(?:[^>]*?\s)?{HREF_RE}[^>]*>.*?</a>)"), F.lit(1))
    href = lambda a: F.concat(*[F.regexp_extract(a, rf"(?is)^<a\s(?:[^>]*?\s)?{HREF_RE}", k) for k in (1, 2, 3)])
    made = F.transform(whole, lambda a: F.struct(F.trim(unescape(href(a))).alias("href"), squeeze(unescape(F.regexp_replace(a, "<[^>]*>", ""))).alias("text")))
    return F.transform(F.filter(made, lambda x: x["href"] != ""), lambda x: F.struct(x["href"].alias("href"), F.when(x["text"] != "", F.substring(x["text"], 1, ANCHOR)).alias("anchor_text")))


def resolve_path(base: Column, path: Column) -> Column:
    """The path that ``path`` names from a page at path ``base``: dots resolved, empty parts of relative paths left out."""
    folder = F.split(F.regexp_replace(base, "/[^/]+$", ""), "/")
    joined = F.concat(folder, F.split(path, "/"))
    inner = F.filter(F.slice(joined, 2, F.greatest(F.size(joined) - 2, F.lit(0))), lambda x: x != "")
    relative = F.concat(F.slice(joined, 1, 1), inner, F.slice(joined, -1, 1))
    parts = F.when(path.startswith("/"), F.split(path, "/")).otherwise(relative)
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    out = F.array_join(ended, "/")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def join_url(base: Column | str, href: Column | str) -> Column:
    """The absolute address of ``href`` on the page ``base`` (RFC 3986): other schemes as they are, then host-, root- and
    folder-relative addresses with their dots resolved, queries and fragments of the page itself."""
    base, href = _c(base), _c(href)
    root = F.concat(U.scheme(base), F.lit("://"), F.regexp_extract(base, U.URL_RE, 2))
    base_path, base_query = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    own = F.concat(base_path, F.when(rest.startswith("?"), "").otherwise(base_query))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(U.scheme(base), F.lit(":"), href))
        .when(path == "", F.concat(root, own, rest))
        .otherwise(F.concat(root, resolve_path(base_path, path), rest))
    )


def links(base: Column | str, html: Column | str, stores=None) -> Column:
    """Normalised allowed links of a page with their anchor text."""
    made = F.transform(anchors(html), lambda a: F.struct(U.normalize(join_url(base, a["href"])).alias("url"), a["anchor_text"].alias("anchor_text")))
    return F.filter(made, lambda a: U.is_allowed(a["url"], stores))


def json_ld(html: Column | str) -> Column:
    """The bodies of a page's JSON-LD scripts."""
    return F.regexp_extract_all(_c(html), F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))


def has_product_schema(html: Column | str) -> Column:
    """Whether a script's object, or one of those in its list, is a product by @type, a string or a list."""
    products = F.array(*[F.lit(t) for t in PRODUCT_TYPES])

    def typed(kind: Column) -> Column:
        several = F.from_json(F.when(kind.startswith("["), kind), "array<string>")
        return F.coalesce(F.array_contains(products, kind) | F.exists(F.coalesce(several, F.array().cast("array<string>")), lambda k: F.array_contains(products, k)), F.lit(False))

    def product(body: Column) -> Column:
        n = F.coalesce(F.json_array_length(body), F.lit(0))
        at = lambda path: F.call_function("get_json_object", body, path)
        listed = F.exists(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: typed(at(F.concat(F.lit("$["), i.cast("string"), F.lit("]['@type']")))))
        return F.try_parse_json(body).isNotNull() & (typed(at(F.lit("$['@type']"))) | listed)

    return F.exists(json_ld(html), lambda b: F.coalesce(product(b), F.lit(False)))


def meta(html: Column | str, prop: str) -> Column:
    """content of the first meta element with this property, before or after it; NULL if there is none or it is empty."""
    tag = F.regexp_extract(_c(html), rf"(?is)(<meta[^>]*property\s*=\s*[\"']{re.escape(prop)}[\"'][^>]*>)", 1)
    found = unescape(F.regexp_extract(tag, r"(?is)content\s*=\s*[\"']([^\"']*)[\"']", 1))
    return F.when(found != "", found)


def has_product_og(html: Column | str) -> Column:
    return F.coalesce(F.contains(F.lower(meta(html, "og:type")), F.lit("product")), F.lit(False)) | meta(html, "product:price:amount").isNotNull()


def indicator_count(html: Column | str) -> Column:
    """How many of the seven signs of a product page there are, each counted once."""
    test = lambda t, a, p: _c(html).rlike(rf"(?is)<{t}\b[^>]*\b{a}\s*=\s*[\"'][^\"']*({p})")
    return sum((test(*x).cast("int") for x in INDICATORS), F.lit(0))


def is_product_page(html: Column | str, url: Column | str, stores=None) -> Column:
    """Not a listing's address; a product's address, JSON-LD, OpenGraph, or three signs."""
    return F.when(U.is_listing_url(url), False).when(U.has_product_pattern(url, stores), True).when(has_product_schema(html), True).when(has_product_og(html), True).otherwise(indicator_count(html) >= 3)


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


#: Elements that an element of the same kind ends.
_ENDED = {"li", "p", "option", "tr", "td", "th", "dt", "dd"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """All nodes below, in order; pages may be nested more deeply than calls can be."""
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, Node):
                yield c
                todo += c.children[::-1]

    def strings(self, skip: frozenset = frozenset()):
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in skip:
                todo += c.children[::-1]

    def text(self) -> str:
        return "".join(s.strip() for s in self.strings())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDED and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _matches(node: Node, simple: str) -> bool:
    for kind, name, value in re.findall(r"(^[a-z0-9]+|\.[\w-]+|#[\w-]+|\[)([\w-]*)(?:=\"([^\"]*)\"\]|\])?", simple):
        if kind == "[":
            if name not in node.attrs or (value and node.attrs[name] != value):
                return False
        elif kind[0] == ".":
            if kind[1:] not in node.attrs.get("class", "").split():
                return False
        elif kind[0] == "#":
            if node.attrs.get("id") != kind[1:]:
                return False
        elif node.tag != kind + name:
            return False
    return True


def select(root: Node, selector: str) -> Node | None:
    """First node that a selector of tags, classes, ids, attributes and descendants matches."""
    *above, last = selector.split()
    for node in root.walk():
        if _matches(node, last):
            up, todo = node.parent, above[::-1]
            while up is not None and todo:
                if up.tag and _matches(up, todo[0]):
                    todo = todo[1:]
                up = up.parent
            if not todo:
                return node
    return None


def _price(text: object) -> float | None:
    bare = re.sub(r"[R$\s]", "", str(text))
    bare = bare.replace(".", "").replace(",", ".") if "," in bare and "." in bare else bare.replace(",", ".")
    try:
        value = float(bare)
    except ValueError:
        return None
    return round(value, 2) if 0 < value <= 1_000_000 else None


def _scripts(root: Node):
    for node in root.walk():
        if node.tag == "script" and node.attrs.get("type", "").lower() == "application/ld+json":
            try:
                yield json.loads("".join(node.strings()))
            except (ValueError, RecursionError):
                continue


def _kind(data: object) -> bool:
    kinds = data.get("@type") if isinstance(data, dict) else None
    return any(isinstance(k, str) and k in PRODUCT_TYPES for k in (kinds if isinstance(kinds, list) else [kinds]))


def _brand(brand: object) -> str | None:
    """The name of a brand that is a text, an object with a name, or a list of these."""
    brand = brand[0] if isinstance(brand, list) and brand else brand
    brand = brand.get("name") if isinstance(brand, dict) else brand
    return brand if isinstance(brand, str) else None


def _offer(data: dict) -> object:
    offers = data.get("offers")
    offers = offers[0] if isinstance(offers, list) and offers else offers
    return offers.get("price") if isinstance(offers, dict) else None


def product_info(root: Node) -> dict:
    """name, sku, brand and price: of the first product in JSON-LD, else from meta elements, else from headings or the title."""
    for data in _scripts(root):
        data = next((x for x in data if _kind(x)), None) if isinstance(data, list) else data
        if isinstance(data, dict) and _kind(data) and data.get("name"):
            price = _offer(data)
            try:
                price = None if price is None else float(price)
            except (TypeError, ValueError):
                continue
            return {"name": str(data["name"]), "sku": None if data.get("sku") is None else str(data["sku"]), "brand": _brand(data.get("brand")), "price": price}
    metas = {}
    for n in root.walk():
        if n.tag == "meta" and n.attrs.get("content"):
            metas.setdefault(n.attrs.get("property"), n.attrs["content"])
    if metas.get("og:title"):
        return {"name": metas["og:title"], "sku": None, "brand": metas.get("product:brand"), "price": _price(metas.get("product:price:amount"))}
    name = None
    for s in NAMES:
        node = select(root, s)
        if node is not None:
            name = node.text()
            if len(name) > 5:
                break
    if not name:
        node = select(root, "title")
        name = node.text().split("|")[0].split("-")[0].strip() if node is not None else None
    return {"name": name or None, "sku": None, "brand": None, "price": None}


def structured_price(root: Node, host: str) -> tuple[float | None, str | None]:
    """Price from JSON-LD offers, then meta elements, then the shop's and the general selectors."""
    for data in _scripts(root):
        data = data[0] if isinstance(data, list) and data else data
        raw = (_offer(data) if data.get("offers") is not None else data.get("price")) if isinstance(data, dict) else None
        if raw is not None and _price(raw):
            return _price(raw), str(raw)
    for n in root.walk():
        if n.tag == "meta" and n.attrs.get("property") == "product:price:amount" and _price(n.attrs.get("content", "")):
            return _price(n.attrs["content"]), n.attrs["content"]
    node = select(root, '[itemprop="price"]')
    if node is not None:
        raw = node.attrs.get("content") or node.text()
        if _price(raw):
            return _price(raw), raw
    for s in [x for d, xs in STORE_PRICES.items() if d in host for x in xs] + GENERIC_PRICES:
        node = select(root, s)
        if node is not None:
            for raw in (node.attrs.get("data-price"), node.attrs.get("content"), node.text()):
                if raw and _price(raw):
                    return _price(raw), raw
    return None, None


def old_price(root: Node, price: float | None) -> float | None:
    for s in OLD_PRICES:
        node = select(root, s)
        found = _price(node.text()) if node is not None else None
        if found and price and found > price:
            return found
    return None


PAGE = "title string, text string, name string, sku string, brand string, info_price double, price double, price_raw string, old_price double"


def page_udf():
    """One parse of a page for all that needs its tree. A broken page gives what could be read of it; NULL gives NULLs."""

    @F.pandas_udf(PAGE)
    def read(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = []
        for h, u in zip(html, url, strict=True):
            if h is None:
                rows.append((None,) * 9)
                continue
            root = parse(h)
            top = select(root, "title")
            info = product_info(root)
            host = re.sub(r"www\.|lista\.", "", re.sub(r"^[^:]*://([^/?#]*).*$", r"\1", u or "", flags=re.S).lower())
            price, raw = structured_price(root, host)
            shown = " ".join(s.strip() for s in root.strings(frozenset(HIDDEN)) if s.strip())
            rows.append(((top.text()[:TITLE] or None) if top is not None else None, shown[:TEXT], info["name"], info["sku"], info["brand"], info["price"], price, raw, old_price(root, price)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PAGE.split(", ")])

    return read
