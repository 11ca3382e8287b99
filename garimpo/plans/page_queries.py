"""Page, price, product and class functions over the given pages and over made-up shop pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import classify as C
from garimpo.functions import html as H
from garimpo.functions import price as P
from garimpo.functions import stores as ST
from garimpo.functions import url as U
from garimpo.functions.wordlists import CATEGORIES, HARDWARE, NON_HARDWARE, REPORT_HARDWARE, REPORT_NON_HARDWARE
from garimpo.operators import products as PR
from garimpo.plans.views import DOMAIN_SQL, HOST_SQL, TITLE_SQL, repr_sql, sql_list, t, unescape_sql

_LD = '<script type="application/ld+json">{}</script>'
SHOP_PAGES = [
    ("https://www.kabum.com.br/produto/11/ssd", "<html><head><title>SSD Kingston 480GB | KaBuM!</title>" + _LD.format('{"@type":"Product","name":"SSD Kingston 480GB","sku":"SK1","brand":{"name":"Kingston"},"offers":{"price":"299.90"}}') + "</head><body><h1>SSD</h1></body></html>"),
    ("https://www.kabum.com.br/hardware/ssd-2-5", "<html><head><title>SSDs</title>" + _LD.format('{"@type":"Product","name":"SSD","offers":{"price":1}}') + "</head></html>"),
    ("https://www.amazon.com.br/dp/B01", '<html><head><title>x</title><meta property="og:type" content="product"><meta property="og:title" content="Placa de Video RTX 4070"><meta property="product:price:amount" content="3899.00"></head></html>'),
    ("https://loja.example.com/a", '<html><body><button class="btn-comprar">ok</button><span class="preco">R$ 1.234,56</span><div class="product-info">Teclado</div><p>R$ 1.234,56 ou R$ 999,90</p></body></html>'),
    ("https://loja.example.com/b", "<html><head><title>captcha</title></head><body>blocked</body></html>"),
    ("https://www.mercadolivre.com.br/notebook-lenovo-ideapad/p/MLB1928", '<html><body><h1>Notebook Lenovo Ideapad</h1><span class="andes-money-amount__fraction">4.599</span><s>R$ 5.000,00</s></body></html>'),
    ("https://loja.example.com/c", "<html>" + _LD.format("[{broken") + _LD.format('[{"@type":["Thing","Offer"],"name":"Oferta","offers":[{"price":"1.599,90"}]}]') + "</html>"),
    ("https://loja.example.com/d", "<html>" + _LD.format("[" + '{"@type":"Thing"},' * 11 + '{"@type":"Product","name":"doze"}]') + "</html>"),
    ("https://loja.example.com/e", "<html>" + _LD.format('{"@type":["A","B","C","D","ProductModel"]}') + _LD.format('{"x":{"@type":"Product"}}') + "</html>"),
    ("https://loja.example.com/f", "<html>" + _LD.format('[{"@type":["A"]},{"@type":"Productx"},{"name":"Product"}]') + "</html>"),
    ("https://loja.example.com/g", '<html><meta content="1" property="product:price:amount"></html>'),
    ("https://www.magazineluiza.com.br/geladeira/p/ab1/", "<html><h1>Geladeira 400L</h1><p>R$ 49,90 R$ 200.000,00</p></html>"),
]
PRICES = ["1.234,56", "1234,56", "R$ 12.345,99", "1234.56", "R$ 999,90", "abc", "0", "-5", "1000000,01", "1.234", "", "R$ 1 234,5", "nan", None]
NAMES = ["SSD NVMe 1TB", "Placa de Vídeo RTX 4070", "Smart TV Full HD 50", "Pneu de carro", "Cadeira gamer", "Livro de receitas", "Notebook Lenovo", "Memória RAM DDR4 8GB", "Motorola capa", "", None, "Fonte ATX 500W", "Mouse e teclado gamer", "HD externo 2TB", "coisa qualquer"]


def shop_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(SHOP_PAGES)], "k long, url string, html string")


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(NAMES)), "k int, name string")


def o35_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", H.title("html").alias("title"))


def o36_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = H.visible_text("html")
    return t(spark, sf_dir, "pages").select("page_id", F.length(text).alias("n"), F.md5(text.cast("binary")).alias("digest"))


def o36_visible_text_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a parsed tree."""
    return t(spark, sf_dir, "pages").select("page_id", H.page_udf()("html", "url").alias("p")).select("page_id", "p.title", F.length("p.text").alias("n"))


def o37_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", F.posexplode(H.anchors("html")).alias("pos", "a")).select("page_id", "pos", "a.href", "a.anchor_text")


def o37_joined_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link as it stands, and with dots, below the page, as a query and as a fragment."""
    made = t(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(H.anchors("html")).alias("pos", "a"))
    href = F.col("a.href")
    forms = F.array(href, F.concat(F.lit(".."), href), F.concat(F.lit("../.."), href, F.lit("/..")), F.concat(F.lit("."), href, F.lit("?q=1#f")), F.concat(F.lit("x/./y/../z//"), href), F.lit("?page_number=2"), F.lit("#top"), F.lit("//cdn.example.com/a"), F.concat(F.lit("/a/../b/."), href))
    return made.select("page_id", "pos", "url", F.posexplode(forms).alias("form", "href")).select("page_id", "pos", "form", H.join_url("url", "href").alias("target"))


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages and the made-up ones, whose numbers are negative."""
    return t(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), "url", "html").union(shop_pages(spark).select(F.col("k") - 100, "url", "html"))


def o38_json_ld_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir).select("k", H.has_product_schema("html").alias("product"))


def o39_open_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir).select("k", H.has_product_og("html").alias("product"))


def o40_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), "html").union(shop_pages(spark).select(F.col("k") - 100, "html")).select("k", H.indicator_count("html").alias("n"))


def o41_is_product_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir).select("k", H.is_product_page("html", "url").alias("product"))


def o42_product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and prices from JSON-LD, meta elements and selectors (O-42 to O-45 and O-49c to g) by one parse."""
    p = shop_pages(spark).select("k", H.page_udf()("html", "url").alias("p"))
    return p.select("k", "p.name", "p.sku", "p.brand", "p.price", "p.price_raw", "p.old_price", P.discount_percent(F.col("p.price"), F.col("p.old_price")).alias("discount"))


def o46_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), "html").union(shop_pages(spark).select(F.col("k") - 100, "html")).select("k", C.is_blocked("html").alias("blocked"))


def o47_generic_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark).union(spark.createDataFrame([(100, "Kabum! ofertas"), (101, "10 com desconto")], "k int, name string")).select("k", C.is_generic("name").alias("generic"))


def o48_product_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from garimpo.functions.url import domain

    return PR.products(shop_pages(spark).withColumn("page_id", F.col("k")).withColumn("domain", domain("url")))


def o49a_parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PRICES)), "k int, text string").select("k", P.parse_price("text").alias("price"))


def o49b_text_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("<b>R$ 1.500,00</b><i style=\"x: R$ 70,00\">R$ "), F.translate(F.format_number("p_retailprice", 2), ",.", ".,"), F.lit("</i> R$ "), F.translate(F.format_number("p_retailprice", 2), ",.", ".,"), F.lit(" <p>R$ 49,90"))
    return t(spark, sf_dir, "part").select("p_partkey", P.text_price(made)["price"].alias("price"))


def o50a_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark).select("k", C.category("name").alias("category"))


def o50b_hardware_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark).select("k", C.hardware_class("name").alias("class"))


def o50c_report_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark).select("k", C.report_class("name").alias("class"))


def o68_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(CATEGORIES.items()), "category string, words array<string>")
    return rows.select("category", F.array_join(F.slice("words", 1, 5), ", ").alias("first_words"), F.size("words").alias("n"))


def o68_seed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.seeds(spark, "KABUM, ama").select("key", "url")


_S = "s(k, url, html) AS (VALUES " + ", ".join(f"({k}, {repr_sql(u)}, {repr_sql(h)})" for k, (u, h) in enumerate(SHOP_PAGES)) + ")"
_N = "n(k, name) AS (VALUES " + ", ".join(f"({k}, {repr_sql(x)})" for k, x in enumerate(NAMES)) + ")"
_BOTH = f"{_S}, b AS (SELECT page_id AS k, url, html FROM pages UNION ALL SELECT k - 100, url, html FROM s)"
_KINDS = sql_list(H.PRODUCT_TYPES)
_LD_SQL = f"""ld0 AS (SELECT k, unnest(regexp_extract_all(html, '(?is)<script[^>]*type\\s*=\\s*["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1)) AS body FROM b),
ld1 AS (SELECT k, unnest(CASE WHEN json_type(body) = 'ARRAY' THEN json_extract(body, '$[*]."@type"') ELSE [json_extract(body, '$."@type"')] END) AS kind FROM (SELECT k, body::JSON AS body FROM ld0 WHERE json_valid(body))),
ld AS (SELECT DISTINCT k FROM (SELECT k, unnest(CASE WHEN json_type(kind) = 'ARRAY' THEN kind->>'$[*]' ELSE [kind->>'$'] END) AS kind FROM ld1) WHERE kind IN ({_KINDS}))"""
_META = "regexp_extract(html, '(?is)(<meta[^>]*property\\s*=\\s*[\"'']{}[\"''][^>]*>)', 1)"
_CONTENT = f"regexp_extract({_META}, '(?is)content\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"
_OG = f"(contains(lower({_CONTENT.format('og:type')}), 'product') OR {_CONTENT.format('product:price:amount')} <> '')"
_SHOP = " OR ".join(f"({DOMAIN_SQL} = {repr_sql(s.domain)} AND regexp_matches(url, {repr_sql('(?i)' + '|'.join(s.product_patterns))}))" for s in ST.STORES)


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {repr_sql(w)})" for w in words) + ")"


_PLAIN = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in H.HIDDEN:
    _PLAIN = f"regexp_replace({_PLAIN}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'g')"
_TEXT = "substr(trim(regexp_replace(" + unescape_sql(f"regexp_replace({_PLAIN}, '<[^>]*>', ' ', 'g')") + f", '[\\s ]+', ' ', 'g')), 1, {H.TEXT})"
_HREF = repr_sql("(?is)^<a\\s(?:[^>]*?\\s)?" + H.HREF_RE)
_ANCHORS = f"""a AS (SELECT page_id, url, unnest(xs) AS x, unnest(range(len(xs)))::INT AS pos FROM (SELECT page_id, url, regexp_extract_all(html, {repr_sql("(?is)<a\\s(?:[^>]*?\\s)?" + H.HREF_RE + "[^>]*>.*?</a>")}) AS xs FROM pages)),
h AS (SELECT page_id, url, pos, trim({unescape_sql(f"(regexp_extract(x, {_HREF}, 1) || regexp_extract(x, {_HREF}, 2) || regexp_extract(x, {_HREF}, 3))")}) AS href, nullif(substr(trim(regexp_replace({unescape_sql("regexp_replace(x, '<[^>]*>', '', 'g')")}, '[\\s ]+', ' ', 'g')), 1, 512), '') AS anchor_text FROM a)"""
_INDICATORS = " + ".join(f"regexp_matches(html, {repr_sql(f'''(?is)<{a}{chr(92)}b[^>]*{chr(92)}b{b}{chr(92)}s*={chr(92)}s*[\"'][^\"']*({c})''')})::INT" for a, b, c in H.INDICATORS)
_BARE = "regexp_replace(text, '[R$\\s ]', '', 'g')"
_NUM = f"CASE WHEN contains({_BARE}, ',') AND contains({_BARE}, '.') THEN replace(replace({_BARE}, '.', ''), ',', '.') ELSE replace({_BARE}, ',', '.') END"
_SCORE = "list_max([" + ", ".join(f"{{'score': {' + '.join(f'contains(lower(name), {repr_sql(w)})::INT' for w in ws)}, 'ord': {-k}, 'c': {repr_sql(c)}}}" for k, (c, ws) in enumerate(CATEGORIES.items())) + "])"

QUERIES = {f.__name__: f for f in (o35_title, o36_visible_text, o36_visible_text_tree, o37_anchors, o37_joined_links, o38_json_ld_product, o39_open_graph, o40_indicators, o41_is_product_page, o42_product_info, o46_blocked, o47_generic_title, o48_product_pipeline, o49a_parse_price, o49b_text_price, o50a_category, o50b_hardware_class, o50c_report_class, o68_categories, o68_seed_list)}
ORACLES = {
    "o35_title": f"SELECT page_id, {TITLE_SQL.format(unescape_sql(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)'])))} AS title FROM pages",
    "o36_visible_text": f"SELECT page_id, length(x)::INT AS n, md5(x) AS digest FROM (SELECT page_id, {_TEXT} AS x FROM pages)",
    "o37_anchors": f"WITH {_ANCHORS} SELECT page_id, pos, href, anchor_text FROM h WHERE href <> ''",
    "o37_joined_links": f"""WITH {_ANCHORS}, f AS (SELECT page_id, pos, url, unnest(range(9))::INT AS form, unnest([href, '..' || href, '../..' || href || '/..', '.' || href || '?q=1#f', 'x/./y/../z//' || href, '?page_number=2', '#top', '//cdn.example.com/a', '/a/../b/.' || href]) AS href FROM h WHERE href <> ''),
r AS (SELECT *, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) AS sch, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS net, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS bp, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS bq, regexp_extract(href, '^([^?#]*)', 1) AS p, regexp_extract(href, '^[^?#]*(.*)$', 1) AS rest FROM f),
s AS (SELECT *, string_split(regexp_replace(bp, '/[^/]+$', ''), '/') || string_split(p, '/') AS j FROM r),
u AS (SELECT *, CASE WHEN p LIKE '/%' THEN string_split(p, '/') ELSE [j[1]] || list_filter(j[2:len(j) - 1], lambda x: x <> '') || [j[len(j)]] END AS parts FROM s),
v AS (SELECT *, list_reduce(list_transform(parts, lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' THEN a[1:len(a) - 1] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END) AS done FROM u),
w AS (SELECT *, array_to_string(CASE WHEN parts[len(parts)] IN ('.', '..') THEN list_concat(done, ['']) ELSE done END, '/') AS q FROM v)
SELECT page_id, pos, form, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN sch || ':' || href WHEN p = '' THEN sch || '://' || net || bp || CASE WHEN rest LIKE '?%' THEN '' ELSE bq END || rest
  ELSE sch || '://' || net || CASE WHEN q LIKE '/%' THEN q ELSE '/' || q END || rest END AS target FROM w""",
    "o38_json_ld_product": f"WITH {_BOTH}, {_LD_SQL} SELECT k, ld.k IS NOT NULL AS product FROM b LEFT JOIN ld USING (k)",
    "o39_open_graph": f"WITH {_BOTH} SELECT k, {_OG} AS product FROM b",
    "o40_indicators": f"WITH {_BOTH} SELECT k, {_INDICATORS} AS n FROM b",
    "o41_is_product_page": f"""WITH {_BOTH}, {_LD_SQL} SELECT k, CASE WHEN regexp_matches(url, {repr_sql('(?i)' + U.LISTING_RE)}) THEN false WHEN regexp_matches(url, {repr_sql('(?i)' + U.PRODUCT_RE)}) OR {_SHOP} THEN true
  WHEN ld.k IS NOT NULL OR {_OG} THEN true ELSE {_INDICATORS} >= 3 END AS product FROM (SELECT *, {HOST_SQL} AS h FROM b) LEFT JOIN ld USING (k)""",
    "o46_blocked": f"WITH {_BOTH} SELECT k, {_any('html', C.BLOCKED)} AS blocked FROM b",
    "o47_generic_title": f"WITH {_N}, m AS (SELECT * FROM n UNION ALL SELECT 100, 'Kabum! ofertas' UNION ALL SELECT 101, '10 com desconto') SELECT k, coalesce({_any('name', C.GENERIC)}, false) AS generic FROM m",
    "o49a_parse_price": f"WITH p(k, text) AS (VALUES {', '.join(f'({k}, {repr_sql(x)})' for k, x in enumerate(PRICES))}), q AS (SELECT k, CASE WHEN regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN x::DOUBLE END AS v FROM (SELECT k, {_NUM} AS x FROM p)) SELECT k, CASE WHEN v > 0 AND v <= 1000000 THEN round(v, 2) END AS price FROM q",
    "o49b_text_price": "SELECT p_partkey, round(p_retailprice, 2) AS price FROM part",
    "o50a_category": f"WITH {_N}, b AS (SELECT k, {_SCORE} AS x FROM n WHERE name IS NOT NULL) SELECT n.k, CASE WHEN x.score > 0 THEN x.c END AS category FROM n LEFT JOIN b USING (k)",
    "o50b_hardware_class": f"WITH {_N} SELECT k, CASE WHEN coalesce(name, '') = '' THEN 'unknown' WHEN {_any('name', NON_HARDWARE)} THEN 'non_hardware' WHEN {_any('name', HARDWARE)} THEN 'hardware' ELSE 'unknown' END AS class FROM n",
    "o50c_report_class": f"WITH {_N} SELECT k, CASE WHEN coalesce(name, '') = '' THEN 'unknown' WHEN {_any('name', REPORT_HARDWARE)} THEN 'hardware' WHEN {_any('name', REPORT_NON_HARDWARE)} THEN 'non_hardware' ELSE 'unknown' END AS class FROM n",
    "o68_categories": "SELECT * FROM (VALUES " + ", ".join(f"({repr_sql(c)}, {repr_sql(', '.join(ws[:5]))}, {len(ws)})" for c, ws in CATEGORIES.items()) + ") AS x(category, first_words, n)",
    "o68_seed_list": "SELECT * FROM (VALUES " + ", ".join(f"({repr_sql(s.key)}, {repr_sql(u)})" for s in ST.STORES if s.key in ("kabum", "amazon") for u in s.seed_urls) + ") AS x(key, url)",
}
