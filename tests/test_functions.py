import random
import re
import unicodedata
from urllib.parse import parse_qs, urldefrag, urlparse

import pytest
from pyspark.sql import functions as F

from garimpo.functions import classify as C
from garimpo.functions import html as H
from garimpo.functions import price as P
from garimpo.functions import stemmer, stores
from garimpo.functions import text as X
from garimpo.functions import url as U
from garimpo.functions.wordlists import SUFFIXES


def values(spark, rows, make):
    df = spark.createDataFrame(list(enumerate(rows)), "k int, x string")
    return [r[0] for r in df.select("k", make(F.col("x")).alias("y")).orderBy("k").select("y").collect()]


def plain_normal(url):
    url = urldefrag(url)[0]
    u = urlparse(url)
    q = {k: v[0] for k, v in parse_qs(u.query, keep_blank_values=True).items() if k.lower() not in U.TRACKING}
    path = re.sub("/ref=[^/]*", "", u.path.rstrip("/") or "/").rstrip("/") or "/"
    return f"{u.scheme.lower()}://{u.netloc.lower()}{path}" + ("?" + "&".join(f"{k}={v}" for k, v in sorted(q.items())) if q else "")


def test_normalize_agrees_with_the_standard_library(spark):
    random.seed(4)
    parts = ["/", "a", "B", "/ref=x", "?", "&", "=", "b=1", "utm_source=z", "ref=2", "a+b", "%C3%A9", "#f", ";p", "//", "c=", "B=2", "REF=3"]
    urls = ["http://Www.X.com.br" + "/" * (i % 2) + "".join(random.choices(parts, k=random.randint(0, 7))) for i in range(600)]
    urls = [u for u in urls if urlparse(u).netloc.lower() == "www.x.com.br"]
    assert values(spark, urls, U.normalize) == [plain_normal(u) for u in urls]


def test_url_families(spark):
    urls = ["https://www.kabum.com.br/produto/1/x", "https://www.kabum.com/produto/1", "https://lista.mercadolivre.com.br/ryzen", "https://www.amazon.com.br/gp/cart", "nonsense", None]
    assert values(spark, urls, U.domain) == ["kabum.com.br", "kabum.com", "mercadolivre.com.br", "amazon.com.br", "nonsense.", None]
    assert values(spark, urls, U.store_of) == ["kabum", None, "mercadolivre", "amazon", None, None]
    assert values(spark, urls[:4], U.is_allowed) == [True, False, True, False]
    assert values(spark, urls[:4], lambda u: U.priority(u, F.lit(3))) == [100, 0, 90, 44]
    assert values(spark, ["https://www.mercadolivre.com.br/notebook-lenovo-ideapad/p/MLB123", "https://x.com/a"], U.slug_name) == ["Notebook Lenovo Ideapad", ""]


def test_seeds(spark):
    assert sum(len(s.seed_urls) for s in stores.STORES if s.enabled) == 152
    assert {s.key: len(s.seed_urls) for s in stores.STORES} == {"kabum": 59, "mercadolivre": 53, "amazon": 40, "magazineluiza": 11}
    assert stores.seeds(spark, "kab").select("key").distinct().collect()[0][0] == "kabum"


def test_text_pipeline(spark):
    texts = ["Os Computadores rapidamente", "x 123456789 1234 até você", "", None, "O A e"]
    got = values(spark, texts, X.terms)
    assert got == [["comput", "rapida"], ["1234", "voc"], [], None, []]
    assert values(spark, ["ção ÁÉÍ ñ ş"], X.strip_accents) == ["cao AEI n s"]


def test_stem_agrees_with_the_ordered_scan(spark):
    random.seed(5)
    words = ["".join(random.choices(["a", "e", "o", "s", "m", "ent", "ad", "or", "ist", "ia", "av", "el", "r"], k=random.randint(1, 6))) for _ in range(800)]

    def scan(w):
        for s in SUFFIXES:
            if w.endswith(s) and len(w) - len(s) >= 3:
                return w[: len(w) - len(s)]
        return w

    assert values(spark, words, X.stem) == [scan(unicodedata.normalize("NFD", w)) for w in words]


def test_paper_stemmer(spark):
    stems = {"meninas": "menin", "rapidamente": "rapid", "casas": "cas", "bonito": "bonit", "bons": "bom", "balões": "bal", "mais": "mais", "vida": "vid", "rainha": "rainh", "caminho": "caminh", "firmamento": "firmament", "camarão": "cam", "topázio": "topázi", "processadores": "process", "possível": "possível", "notáveis": "not", "virgem": "virgem", "s": "s", "": ""}
    df = spark.createDataFrame([(w,) for w in stems] + [(None,)], "w string")
    assert [r[0] for r in df.select(stemmer.stem_udf()("w")).collect()] == [*stems.values(), None]
    # endings with accents are for accented words only
    assert stemmer.stem("baloes") != stemmer.stem("balões")


def test_paper_stemmer_takes_the_first_rule_that_holds():
    for name, rules in stemmer.STEPS.items():
        assert len({r[0] for r in rules}) == len(rules)
        for k, (ending, least, to, but) in enumerate(rules):
            word = "b" * least + ending
            earlier = [r for r in rules[:k] if word.endswith(r[0]) and len(word) - len(r[0]) >= r[1]]
            if not earlier:
                assert stemmer._step(word, name) == "b" * least + to
                assert all(stemmer._step(w, name) == w or any(w.endswith(r[0]) for r in rules if r[0] != ending) for w in but)


@pytest.mark.parametrize(("text", "price"), [("R$ 1.234,56", 1234.56), ("1234.56", 1234.56), ("12.345,99", 12345.99), ("R$ 999,90", 999.9), ("abc", None), ("0", None), ("-1", None), ("2.000.000,00", None), ("1.234", 1.23), (None, None)])
def test_parse_price(spark, text, price):
    assert values(spark, [text], P.parse_price) == [price]


def test_text_price(spark):
    pages = ["R$ 49,90", "R$ 50,00", "R$ 200.000,00", "99,90", "rgba(65,137,230,.15)", "R$ 70,00 R$ 80,00 R$ 80,00", "R$ 300 e R$ 1.000,00", '<p style="R$ 60,00">R$ 90', "R$ 90,00 R$ 80,00", "<script>R$ 60,00</script>"]
    assert values(spark, pages, lambda h: P.text_price(h)["price"]) == [None, 50.0, None, None, None, 80.0, 1000.0, 90.0, 90.0, None]


def test_classes(spark):
    names = ["Placa de Vídeo RTX", "Smart TV Full HD", "Pneu de carro", "SSD NVMe", "coisa", "", None]
    assert values(spark, names, C.category) == ["gpu", None, None, "ssd", None, None, None]
    assert values(spark, names, C.hardware_class) == ["hardware", "hardware", "non_hardware", "hardware", "unknown", "unknown", "unknown"]
    assert values(spark, names, C.report_class)[1:3] == ["hardware", "non_hardware"]


def test_page_functions(spark):
    page = '<html><title> A &amp; B </title><nav>no</nav><script>var a="</p>"</script><p>one<br>two&nbsp;</p><!-- x --><a href="/x">l1</a><a class="q" href=\'http://y.com/\'><b> l2 </b></a><a>none</a></html>'
    df = spark.createDataFrame([(page,)], "html string")
    r = df.select(H.title("html").alias("t"), H.visible_text("html").alias("v"), H.anchors("html").alias("a")).first()
    assert (r.t, r.v) == ("A & B", "A & B one two l1 l2 none")
    assert [tuple(a) for a in r.a] == [("/x", "l1"), ("http://y.com/", "l2")]
    joins = df.select(*[H.join_url(F.lit("https://h.com/a/b?q=1"), F.lit(h)).alias(f"c{i}") for i, h in enumerate(["//z.com/k", "/r", "c", "http://w", "../up"])]).first()
    assert list(joins) == ["https://z.com/k", "https://h.com/r", "https://h.com/a/c", "http://w", "https://h.com/up"]


def test_selectors():
    root = H.parse('<div class="a b"><h1 id=t>x</h1><span data-price="9">y</span></div><br><p class=c>z</p>')
    assert H.select(root, ".a h1").text() == "x"
    assert H.select(root, "h1#t").text() == "x"
    assert H.select(root, "[data-price]").attrs["data-price"] == "9"
    assert H.select(root, "p.c").text() == "z"
    assert H.select(root, ".c h1") is None


def test_links_resolve_as_urllib_does(spark):
    from urllib.parse import urljoin

    bases = ["http://h.com", "http://h.com/", "http://h.com/a/b", "http://h.com/a/b/", "https://h.com/a/b/c?x=1#f", "http://h.com/a//b"]
    hrefs = ["x", "./x", "../x", "../../x", "../../../x", "?page_number=2", "#f", "/x/../y", "/x", "//o.com/z", "mailto:a@b", "a/./b/../c", ".", "..", "x/..", "x//y", "/x//y", "x?y#z", "../", "a/b/../../../c", "/..", "/."]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string").select("b", "h", H.join_url("b", "h").alias("j")).collect()
    assert {(r.b, r.h): r.j for r in rows} == {(b, h): urljoin(b, h) for b in bases for h in hrefs}


def test_all_links_of_a_page(spark):
    page = """<a class=x href='../p/1'>um</a><a href=?page_number=2>2</a><A HREF="./b"> <b>c</b></A><a href="//www.kabum.com.br/d">d</a><a data-href="no">n</a><a href="">e</a>"""
    row = spark.createDataFrame([("https://www.kabum.com.br/a/b", page)], "url string, html string").select(H.anchors("html").alias("a"), H.links("url", "html").alias("l")).first()
    assert [(a.href, a.anchor_text) for a in row.a] == [("../p/1", "um"), ("?page_number=2", "2"), ("./b", "c"), ("//www.kabum.com.br/d", "d")]
    assert [x.url for x in row.l] == ["https://www.kabum.com.br/p/1", "https://www.kabum.com.br/a/b?page_number=2", "https://www.kabum.com.br/a/b", "https://www.kabum.com.br/d"]


def test_broken_pages_end_nothing(spark):
    script = '<script type="application/ld+json">{}</script>'
    pages = ["<ul>" + "<div><li>" * 3000 + "x", script.format("[" * 100_000), script.format('{"@type":[{}],"name":"n"}'), script.format('{"@type":"Product","name":"n","brand":["B"]}'), script.format('{"@type":"Product","name":"n","brand":[{"name":"C"}]}'), None]
    got = spark.createDataFrame([(k, h, "http://a.com/") for k, h in enumerate(pages)], "k int, html string, url string").select("k", H.page_udf()("html", "url").alias("p")).orderBy("k").collect()
    assert [(r.p.name, r.p.brand) for r in got] == [(None, None), (None, None), (None, None), ("n", "B"), ("n", "C"), (None, None)]
    assert got[0].p.text == "x"


def test_open_elements_end(spark):
    root = H.parse("<ul><li>a<li>b</ul><p>c<p>d")
    assert [(n.tag, n.parent.tag, n.text()) for n in root.walk()] == [("ul", "", "ab"), ("li", "ul", "a"), ("li", "ul", "b"), ("p", "", "c"), ("p", "", "d")]
