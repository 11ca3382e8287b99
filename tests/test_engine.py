import json
import random

import pytest
from pyspark.sql import functions as F

from garimpo import cli
from garimpo.functions.stores import Store
from garimpo.operators import frontier as FR
from garimpo.operators import index as I
from garimpo.plans import frontier_queries, page_queries
from garimpo.sources import store as S
from garimpo.sources import web
from garimpo.streaming import waves


@pytest.fixture(scope="module")
def index(spark):
    rows = [(1, "u1", "SSD Kingston NVMe", "Um ssd kingston nvme muito rápido para o seu computador gamer hoje", "kabum.com.br"), (2, "u2", "Placa de Vídeo RTX", "A placa de vídeo rtx com memória e desempenho para jogos pesados", "kabum.com.br"), (3, "u3", "Processador Ryzen", "Processador ryzen com oito núcleos e desempenho para jogos e trabalho", "amazon.com.br"), (4, "u4", "curto", "texto curto", "amazon.com.br"), (5, "u5", None, "o a e de da do para com sem que se em na no por um uma os as mais ou", "x.com")]
    docs = spark.createDataFrame(rows, "doc_id long, url string, title string, text string, domain string").withColumn("is_product", F.lit(True)).withColumn("category", F.lit(None).cast("string"))
    return I.build(docs)


def test_index_with_the_paper_stemmer(spark, index, tmp_path):
    docs = spark.createDataFrame([(1, "u1", None, "Processadores e processador, rapidamente comprados nas lojas de sempre", "x.com")], "doc_id long, url string, title string, text string, domain string").withColumn("is_product", F.lit(True)).withColumn("category", F.lit(None).cast("string"))
    I.save(I.build(docs, stemming=I.PAPER), str(tmp_path / "i"))
    made = I.load(spark, str(tmp_path / "i"))
    assert made.meta.first().stemmer == "rslp" and made.stemming == "rslp"
    tf = {r.term: r.tf for r in made.postings.join(made.vocab.select(F.col("id").alias("term_id"), "term"), "term_id").collect()}
    assert tf["process"] == 2 and tf["rapid"] == 1
    assert I.query_terms(spark, "processadores processador", made) == ["process"]
    assert [h.doc_id for h in I.search(made, "processadores").collect()] == [1]


def test_index_and_search(spark, index, tmp_path):
    m = index.meta.first()
    assert m.total_docs == 3  # one text is short, one has stop words only
    hits = I.search(index, "SSD nvme").collect()
    assert [h.doc_id for h in hits] == [1] and hits[0].rank == 1 and hits[0].score > 0
    assert I.search(index, "desempenho jogos", 1).count() == 1
    assert {h.doc_id for h in I.search(index, "desempenho", domain="amazon").collect()} == {3}
    assert I.search(index, "").count() == I.search(index, "inexistente").count() == 0
    ids = sorted(r.id for r in index.vocab.collect())
    assert ids == list(range(m.total_terms))
    I.save(index, str(tmp_path / "i"))
    again = I.load(spark, str(tmp_path / "i"))
    assert I.is_ready(again) and not I.is_ready(I.load(spark, str(tmp_path / "none")))
    assert sorted(map(tuple, again.postings.select("term_id", "doc_id", "tf").collect())) == sorted(map(tuple, index.postings.select("term_id", "doc_id", "tf").collect()))
    assert [tuple(r) for r in I.search(again, "desempenho jogos").collect()] == [tuple(r) for r in I.search(index, "desempenho jogos").collect()]
    assert {r[0] for r in I.matching(index, all_of="desempenho", none_of="ryzen").collect()} == {2}


def naive_batch(items, n):
    items = sorted(items, key=lambda x: (-x[2], x[0]))
    cap = max(1, n // max(1, len({x[1] for x in items})))
    took, rest, seen = [], [], {}
    for x in items:
        if seen.get(x[1], 0) < cap and len(took) < n:
            took.append(x)
            seen[x[1]] = seen.get(x[1], 0) + 1
        else:
            rest.append(x)
    return (took + rest)[:n]


def test_scheduled_agrees_with_the_sequential_rule(spark):
    random.seed(1)
    for n in (1, 7, 15, 60):
        items = [(i, random.choice("abccc"), random.choice([10, 80, 90, 100])) for i in range(40)]
        got = FR.scheduled(spark.createDataFrame(items, "seq long, domain string, priority int"), n).collect()
        assert sorted(r.seq for r in got) == sorted(x[0] for x in naive_batch(items, n))
    assert FR.scheduled(spark.createDataFrame([], "seq long, domain string, priority int"), 5).count() == 0


def test_permitted_times(spark):
    random.seed(2)
    rows = [(i, random.choice("ab"), round(random.random() * 3, 3)) for i in range(60)]
    got = {r.seq: r.go_at for r in FR.permitted_times(spark.createDataFrame(rows, "seq long, host string, at double"), 0.2).collect()}
    for host in "ab":
        last = None
        for seq, _, at in sorted((r for r in rows if r[1] == host), key=lambda r: (r[2], r[0])):
            last = at if last is None else max(at, last + 0.2)
            assert got[seq] == pytest.approx(last)


def test_admit(spark):
    shops = [Store("s", "S", "x.com", ["/p/"], ["/no"])]
    rows = [(0, "http://x.com/a#f", 0), (1, "http://X.com/a/", 1), (2, "http://x.com/no", 0), (3, "javascript:void(0)", 0), (4, "http://x.com/b", 21), (5, "http://x.com/p/1", 2), (6, "http://y.com/a", 0)]
    seen = FR.items(spark.createDataFrame([(0, "http://x.com/c", 0)], "seq long, url string, depth int"), shops)
    got = FR.admit(spark.createDataFrame(rows, "seq long, url string, depth int"), seen, stores=shops).orderBy("seq").collect()
    assert [(r.seq, r.url, r.priority) for r in got] == [(0, "http://x.com/a", 50), (5, "http://x.com/p/1", 100)]


def test_fetch_never_raises():
    tries = []

    def failing(url):
        tries.append(url)
        raise TimeoutError

    assert web.fetch_one("u", failing, lambda s: None)[-1] == "Timeout" and len(tries) == 3
    assert web.fetch_one("u", lambda u: (200, "application/pdf", b"", None), lambda s: None)[-1].startswith("content type")
    assert web.fetch_one("u", lambda u: (200, "text/html", "é".encode("latin-1"), "latin-1"), lambda s: None)[3] == "é"
    statuses = iter([503, 200])
    assert web.fetch_one("u", lambda u: (next(statuses), "text/html", b"x", None), lambda s: None)[1] == 200


def test_robots(spark):
    df = spark.createDataFrame([("User-agent: *\nDisallow: /a", "/a/b"), ("User-agent: *\nDisallow: /a", "/c"), (None, "/a")], "t string, p string")
    assert [r[0] for r in df.select(web.robots_udf()("t", "p")).collect()] == [False, True, True]


def test_store_and_crawl(spark, sf, tmp_path, monkeypatch):
    store = S.Store(spark, str(tmp_path / "t"))
    assert store.table("pages").count() == 0
    page = spark.createDataFrame([("http://x.com/a", 200, "<p>R$ 90,00</p>"), ("http://x.com/b", 200, "")], "url string, status_code int, html_content string")
    store.save_pages(page)
    store.save_pages(page)
    assert store.table("pages").count() == 2 and {r.id for r in store.table("pages").collect()} == {1, 2}
    store.save_products(spark.createDataFrame([(1, "n" * 600, "x", 9.5), (2, "m", "x", None)], "page_id long, name string, store string, price double"))
    assert store.table("products").count() == 2 and store.table("price_history").count() == 1
    assert max(len(r.name) for r in store.table("products").collect()) == 512
    S.export_html(store.table("pages"), str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/index.jsonl")).collect()]
    assert len(lines) == 1 and lines[0]["file"] == "x.com/000001.html"
    S.write_csv(S.export_products(store.table("products"), store.table("pages")), str(tmp_path / "csv"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert store.clean(["products"]) == ["products"] and store.table("products").count() == 0


def test_crawl_waves(spark, sf):
    got = {r.url: (r.depth, r.price) for r in frontier_queries.o73_crawl_waves(spark, sf).collect()}
    assert got == {"https://www.kabum.com.br/hardware": (0, None), "https://www.kabum.com.br/produto/1/ssd-nvme": (1, 499.9), "https://www.kabum.com.br/produto/2/livro": (1, None)}


def test_product_pipeline(spark, sf):
    got = {r.page_id: (r.name, r.price, r.store) for r in page_queries.o48_product_pipeline(spark, sf).collect()}
    assert got[2] == ("Placa de Video RTX 4070", 3899.0, "amazon") and 4 not in got and 7 not in got
    info = {r.k: r for r in page_queries.o42_product_info(spark, sf).collect()}
    assert (info[0].name, info[0].sku, info[0].brand, info[0].price) == ("SSD Kingston 480GB", "SK1", "Kingston", 299.9)
    assert info[6].price == 1599.9 and info[5].old_price == 5000.0 and info[5].discount == 99


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    schema = "url_hash string, host string"
    for part in ([("a", "h"), ("b", "h"), ("a", "h")], [("a", "h"), ("c", "h")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        waves.to_table(waves.fresh_urls(spark.readStream.schema(schema).parquet(src)), out, at)
    assert sorted(r.url_hash for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_versions_of_an_aggregated_stream(spark, tmp_path):
    """Counts of a window go on over two runs, and its newest row has them all."""
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    schema = "at timestamp, domain string, status string"
    for minute, status in ((1, "done"), (2, "failed")):
        spark.sql(f"SELECT timestamp'2024-01-01 00:0{minute}:00' AS at, 'd' AS domain, '{status}' AS status").write.mode("append").parquet(src)
        waves.to_versions(waves.rates(spark.readStream.schema(schema).parquet(src), "1 hour"), out, at)
    versions = spark.read.parquet(out)
    assert versions.select("batch").distinct().count() > 1
    assert [(r.domain, r.pages, r.failed) for r in waves.newest(versions, "minute", "domain").collect()] == [("d", 2, 1)]


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["version"]) == 0
    assert cli.main(["categories"]) == 0 and "gpu" in capsys.readouterr().out
    assert cli.main(["--data", str(tmp_path), "clean"]) == 1
    assert cli.main(["--data", str(tmp_path), "stats"]) == 0
    assert cli.main(["--data", str(tmp_path), "index", "search", "ssd"]) == 1


def test_crawl_keeps_to_robots_and_delays(spark, tmp_path):
    """A barred page is never asked for; delays and the last request reach the fetcher; HTML files lie where the index says."""
    shop = [Store("s", "S", "x.com", ["/p/"], ["/no"], request_delay=1.5)]
    site = {"http://x.com/": '<title>a</title><a href="p/1">1</a><a href="/secret/2">2</a><a href="?page_number=2">3</a>', "http://x.com/p/1": "<h1>Produto um</h1><p>line\nline", "http://x.com/?page_number=2": "x", "http://x.com/secret/2": "no"}
    pages, asked = spark.createDataFrame(list(site.items()), "url string, html string"), []

    def fetch(urls):
        asked.extend(urls.collect())
        found = urls.join(pages, "url", "left")
        return found.select("url", F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), "html", F.length("html").alias("content_length"), F.lit(1).alias("crawl_time_ms"), F.lit(None).cast("string").alias("error"))

    rules = []

    def robots(hosts):
        rules.extend(hosts.collect())
        return hosts.select("host", F.lit(True).alias("fetched"), F.lit("User-agent: *\nDisallow: /secret/").alias("text"))

    store = S.Store(spark, str(tmp_path / "s"))
    store.add_to_frontier(FR.admit(spark.createDataFrame([(0, "http://x.com/", 0)], "seq long, url string, depth int"), store.table("pages"), stores=shop))
    assert waves.crawl(store, fetch, 10, 5, shop, robots=robots) == 4
    assert sorted(r.url for r in asked) == sorted(r.url for r in store.table("pages").collect())
    assert len(asked) == 3 and len(rules) == 1 and {r.delay for r in asked} == {1.5}
    assert asked[0].last_at is None and all(r.last_at > 0 for r in asked[1:])
    assert store.table("links").count() == 3
    n = S.export_html(store.table("pages"), str(tmp_path / "html"))
    index = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "html" / "index.jsonl")).collect()]
    assert n == len(index) == 3
    for r in index:
        text = (tmp_path / "html" / r["file"]).read_text()
        assert r["file"] == f"x.com/{r['id']:06d}.html" and len(text) == r["content_length"]


def test_json_array(spark, tmp_path):
    for rows in ([], [(1, "a")], [(1, "a"), (2, None), (3, 'q"')]):
        S.write_json(spark.createDataFrame(rows, "k long, x string").repartition(2, "k"), str(tmp_path / f"j{len(rows)}"), array=True)
        text = "".join(p.read_text() for p in sorted((tmp_path / f"j{len(rows)}").glob("part-*")))
        assert sorted((r["k"], r["x"]) for r in json.loads(text)) == rows
