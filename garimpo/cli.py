"""Command line: crawl, stats, export, export-html, seeds, categories, clean, inspect, browse, analyze-products, index, version."""

from __future__ import annotations

import argparse
import signal
import sys

from garimpo import session

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="garimpo")
    p.add_argument("--data", default="data", help="folder of the tables")
    p.add_argument("--index-dir", default=None, help="folder of the index; <data>/index if not given")
    s = p.add_subparsers(dest="command", required=True)
    c = s.add_parser("crawl")
    c.add_argument("--max-pages", type=int, default=60_000)
    c.add_argument("--concurrent", type=int, default=25)
    c.add_argument("--delay", type=float, default=None, help="seconds between two requests to a host; each shop's own if not given")
    c.add_argument("--no-robots", action="store_true", help="don't ask for robots.txt")
    c.add_argument("--store", default=None)
    c.add_argument("--no-resume", action="store_true", help="add the seeds even if there is a frontier")
    s.add_parser("stats")
    e = s.add_parser("export")
    e.add_argument("--output", required=True)
    e.add_argument("--format", choices=["csv", "json", "jsonl"], default="csv")
    h = s.add_parser("export-html")
    h.add_argument("--output", required=True)
    h.add_argument("--limit", type=int, default=None)
    d = s.add_parser("seeds")
    d.add_argument("--store", default=None)
    s.add_parser("categories")
    r = s.add_parser("clean")
    r.add_argument("tables", nargs="*")
    r.add_argument("--yes", action="store_true")
    i = s.add_parser("inspect")
    i.add_argument("--limit", type=int, default=10)
    b = s.add_parser("browse")
    b.add_argument("what", choices=["products", "pages"])
    for name in ("--search", "--domain"):
        b.add_argument(name, default=None)
    for name in ("--min-price", "--max-price"):
        b.add_argument(name, type=float, default=None)
    b.add_argument("--page", type=int, default=1)
    b.add_argument("--size", type=int, default=20)
    s.add_parser("analyze-products")
    x = s.add_parser("index").add_subparsers(dest="action", required=True)
    xb = x.add_parser("build")
    xb.add_argument("--no-stem", action="store_true")
    xb.add_argument("--stemmer", choices=["suffix", "rslp"], default="suffix")
    xb.add_argument("--no-stopwords", action="store_true")
    x.add_parser("stats")
    xs = x.add_parser("search")
    xs.add_argument("query")
    xs.add_argument("--top-k", type=int, default=10)
    xs.add_argument("--domain", default=None)
    s.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    from pyspark.sql import functions as F

    from garimpo.functions import stores, wordlists
    from garimpo.operators import frontier, index, report
    from garimpo.sources import store as S
    from garimpo.sources import web
    from garimpo.streaming import waves

    spark = session.build()
    if a.command == "seeds":
        stores.seeds(spark, a.store).show(500, False)
        return 0
    if a.command == "categories":
        for name, words in wordlists.CATEGORIES.items():
            print(f"{name}: {', '.join(words[:5])}")
        return 0
    tables, at = S.Store(spark, a.data), a.index_dir or f"{a.data}/index"
    pages, products = tables.table("pages"), tables.table("products")
    if a.command == "crawl":
        if a.no_resume or not tables.table("frontier").limit(1).count():
            seeds = stores.seeds(spark, a.store).withColumn("seq", F.monotonically_increasing_id())
            tables.add_to_frontier(frontier.admit(seeds.select("seq", "url", "depth"), tables.table("frontier")))
        stopped = []
        signal.signal(signal.SIGINT, lambda *_: stopped.append(True))  # the wave under way is finished
        print(waves.crawl(tables, lambda urls: web.fetch(urls if a.delay is None else urls.drop("delay"), delay=a.delay or 0), a.max_pages, a.concurrent, progress=print, robots=None if a.no_robots else web.robots, stop=lambda: bool(stopped)))
    elif a.command == "stats":
        report.totals(pages, products).show()
        report.counts(pages, "domain").show()
        frontier.status_counts(tables.table("frontier")).show()
    elif a.command == "export":
        write = S.write_csv if a.format == "csv" else lambda df, path: S.write_json(df, path, array=a.format == "json")
        write(S.export_pages(pages), f"{a.output}/pages")
        write(S.export_products(products, pages), f"{a.output}/products")
    elif a.command == "export-html":
        print(S.export_html(pages, a.output, a.limit))
    elif a.command == "clean":
        if not a.yes:
            print("nothing removed: --yes confirms", file=sys.stderr)
            return 1
        print(*tables.clean(a.tables or None))
    elif a.command == "inspect":
        for df in (report.totals(pages, products), report.domain_shares(pages), report.top_categories(products), report.price_buckets(products), report.dearest(products, pages, a.limit), report.sample_urls(pages)):
            df.show(a.limit, False)
    elif a.command == "browse":
        found = report.browse_products(products, pages, a.search, a.domain, a.min_price, a.max_price) if a.what == "products" else report.browse_pages(pages, a.search, a.domain)
        report.page_of(found, a.page, a.size).show(a.size, 50)
    elif a.command == "analyze-products":
        report.class_counts(products).show()
        report.non_hardware_samples(products).show(15, False)
        report.products_by_domain(products, pages).show()
    elif a.action == "build":
        corpus = pages.select(F.col("id").alias("doc_id"), "url", "title", F.col("text_content").alias("text"), "domain", F.col("is_product_page").alias("is_product"), "category")
        index.save(index.build(corpus, not a.no_stopwords, False if a.no_stem else a.stemmer == "suffix" or a.stemmer), at)
        index.load(spark, at).meta.show()
    else:
        found = index.load(spark, at)
        if not index.is_ready(found):
            print("no index", file=sys.stderr)
            return 1
        if a.action == "stats":
            found.meta.show()
            index.df_statistics(found).show()
            index.top_terms(found).show(50)
        else:
            index.search(found, a.query, a.top_k, a.domain).show(a.top_k, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
