"""Schemas of the engine's tables."""

from __future__ import annotations

_DDL = {
    "pages": "id long not null, url string not null, url_hash string not null, domain string not null, status_code int, content_type string, content_length int, title string, html_content string, text_content string, depth int, crawled_at timestamp_ntz, crawl_time_ms int, is_product_page boolean, category string",
    "products": "id long not null, page_id long not null, name string not null, sku string, brand string, price double, price_raw string, currency string, category string, store string not null, first_seen timestamp_ntz, last_updated timestamp_ntz",
    "price_history": "id long not null, product_id long not null, price double not null, recorded_at timestamp_ntz",
    "links": "id long not null, source_page_id long not null, target_url string not null, target_url_hash string not null, anchor_text string, discovered_at timestamp_ntz",
    "frontier": "id long not null, url string not null, url_hash string not null, domain string not null, priority int, depth int, status string, retries int, added_at timestamp_ntz, processed_at timestamp_ntz",
    "crawl_stats": "id long not null, timestamp timestamp_ntz, pages_crawled int, pages_failed int, products_found int, links_discovered int, domain string, domain_pages int, avg_response_time_ms double, pages_per_minute double",
    "meta": "total_docs long, total_terms long, total_postings long, avg_dl double, use_stopwords boolean, stemmer string",
    "vocab": "term string not null, id long not null, df long not null, raw string",
    "docs": "doc_id long not null, url string, title string, domain string, dl long, is_product boolean, category string",
    "postings": "shard int not null, term_id long not null, doc_id long not null, tf long not null",
}


def schema(table: str) -> str:
    """DDL of a table, for ``spark.read.schema``."""
    return _DDL[table]


TABLES = list(_DDL)
