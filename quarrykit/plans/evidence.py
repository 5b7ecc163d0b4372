"""Queries over what pages say of contacts, products, services and crawls, against findings stated by hand for literal markup."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..session import table
from ..sources import pages as P

QUERIES, ORACLE = {}, {}

_ld = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
_NONE = {"phones": [], "emails": [], "addresses": [], "business_hours": [], "maps_links": [], "whatsapp_links": [], "social_links": []}


def _product(**given) -> dict:
    fields = ("name", "category", "price", "currency", "discount", "description", "images", "sku", "brand", "stock_status", "rating", "review_count", "source")
    return {k: v for k in fields if (v := given.get(k, [] if k == "images" else None)) is not None}


#: Markup, contacts, products and services that a page of it alone gives.
CASES = [
    ("<p>Nothing to find here.</p>", {}, [], []),
    ('<a href="tel:+1 (415) 555-0100">call</a><a href="mailto:Sales@Shop.example?subject=x">mail</a><p>Or write to HELP@shop.example, 020 7946 0958. Room 12.</p>',
     {"phones": ["+1 (415) 555-0100", "020 7946 0958"], "emails": ["Sales@Shop.example", "help@shop.example"]}, [], []),
    ('<a href="https://www.google.com/maps/place/x">m</a><a href="https://wa.me/1555">w</a><a href="https://www.facebook.com/a">f</a><a href="https://youtu.be/b">y</a><a href="https://t.me/c">t</a><a href="https://linkedin.com/d">l</a>',
     {"maps_links": ["https://www.google.com/maps/place/x"], "whatsapp_links": ["https://wa.me/1555"], "social_links": [{"platform": "Facebook", "url": "https://www.facebook.com/a"}, {"platform": "YouTube", "url": "https://youtu.be/b"}, {"platform": "Telegram", "url": "https://t.me/c"}, {"platform": "LinkedIn", "url": "https://linkedin.com/d"}]}, [], []),
    (_ld({"@type": "LocalBusiness", "telephone": "+49 30 1234567", "email": "Info@Laden.example", "address": {"streetAddress": "Weg 1", "addressLocality": "Berlin", "postalCode": "10115", "addressCountry": "DE"}, "openingHours": ["Mo-Fr 09:00-17:00", {"dayOfWeek": ["Sa", "Su"], "opens": "10", "closes": "12"}]}),
     {"phones": ["+49 30 1234567"], "emails": ["Info@Laden.example"], "addresses": ["Weg 1, Berlin, 10115, DE"], "business_hours": ["Mo-Fr 09:00-17:00", "Sa, Su: 10-12"]}, [], []),
    (_ld({"@graph": [{"@type": "Organization", "address": "One Street", "openingHoursSpecification": {"dayOfWeek": "Monday", "opens": "9", "closes": "5"}}, {"@type": "Event", "telephone": "5550100"}]}), {"addresses": ["One Street"], "business_hours": ["Monday: 9-5"]}, [], []),
    (_ld({"@type": "Product", "name": "Lamp", "sku": "L1", "brand": {"name": "Lux"}, "image": ["/l.png", 3], "category": "Light", "description": "Bright", "offers": [{"price": 9.5, "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}, {"price": 1}], "aggregateRating": {"ratingValue": "4.5", "reviewCount": 12}}),
     {}, [_product(name="Lamp", category="Light", price="9.5", currency="EUR", description="Bright", images=["/l.png"], sku="L1", brand="Lux", stock_status="InStock", rating=4.5, review_count=12, source="structured_data")], []),
    (_ld([{"@type": ["Thing", "Product"], "name": "Desk", "mpn": "D2", "brand": "Wood", "offers": {"lowPrice": "100", "priceCurrency": "USD"}}, {"@type": "Product"}]), {}, [_product(name="Desk", price="100", currency="USD", sku="D2", brand="Wood", source="structured_data")], []),
    ('<div class="product_main"><h1>Chair</h1><p class="price_color">£51.77</p><p class="instock availability">In stock</p><span class="sku">C3</span><span class="brand">Sit</span><span class="discount">-10%</span><img src="/c.jpg"><img src="/logo.png"></div><div id="product_description">About</div><p>A good chair.</p>',
     {}, [_product(name="Chair", price="£51.77", discount="-10%", description="A good chair.", images=["/c.jpg"], sku="C3", brand="Sit", stock_status="In stock", source="heuristic")], []),
    ("<h1>Vase</h1><p>Now only $ 12.00 for you.</p>", {}, [_product(name="Vase", price="$ 12.00", source="heuristic")], []),
    ("<h1>About</h1><p>No price at all.</p>", {}, [], []),
    (_ld({"@type": "Service", "name": "Repair", "description": "We mend", "offers": {"price": 40}, "areaServed": ["Paris", "Lyon"]}) + '<div class="services"><h3>Ignored</h3></div>', {}, [], [{"name": "Repair", "description": "We mend", "pricing": "40", "industries": ["Paris", "Lyon"], "source": "structured_data"}]),
    ('<div id="our-services"><h3>Design</h3><p>We draw.</p><h4>Build</h4><p>We make.</p><h3>Design</h3></div><h3>Elsewhere</h3>', {}, [], [{"name": "Design", "description": "We draw.", "source": "heuristic"}, {"name": "Build", "description": "We make.", "source": "heuristic"}]),
    ("<section><h2>Our Services</h2><div><h3>Care</h3></div></section>", {}, [], [{"name": "Care", "source": "heuristic"}]),
]


def _cases(s: SparkSession, d: str) -> DataFrame:
    """A page each of a case's markup, over all pages."""
    cases = F.broadcast(s.createDataFrame([(i, f"<html><body>{c[0]}</body></html>") for i, c in enumerate(CASES)], "case_id int, html string"))  # a literal list
    rows = table(s, d, "pages").select("page_id", "url", (F.col("page_id") % len(CASES)).cast("int").alias("case_id")).join(cases, "case_id")
    return P.parsed_pages(rows).select("page_id", "page")


def _stated(place: int) -> str:
    rows = []
    for i, c in enumerate(CASES):
        value = _NONE | c[1] if place == 1 else c[place]
        rows.append(f"({i}, '" + json.dumps(value, separators=(",", ":"), ensure_ascii=False).replace("'", "''") + "')")
    return f"SELECT page_id, value FROM pages JOIN (VALUES {', '.join(rows)}) v(case_id, value) ON page_id % {len(CASES)} = case_id"


for _name, _field, _place in (("h14_contact_info", "contacts", 1), ("h20_product_details", "products", 2), ("h21_detect_services", "services", 3)):
    QUERIES[_name] = lambda s, d, f=_field: _cases(s, d).select("page_id", F.to_json(f"page.{f}").alias("value"))
    ORACLE[_name] = _stated(_place)

_FOOT = '<footer><a href="/a">Imprint</a> <a href="/b">Privacy</a><a href="/c">Imprint</a></footer>'
QUERIES["h7_page_footer_links"] = lambda s, d: P.parsed_pages(table(s, d, "pages").select("page_id", F.concat("html", F.lit(_FOOT)).alias("html"))).select("page_id", F.array_join("page.footer_links", "|").alias("value"))
ORACLE["h7_page_footer_links"] = "SELECT page_id, 'Imprint|Privacy' AS value FROM pages"


def crawl_report(outcomes: DataFrame, run: dict) -> DataFrame:
    """One row over a crawl's pages: counts, languages, search gaps, load times with the five slowest, warnings, observations.

    outcomes: url, page_type, language, load_ms, has_title, has_description, has_h1, images, images_missing_alt, forms. ``run``: discovered,
    failed, skipped, robots_found, unchanged, document_errors, duplicates (kind to number), server and cms.
    """
    slowest = outcomes.where("load_ms IS NOT NULL").orderBy(F.desc("load_ms"), "url").limit(5).select("url", "load_ms")
    slow = slowest.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("load_ms")).alias("o"), "url"))), lambda x: F.concat(x["url"], F.lit("="), -x["o"])), " ").alias("slowest"))
    languages = outcomes.where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("language", F.lit("="), "n"))), ",").alias("languages"))
    missing = lambda c: F.count_if(~F.col(c))
    total = outcomes.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("page_type") == "blog").alias("blogs"), F.sum("images").alias("images"), F.sum("forms").alias("forms"), missing("has_title").alias("missing_title"), missing("has_description").alias("missing_description"),
        missing("has_h1").alias("missing_h1"), F.sum("images_missing_alt").alias("images_missing_alt"), F.floor(F.avg("load_ms") + 0.5).alias("mean_load_ms"), F.count_if(F.col("forms") > 0).alias("with_forms"),
    )
    copies = run.get("duplicates", {})
    counts = ", ".join(f"{n} {k}" for k, n in copies.items() if n)
    warnings = [w for w, on in (
        ("no robots.txt: all pages were treated as allowed", not run.get("robots_found")), (f"{run.get('unchanged', 0)} pages unchanged", run.get("unchanged")), (f"{run.get('skipped', 0)} links skipped", run.get("skipped")),
        (f"{sum(copies.values())} duplicates left out ({counts})", sum(copies.values())), (f"{run.get('document_errors', 0)} documents failed", run.get("document_errors")),
    ) if on]
    notes = F.array_compact(F.array(F.lit(None if run.get("server") else "server not disclosed"), F.lit(f"platform: {run['cms']}" if run.get("cms") else None), F.when(F.col("with_forms") > 0, F.concat("with_forms", F.lit(" pages with forms")))))
    one = total.crossJoin(languages).crossJoin(slow)  # one row each
    return one.select(F.lit(run["discovered"]).alias("discovered"), F.lit(run["failed"]).alias("failed"), *[c for c in total.columns if c != "with_forms"], "languages", "slowest", F.lit("; ".join(warnings)).alias("warnings"), F.array_join(notes, "; ").alias("observations"))


_RUN = {"discovered": 5000, "failed": 3, "skipped": 2, "robots_found": False, "unchanged": 7, "document_errors": 1, "duplicates": {"products": 2, "faqs": 0}, "server": None, "cms": "WordPress"}


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    html, k = F.col("html"), F.col("page_id")
    return table(s, d, "pages").select(
        "url", R.page_type(F.col("url"), F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)).alias("page_type"), F.nullif(F.regexp_extract(html, '<html lang="([a-z]+)"', 1), F.lit("")).alias("language"), F.when(k % 10 != 9, k * 37 % 1999).alias("load_ms"),
        html.contains("<title>").alias("has_title"), html.contains('<meta name="description"').alias("has_description"), html.contains("<h1>").alias("has_h1"), F.regexp_count(html, F.lit("<img ")).cast("long").alias("images"), F.lit(0).cast("long").alias("images_missing_alt"), F.when(k % 6 == 1, 1).otherwise(0).cast("long").alias("forms"),
    )


QUERIES["a7_crawl_totals"] = lambda s, d: crawl_report(_outcomes(s, d), _RUN)
ORACLE["a7_crawl_totals"] = """
WITH o AS (SELECT url, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS language, CASE WHEN page_id % 10 <> 9 THEN page_id * 37 % 1999 END AS load_ms, contains(html, '<title>') AS t, contains(html, '<meta name="description"') AS m,
  contains(html, '<h1>') AS h, len(regexp_extract_all(html, '<img ')) AS images, CASE WHEN page_id % 6 = 1 THEN 1 ELSE 0 END AS forms, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)
SELECT 5000 AS discovered, 3 AS failed, count(*) AS scanned, 0 AS blogs, sum(images)::BIGINT AS images, sum(forms)::BIGINT AS forms, count_if(NOT t)::BIGINT AS missing_title, count_if(NOT m)::BIGINT AS missing_description, count_if(NOT h)::BIGINT AS missing_h1, 0 AS images_missing_alt,
  floor(avg(load_ms) + 0.5)::BIGINT AS mean_load_ms, (SELECT string_agg(language || '=' || n, ',' ORDER BY language || '=' || n) FROM (SELECT language, count(*) AS n FROM o WHERE language IS NOT NULL GROUP BY 1)) AS languages,
  (SELECT string_agg(url || '=' || load_ms, ' ' ORDER BY load_ms DESC, url) FROM (SELECT * FROM o WHERE load_ms IS NOT NULL ORDER BY load_ms DESC, url LIMIT 5)) AS slowest,
  'no robots.txt: all pages were treated as allowed; 7 pages unchanged; 2 links skipped; 2 duplicates left out (2 products); 1 documents failed' AS warnings, 'server not disclosed; platform: WordPress; ' || count_if(forms > 0) || ' pages with forms' AS observations FROM o"""
