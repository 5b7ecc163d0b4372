"""Page parsing: one pass of the standard library's HTML parser per page, in Arrow batches, into one struct per page."""

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import attach

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags that end an open paragraph.
BLOCKS = {"p", "div", "ul", "ol", "li", "table", "tr", "td", "th", "section", "article", "header", "footer", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
#: Tags that end an open one of a kind, and where that search stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
NOISE = re.compile(r"(?i)(^|[\s_-])(ad|ads|advert\w*|cookie\w*|consent|popup|modal)($|[\s_-])")
CTA = re.compile(r"(?i)\b(buy|order|shop|sign up|subscribe|get started|contact|book|download|learn more|try)\b")
SCHEMA = (
    "title string, meta_title string, meta_description string, canonical_url string, headings array<struct<level:int,text:string>>, "
    "paragraphs array<string>, lists array<struct<ordered:boolean,items:array<string>>>, tables array<struct<headers:array<string>,rows:array<array<string>>>>, "
    "buttons array<string>, cta_buttons array<string>, breadcrumbs array<string>, navigation array<string>, footer_links array<string>, "
    "images array<struct<src:string,alt:string,caption:string>>, videos array<struct<src:string,type:string>>, "
    "forms array<struct<action:string,method:string,fields:array<struct<name:string,type:string>>>>, json_ld array<string>, "
    "open_graph map<string,string>, twitter_card map<string,string>, scripts array<string>, links array<struct<rel:string,href:string>>, hrefs array<string>, "
    "faqs array<struct<question:string,answer:string>>, "
    "products array<struct<name:string,category:string,price:string,currency:string,discount:string,description:string,images:array<string>,sku:string,brand:string,stock_status:string,rating:double,review_count:int,source:string>>, "
    "services array<struct<name:string,description:string,pricing:string,industries:array<string>,source:string>>, "
    "contacts struct<phones:array<string>,emails:array<string>,addresses:array<string>,business_hours:array<string>,maps_links:array<string>,whatsapp_links:array<string>,social_links:array<struct<platform:string,url:string>>>"
)
# Patterns and markers of contacts, products and services.
PHONE = re.compile(r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}(?:[\s.-]?\d{2,4})?")
EMAIL = re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
PRICE = re.compile(r"(?:USD|EUR|GBP|INR|₹|\$|€|£)\s?[\d,]+(?:\.\d{1,2})?")
MAPS, WHATSAPP = re.compile(r"(?i)google\.[a-z.]+/maps|maps\.app\.goo\.gl|goo\.gl/maps"), re.compile(r"(?i)wa\.me/|api\.whatsapp\.com")
PLATFORMS = [
    ("Facebook", r"facebook\.com|fb\.com"), ("Twitter/X", r"twitter\.com|x\.com"), ("Instagram", r"instagram\.com"), ("LinkedIn", r"linkedin\.com"),
    ("YouTube", r"youtube\.com|youtu\.be"), ("TikTok", r"tiktok\.com"), ("Pinterest", r"pinterest\.com"), ("Telegram", r"t\.me|telegram\.org"),
]
BUSINESSES = {"localbusiness", "organization", "store", "restaurant"}
PRODUCT_CLASSES = {"product", "product-single", "product_main", "woocommerce-product"}
UNWANTED_IMAGE = re.compile(r"(?i)icon|logo|sprite|avatar")


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                stack.extend(reversed(x.children))
        return squeeze("".join(parts))

    def inside(self, *tags: str) -> bool:
        up = self.parent
        while up:
            if up.tag in tags:
                return True
            up = up.parent
        return False

    def find(self, *tags: str) -> list:
        return [n for n in self.walk() if n.tag in tags and n is not self]


class Tree(HTMLParser):
    """Document tree without scripts, styles, hidden and advertising nodes (kept apart where needed)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.raw: list[tuple[dict, str]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            up = self.at
            while up and up.tag not in ("p", "article", "div", "section", "body", "td", "li", ""):
                up = up.parent
            if up and up.tag == "p":
                self.at = up.parent
        ends, stops = IMPLIED.get(tag, ((), ()))
        up = self.at if ends else None
        while up and up.tag not in ends and up.tag not in stops:
            up = up.parent
        if up and up.tag in ends:
            self.at = up.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up and up.tag != tag:
            up = up.parent
        if up and up.parent:
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        if self.at.tag in ("script", "style"):
            self.raw.append((self.at.attrs, data) if self.at.tag == "script" else ({}, ""))
        else:
            self.at.children.append(data)


def noisy(node: Node) -> bool:
    a = node.attrs
    style = a.get("style", "").replace(" ", "").lower()
    return node.tag in ("script", "style", "noscript", "template") or "hidden" in a or "display:none" in style or "visibility:hidden" in style or bool(NOISE.search(f"{a.get('class', '')} {a.get('id', '')}"))


def prune(node: Node) -> None:
    node.children = [c for c in node.children if isinstance(c, str) or not noisy(c)]
    for c in node.children:
        if isinstance(c, Node):
            prune(c)


def flattened(value) -> list[dict]:
    """JSON-LD entries through arrays and @graph."""
    if isinstance(value, list):
        return [e for v in value for e in flattened(v)]
    if isinstance(value, dict):
        return flattened(value["@graph"]) if "@graph" in value else [value]
    return []


def kinds(entry: dict) -> set[str]:
    named = entry.get("@type")
    return {str(k).lower() for k in (named if isinstance(named, list) else [named])}


def scalar(value) -> str | None:
    """A JSON string or number as text."""
    return value if isinstance(value, str) else str(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def number(value) -> float | None:
    try:
        return float(value) or None
    except (TypeError, ValueError):
        return None


def first_offer(entry: dict) -> dict:
    offers = entry.get("offers")
    offer = offers[0] if isinstance(offers, list) and offers else offers
    return offer if isinstance(offer, dict) else {}


def given(*values):
    return next((v for v in values if v is not None), None)


def stated_product(entry: dict) -> dict:
    offer, brand, rated, image = first_offer(entry), entry.get("brand"), entry.get("aggregateRating"), entry.get("image")
    rated = rated if isinstance(rated, dict) else {}
    stock = scalar(offer.get("availability"))
    reviews = number(rated.get("reviewCount"))
    return {
        "name": scalar(entry.get("name")), "category": scalar(entry.get("category")), "price": scalar(given(offer.get("price"), offer.get("lowPrice"))), "currency": scalar(offer.get("priceCurrency")), "discount": None,
        "description": scalar(entry.get("description")), "images": [i for i in (image if isinstance(image, list) else [image]) if isinstance(i, str)], "sku": scalar(given(entry.get("sku"), entry.get("mpn"))),
        "brand": brand if isinstance(brand, str) else scalar(brand.get("name")) if isinstance(brand, dict) else None, "stock_status": stock.replace("https://schema.org/", "", 1) if stock else None,
        "rating": number(rated.get("ratingValue")), "review_count": int(reviews) if reviews else None, "source": "structured_data",
    }


class Marked:
    """Searches by class tokens, itemprop and tag in one subtree."""

    def __init__(self, node: "Node"):
        self.nodes = [n for n in node.walk() if n is not node]

    def all(self, classes: set[str] = frozenset(), prop: str | None = None, tags: tuple = ()) -> list:
        return [n for n in self.nodes if n.tag in tags or classes & set(n.attrs.get("class", "").split()) or prop and n.attrs.get("itemprop") == prop]

    def text(self, **wanted) -> str | None:
        found = self.all(**wanted)
        return (found[0].text() or None) if found else None


def guessed_product(nodes: list, root: "Node") -> dict | None:
    """One product from a known container, or from the whole body where a first heading and a price stand."""

    def container(n) -> bool:
        a, classes = n.attrs, n.attrs.get("class", "")
        return bool(PRODUCT_CLASSES & set(classes.split())) or "product-detail" in classes or "product_detail" in classes or "schema.org/Product" in a.get("itemtype", "") or "data-product-id" in a

    body = next((n for n in nodes if n.tag == "body"), root)
    heading = next((x for n in nodes if n.tag == "h1" and (x := n.text())), None)
    box = next((n for n in nodes if container(n)), None)
    if box is None:
        if not any(n.tag == "h1" for n in nodes) or not PRICE.search(body.text()):
            return None
        box = body
    inside = Marked(box)
    if not (name := inside.text(classes={"product_title", "product-title"}, prop="name", tags=("h1",)) or heading):
        return None
    priced = inside.text(classes={"price", "product-price", "price_color", "amount"}, prop="price") or ""
    price = PRICE.search(priced) or PRICE.search(box.text())
    described = inside.text(classes={"product-description", "woocommerce-product-details__short-description"}, prop="description")
    if not described and (mark := next((n for n in nodes if n.attrs.get("id") == "product_description"), None)):
        after = [c for c in mark.parent.children if isinstance(c, Node)]
        follower = after[after.index(mark) + 1 : after.index(mark) + 2]
        described = follower[0].text() if follower and follower[0].tag == "p" else None
    images = [src for n in inside.all(tags=("img",)) if (src := n.attrs.get("src") or n.attrs.get("data-src")) and not UNWANTED_IMAGE.search(src)]
    struck = [d for n in inside.all(classes={"price"}) for d in n.find("del")]
    discount = inside.text(classes={"discount", "sale-badge"}) or (struck[0].text() if struck else None)
    return {
        "name": name, "category": None, "price": price.group() if price else None, "currency": None, "discount": discount or None, "description": described or None, "images": images[:8], "sku": inside.text(classes={"sku"}, prop="sku"),
        "brand": inside.text(classes={"brand"}, prop="brand"), "stock_status": inside.text(classes={"stock", "availability", "instock"}, prop="availability"), "rating": None, "review_count": None, "source": "heuristic",
    }


def services_of(nodes: list, entries: list[dict]) -> list[dict]:
    """Services stated as data, else third and fourth headings in sections about services (30 at most)."""
    stated = [
        {"name": e["name"], "description": e["description"] if isinstance(e.get("description"), str) else None, "pricing": scalar(first_offer(e).get("price")) or None, "industries": [str(x) for x in e["areaServed"]] if isinstance(e.get("areaServed"), list) else None, "source": "structured_data"}
        for e in entries if "service" in kinds(e) and isinstance(e.get("name"), str) and e["name"]
    ]
    if stated:
        return stated
    section = lambda n: "service" in n.attrs.get("class", "") or "service" in n.attrs.get("id", "") or n.tag == "section" and any("Service" in (t := h.text()) or "service" in t for h in n.find("h2"))
    sections = {id(n) for n in nodes if section(n)}
    found: dict[str, dict] = {}
    for n in nodes:
        if n.tag not in ("h3", "h4") or not (name := n.text()) or len(name) > 100 or name in found:
            continue
        up = n.parent
        while up and id(up) not in sections:
            up = up.parent
        if up:
            beside = [c for c in n.parent.children if isinstance(c, Node)]
            below = [c for c in beside[beside.index(n) + 1 :] if c.tag == "p"] or n.parent.find("p")
            found[name] = {"name": name, "description": (below[0].text() or None) if below else None, "pricing": None, "industries": None, "source": "heuristic"}
    return list(found.values())[:30]


def contacts_of(nodes: list, root: "Node", entries: list[dict]) -> dict:
    """Phones, e-mails, addresses, hours and links of a page, in order of appearance and without repeats."""
    digits = lambda x: len(re.sub(r"\D", "", x))
    body = next((n for n in nodes if n.tag == "body"), root).text()
    hrefs = [n.attrs["href"] for n in nodes if n.tag == "a" and n.attrs.get("href")]
    phones = [x for h in hrefs if h.startswith("tel:") and digits(x := h.replace("tel:", "", 1).strip()) >= 7]
    emails = [x for h in hrefs if h.startswith("mailto:") and (x := h.replace("mailto:", "", 1).split("?")[0].strip())]
    phones += [x for m in PHONE.findall(body) if 7 <= digits(x := m.strip()) <= 15]
    emails += [x.lower() for x in EMAIL.findall(body)]
    addresses, hours = [], []
    for e in entries:
        if not BUSINESSES & kinds(e):
            continue
        phones += [e["telephone"]] if isinstance(e.get("telephone"), str) else []
        emails += [e["email"]] if isinstance(e.get("email"), str) else []
        place = e.get("address")
        if isinstance(place, dict):
            parts = [place.get(k) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
            place = ", ".join(x for x in parts if isinstance(x, str) and x.strip())
        addresses += [place] if isinstance(place, str) and place else []
        opens = given(e.get("openingHours"), e.get("openingHoursSpecification"))
        for h in opens if isinstance(opens, list) else [opens]:
            if isinstance(h, dict) and (days := h.get("dayOfWeek")) and h.get("opens") and h.get("closes"):
                hours.append(f"{', '.join(days) if isinstance(days, list) else days}: {h['opens']}-{h['closes']}")
            elif isinstance(h, str):
                hours.append(h)
    social: dict[str, str] = {}
    for h in hrefs:
        for platform, pattern in PLATFORMS:
            if h not in social and re.search(pattern, h, re.I):
                social[h] = platform
    first = lambda xs, n: list(dict.fromkeys(xs))[:n]
    return {
        "phones": first(phones, 20), "emails": first(emails, 20), "addresses": first(addresses, 10), "business_hours": first(hours, 20), "maps_links": first((h for h in hrefs if MAPS.search(h)), 10),
        "whatsapp_links": first((h for h in hrefs if WHATSAPP.search(h)), 10), "social_links": [{"platform": p, "url": u} for u, p in social.items()],
    }


def parse_page(html: str | None) -> dict:
    tree = Tree(html or "")
    nodes = list(tree.root.walk())
    meta = {(n.attrs.get("property") or n.attrs.get("name") or "").lower(): n.attrs.get("content", "").strip() for n in nodes if n.tag == "meta"}
    links = [{"rel": n.attrs.get("rel", ""), "href": n.attrs.get("href", "")} for n in nodes if n.tag == "link"]
    scripts = [n.attrs["src"] for n in nodes if n.tag == "script" and n.attrs.get("src")]
    entries = []
    for attrs, data in tree.raw:
        if "ld+json" in attrs.get("type", ""):
            try:
                entries += flattened(json.loads(data))
            except ValueError:
                continue
    products = [p for e in entries if "product" in kinds(e) and (p := stated_product(e))["name"]] or [p for p in [guessed_product(nodes, tree.root)] if p]
    services, contacts = services_of(nodes, entries), contacts_of(nodes, tree.root, entries)
    prune(tree.root)
    nodes = list(tree.root.walk())
    of = lambda *tags: [n for n in nodes if n.tag in tags]
    distinct = lambda xs: list(dict.fromkeys(x for x in xs if x))
    title = next((n.text() for n in of("title")), "") or None
    tables = []
    for t in of("table"):
        trs = t.find("tr")
        body = [[td.text() for td in tr.find("td")] for tr in trs]
        tables.append({"headers": [th.text() for tr in trs[:1] for th in tr.find("th")], "rows": [r for r in body if r]})
    clicks = [n.text() or n.attrs.get("value", "") for n in nodes if n.tag == "button" or n.tag == "input" and n.attrs.get("type") in ("submit", "button") or n.tag == "a" and re.search("btn|button", n.attrs.get("class", ""))]
    crumbs = next((n for n in nodes if "breadcrumb" in (n.attrs.get("class", "") + n.attrs.get("aria-label", "") + n.attrs.get("itemtype", "")).lower()), None)
    images = []
    for n in of("img"):
        if src := n.attrs.get("src") or n.attrs.get("data-src"):
            up = n
            while up and up.tag != "figure":
                up = up.parent
            captions = [c.text() for c in up.find("figcaption")] if up else []
            images.append({"src": src, "alt": n.attrs.get("alt", "").strip() or None, "caption": (captions or [None])[0]})
    videos = [n.attrs["src"] for n in nodes if n.attrs.get("src") and (n.tag in ("iframe", "video") or n.tag == "source" and n.inside("video"))]
    kind = lambda s: "youtube" if re.search(r"youtube\.com|youtu\.be", s) else "vimeo" if "vimeo.com" in s else "other"
    faqs = [{"question": d.find("summary")[0].text(), "answer": squeeze(d.text()[len(d.find("summary")[0].text()):])} for d in of("details") if d.find("summary")]
    for e in entries:
        if str(e.get("@type")).lower() == "faqpage":
            faqs = [{"question": q.get("name"), "answer": (q.get("acceptedAnswer") or {}).get("text")} for q in e.get("mainEntity", []) if isinstance(q, dict)]
    return {
        "title": title, "meta_title": meta.get("og:title") or title, "meta_description": meta.get("description") or meta.get("og:description") or None,
        "canonical_url": next((x["href"].strip() for x in links if x["rel"] == "canonical"), None),
        "headings": [{"level": int(n.tag[1]), "text": n.text()} for n in of("h1", "h2", "h3", "h4", "h5", "h6") if n.text()],
        "paragraphs": [x for n in of("p") if len(x := n.text()) > 1],
        "lists": [{"ordered": n.tag == "ol", "items": items} for n in of("ul", "ol") if not n.inside("nav", "footer", "header") and (items := [x for c in n.children if isinstance(c, Node) and c.tag == "li" and (x := c.text())])],
        "tables": [t for t in tables if t["headers"] or t["rows"]],
        "buttons": distinct(clicks), "cta_buttons": distinct(x for x in clicks + [n.text() for n in of("a")] if CTA.search(x)),
        "breadcrumbs": [x for n in (crumbs.find("a", "span") if crumbs else []) if (x := n.text())],
        "navigation": distinct(n.text() for n in of("a") if n.inside("nav", "header")), "footer_links": distinct(n.text() for n in of("a") if n.inside("footer")),
        "images": images, "videos": [{"src": s, "type": kind(s)} for s in videos],
        "forms": [{"action": n.attrs.get("action") or None, "method": (n.attrs.get("method") or "GET").upper(), "fields": [{"name": f.attrs.get("name") or None, "type": f.attrs.get("type") or f.tag} for f in n.find("input", "select", "textarea")]} for n in of("form")],
        "json_ld": [json.dumps(e, ensure_ascii=False, sort_keys=True) for e in entries],
        "open_graph": {k: v for k, v in meta.items() if k.startswith("og:")}, "twitter_card": {k: v for k, v in meta.items() if k.startswith("twitter:")},
        "scripts": scripts, "links": links, "hrefs": [n.attrs["href"] for n in of("a") if n.attrs.get("href")], "faqs": faqs, "products": products, "services": services, "contacts": contacts,
    }


def parsed_pages(pages: DataFrame) -> DataFrame:
    """``pages``' columns and ``page``, the parsed struct."""
    attach(pages.sparkSession)

    return pages.withColumn("page", F.pandas_udf(_parse, _STRUCT)(F.col("html")))


_STRUCT = "struct<" + re.sub(r"(^|, )(\w+) (string|array|map|struct)", r"\1\2:\3", SCHEMA) + ">"
_FIELDS = re.findall(r"(?:^|, )(\w+) (?:string|array|map|struct)", SCHEMA)


def _parse(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(x) for x in html], columns=_FIELDS)


def clean_text(page: Column) -> Column:
    """Title, h1-h4, paragraphs, lists and table rows; trimmed, distinct, blank-line joined."""
    heads = F.transform(F.filter(page["headings"], lambda h: h["level"] <= 4), lambda h: h["text"])
    lists = F.transform(page["lists"], lambda x: F.array_join(x["items"], "; "))
    rows = F.transform(F.flatten(F.transform(page["tables"], lambda t: t["rows"])), lambda r: F.array_join(r, " | "))
    parts = F.concat(F.array(F.coalesce(page["title"], F.lit(""))), heads, page["paragraphs"], lists, rows)
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")), "\n\n")


def resolved(base: str | None, href: str) -> str | None:
    """The absolute link without fragment and trailing slash."""
    try:
        u = urlsplit(urljoin(base, href))
    except ValueError:
        return None
    path = u.path[:-1] if len(u.path) > 1 and u.path.endswith("/") else u.path
    return urlunsplit((u.scheme, u.netloc, path or "/", u.query, ""))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url: distinct resolved links of each page of (page_id, url, html). One worker a task parses a page at a time and gives out its links alone."""
    attach(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_links, "page_id long, url string").distinct()


#: How links start that lead to no other page, and links given out at a time.
INNER, LINKS = re.compile("#|mailto:|tel:|javascript:"), 4096


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, urls = [], []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string())], ["page_id", "url"])

    for batch in batches:
        for page, base, html in zip(*batch.columns, strict=True):
            hrefs = dict.fromkeys(h for h in parse_page(html.as_py())["hrefs"] if not INNER.match(h))
            found = dict.fromkeys(u for h in hrefs if (u := resolved(base.as_py(), h)) is not None)
            ids += [page.as_py()] * len(found)
            urls += found
            if len(ids) >= LINKS:
                yield made()
                ids, urls = [], []
    yield made()


def delimited_text(raw: str) -> str:
    """Cells joined with ' | ', rows with newlines; ragged rows are fine, empty lines go."""
    return "\n".join(" | ".join(c.strip() for c in row) for row in csv.reader(io.StringIO(raw)) if any(c.strip() for c in row))


def json_leaves(raw: str) -> tuple[str, str | None]:
    """Leaf values depth first to depth 20, newline joined, and an error."""

    def walk(x, depth: int) -> Iterator[str]:
        if depth > 20:
            return
        if isinstance(x, dict | list):
            for v in x.values() if isinstance(x, dict) else x:
                yield from walk(v, depth + 1)
        elif x is not None and str(x).strip():
            yield str(x).lower() if isinstance(x, bool) else str(x)

    try:
        return "\n".join(walk(json.loads(raw), 0)), None
    except ValueError as error:
        return "", type(error).__name__


def xml_leaves(raw: str) -> tuple[str, str | None]:
    """Leaf texts of XML; where it does not parse, the text without tags and a warning."""
    try:
        return "\n".join(t for n in ET.fromstring(raw).iter() if not len(n) and (t := (n.text or "").strip())), None
    except ET.ParseError:
        return squeeze(re.sub(r"<[^>]+>", " ", raw)), "not well-formed"
