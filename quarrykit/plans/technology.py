"""Queries over technology detection: pages joined to literal evidence, against the findings that this evidence must give.

``CASES`` holds evidence and, stated by hand, the weights of every finding in it; page i carries case i modulo their number. The SQL reads
those expectations alone, so a rule that is missing, wrong or too wide turns a query red.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signals as G
from ..operators import snapshots as S
from ..session import table

QUERIES, ORACLE = {}, {}

_form = lambda head, *fields: f"<form {head}>" + "".join(f"<input {f}>" for f in fields) + "</form>"
_gen = lambda x: f'<meta name="generator" content="{x}">'
_src = lambda *xs: "".join(f'<script src="{x}"></script>' for x in xs)
_MYSQL = {"MySQL": [0.3], "MariaDB": [0.15]}

CASES = [
    {"html": '<img src="/wp-content/a.png"><img src="/wp-includes/b.png"><a href="/wp-json">x</a>' + _gen("WordPress 6.4"), "cookies": ["wp-settings-1=x; Secure; HttpOnly"], "probes": ["/wp-login.php", "/wp-json/", "/xmlrpc.php", "/readme.html"],
     "cms": {"WordPress": [0.85, 0.85, 0.6, 0.95, 0.9, 0.8, 0.75, 0.3, 0.2]}, "database": _MYSQL},
    {"html": '<div class="a woocommerce b"></div>' + _gen("WooCommerce 8"), "cookies": ["woocommerce_items_in_cart=1; Secure"], "cms": {"WooCommerce": [0.8, 0.9, 0.9]}, "database": _MYSQL},
    {"html": '<img src="//cdn.shopify.com/a"><p>Shopify.theme</p><meta name="shopify-digital-wallet">', "cookies": ["_shopify_y=1"], "headers": {"x-shopid": "1"}, "probes": ["/products.json"], "cms": {"Shopify": [0.9, 0.9, 0.85, 0.85, 0.95, 0.8]}},
    {"html": '<p data-mage-init="x"></p><img src="/static/frontend/a.png">' + _gen("Magento 2"), "headers": {"x-magento-tags": "a"}, "cms": {"Magento": [0.85, 0.75, 0.9, 0.9]}, "database": _MYSQL},
    {"html": '<a href="index.php?route=a">x</a><img src="catalog/view/theme/x.png">', "cookies": ["OCSESSID=1"], "cms": {"OpenCart": [0.6, 0.8, 0.9]}, "database": _MYSQL, "language": {"PHP": [0.4]}},
    {"html": _gen("PrestaShop"), "cookies": ["PrestaShop-1=a"], "cms": {"PrestaShop": [0.75, 0.9, 0.9]}, "database": _MYSQL},
    {"html": "<p>Drupal.settings</p><img src='/sites/default/x.png'>" + _gen("Drupal 10"), "cookies": ["SESS0123456789abcdef0123456789abcdef=1"], "headers": {"x-generator": "Drupal 10"}, "probes": ["/user/login"],
     "cms": {"Drupal": [0.95, 0.85, 0.7, 0.7, 0.95, 0.2]}, "database": _MYSQL, "language": {"PHP": [0.5]}},
    {"html": '<img src="/media/jui/a.png">' + _gen("Joomla! 4"), "cookies": ["joomla_user_state=1"], "probes": ["/administrator/"], "cms": {"Joomla": [0.95, 0.8, 0.9, 0.2]}, "database": _MYSQL},
    {"html": "<img src='/ghost/api/x'><p>ghost-sdk</p>" + _gen("Ghost 5.1"), "cms": {"Ghost": [0.95, 0.85, 0.6]}, "database": {"SQLite": [0.25], "MySQL": [0.25]}},
    {"html": "<a href='https://x.blogspot.com'>b</a>" + _gen("blogger"), "cms": {"Blogger": [0.85, 0.95]}},
    {"html": "<img src='//static.wixstatic.com/x'>" + _gen("Wix.com Website"), "headers": {"x-wix-request-id": "1"}, "cms": {"Wix": [0.85, 0.95, 0.95]}},
    {"html": "<img src='//static1.squarespace.com/x'>" + _gen("Squarespace"), "headers": {"x-via": "squarespace"}, "cms": {"Squarespace": [0.85, 0.95, 0.8]}},
    {"html": "<img src='//assets.website-files.com/x'><p data-wf-page='1'></p>" + _gen("Webflow"), "cms": {"Webflow": [0.85, 0.9, 0.95]}},
    {"html": '<p id="__NEXT_DATA__"></p><img src="/_next/static/x"><meta name="next-head-count" content="2"><!--$-->a<!--/$--><p data-reactroot></p>' + _src("/react-dom.production.min.js"), "frontend": {"Next.js": [0.95, 0.9, 0.85], "React": [0.85, 0.8, 0.8]}},
    {"html": '<p data-v-abc123></p><p v-if="x"></p><p id="__nuxt">window.__NUXT__</p><img src="/_nuxt/x">' + _src("/vue.global.min.js"), "frontend": {"Vue": [0.85, 0.75, 0.6], "Nuxt": [0.95, 0.9, 0.85]}},
    {"html": '<app-root ng-version="17" _nghost-abc></app-root>' + _src("/angular.min.js"), "frontend": {"Angular": [0.95, 0.75, 0.85, 0.6]}},
    {"html": '<p class="x svelte-abcd12"></p><img src="/_app/immutable/x"><astro-island data-astro-cid-x></astro-island><img src="/_astro/x">', "frontend": {"Svelte": [0.85, 0.9], "Astro": [0.95, 0.85, 0.8]}},
    {"html": '<p>window.__remixContext</p><div id="___gatsby"></div><img src="/page-data/x">', "frontend": {"Remix": [0.95], "Gatsby": [0.9, 0.85]}},
    {"html": _form('action="/x"', 'name="_token" type="hidden"'), "cookies": ["laravel_session=1"], "headers": {"x-xsrf-token": "1", "server": "nginx/1.25"}, "backend": {"Laravel": [0.9, 0.6, 0.4]}, "language": {"PHP": [0.81]}, "database": {"MySQL": [0.25]}, "server": {"Nginx": [0.95]}},
    {"html": '<p class="sf-toolbar"></p>', "cookies": ["ci_session=1"], "headers": {"x-debug-token": "1", "server": "Apache/2.4"}, "backend": {"Symfony": [0.9, 0.9], "CodeIgniter": [0.85]}, "language": {"PHP": [0.81, 0.765]}, "database": {"MySQL": [0.25]}, "server": {"Apache": [0.95]}},
    {"html": "<p>cakephp</p>", "headers": {"x-powered-by": "PHP/8.2", "server": "LiteSpeed"}, "backend": {"CakePHP": [0.6]}, "language": {"PHP": [0.54, 0.9]}, "database": {"MySQL": [0.25]}, "server": {"LiteSpeed": [0.95]}},
    {"html": "<p>nest</p>", "cookies": ["connect.sid=1"], "headers": {"x-powered-by": "Express", "server": "cowboy", "via": "1.1 vegur"}, "backend": {"Express.js": [0.9, 0.75], "NestJS": [0.35]}, "language": {"JavaScript": [0.81], "TypeScript": [0.315]}, "server": {"Node Server": [0.4]}, "hosting": {"Heroku": [0.85]}},
    {"html": "", "headers": {"server": "uvicorn", "x-process-time": "3"}, "backend": {"FastAPI": [0.75, 0.4]}, "language": {"Python": [0.675, 0.6]}, "server": {"Custom Server": [0.35]}},
    {"html": _form('action="/y"', 'name="csrfmiddlewaretoken" type="hidden"'), "cookies": ["csrftoken=1"], "headers": {"server": "Werkzeug/3"}, "backend": {"Django": [0.85, 0.5], "Flask": [0.7]}, "language": {"Python": [0.765, 0.63, 0.6]}, "database": {"PostgreSQL": [0.3], "SQLite": [0.2]}, "server": {"Custom Server": [0.35]}},
    {"html": "", "cookies": ["session=1"], "headers": {"server": "gunicorn"}, "backend": {"Flask": [0.3]}, "language": {"Python": [0.27, 0.6]}, "server": {"Custom Server": [0.35]}},
    {"html": "", "cookies": ["JSESSIONID=1"], "headers": {"server": "Apache-Coyote/1.1"}, "backend": {"Spring Boot": [0.85, 0.5]}, "language": {"Java": [0.765, 0.6]}, "server": {"Apache": [0.95]}},
    {"html": '<p id="__VIEWSTATE"></p><a href="/x.aspx">x</a>', "cookies": ["ASP.NET_SessionId=1"], "headers": {"x-powered-by": "ASP.NET", "x-aspnet-version": "4", "server": "Microsoft-IIS/10.0"}, "backend": {"ASP.NET": [0.9, 0.9, 0.85, 0.9, 0.5]},
     "language": {"C#": [0.81, 0.5]}, "database": {"SQL Server": [0.4]}, "server": {"IIS": [0.95]}},
    {"html": '<p data-turbo="x"></p>' + _form('action="/z"', 'name="authenticity_token" type="hidden"'), "cookies": ["_rails_session=1"], "headers": {"x-request-id": "1", "server": "Caddy"}, "backend": {"Ruby on Rails": [0.85, 0.6, 0.5]}, "language": {"Ruby": [0.765]},
     "database": {"PostgreSQL": [0.3], "SQLite": [0.2]}, "server": {"Caddy": [0.95]}},
    {"html": "", "headers": {"x-powered-by": "Fiber", "server": "openlitespeed"}, "backend": {"Go": [0.8]}, "language": {"Go": [0.72]}, "server": {"OpenLiteSpeed": [0.95]}},
    {"html": "", "headers": {"server": "cloudflare", "cf-ray": "1", "cf-cache-status": "HIT"}, "nameservers": ["a.ns.cloudflare.com"], "cdn": {"Cloudflare": [0.9, 0.9, 0.85]}, "hosting": {"Cloudflare": [0.6]}, "server": {"Custom Server": [0.2]}},
    {"html": "", "headers": {"server": "CloudFront", "x-amz-cf-id": "1", "x-cache": "Hit from cloudfront"}, "nameservers": ["ns-1.awsdns-01.com"], "cdn": {"CloudFront": [0.9, 0.9, 0.9]}, "hosting": {"AWS": [0.6, 0.8]}, "server": {"Custom Server": [0.2]}},
    {"html": "<img src='https://a.b-cdn.net/x'>", "headers": {"x-fastly-request-id": "1", "x-served-by": "cache-ams1", "server": "BunnyCDN"}, "cdn": {"Fastly": [0.9, 0.6], "BunnyCDN": [0.9, 0.8]}, "server": {"Custom Server": [0.35]}},
    {"html": "<img src='https://a.kxcdn.com/x'>" + _src("https://cdn.jsdelivr.net/x", "https://unpkg.com/y"), "headers": {"server": "AkamaiGHost", "x-akamai-a": "1"}, "cdn": {"Akamai": [0.85], "KeyCDN": [0.85], "JSDelivr": [0.85], "UNPKG": [0.85]}, "server": {"Custom Server": [0.35]}},
    {"html": "", "headers": {"x-vercel-id": "1", "x-nf-request-id": "1", "x-railway-edge": "1", "x-render-origin-server": "1"}, "nameservers": ["ns1.vercel-dns.com", "dns1.netlifydns.com"], "hosting": {"Vercel": [0.9, 0.85], "Netlify": [0.9, 0.85], "Railway": [0.9], "Render": [0.85]}},
    {"html": "", "headers": {"x-goog-hash": "1", "x-azure-ref": "1", "x-amzn-trace": "1"}, "nameservers": ["ns1.azure-dns.com", "ns2.googledomains.com"], "hosting": {"Google Cloud": [0.6, 0.6], "Azure": [0.85, 0.85], "AWS": [0.6]}},
    {"html": "", "nameservers": ["ns1.digitalocean.com", "ns1.dns-parking.com", "ns1.bluehost.com", "ns1.siteground.net"], "hosting": {"DigitalOcean": [0.85], "Hostinger": [0.8], "Bluehost": [0.85], "SiteGround": [0.85]}},
    {"html": "<p>You have an error in your SQL syntax. mariadb. org.postgresql postgres://u@h/d MongooseError mongodb+srv://h</p>", "database": {"MySQL": [0.8], "MariaDB": [0.5], "PostgreSQL": [0.8, 0.9], "MongoDB": [0.8, 0.9]}},
    {"html": "<p>SQLITE_ERROR redis://h ECONNREFUSED 1.1.1.1:6379 ORA-00942 oracle.jdbc System.Data.SqlClient</p>", "database": {"SQLite": [0.6], "Redis": [0.9, 0.7], "Oracle": [0.85, 0.7], "SQL Server": [0.8]}},
    {"html": '<p class="MuiButton-root ant-btn">@mui/material jQuery(x) new Chart(y) new THREE.Scene TweenMax</p><p class="chakra-stack" data-framer-name="x"></p><p class="swiper-slide recharts-surface"></p>' + _src("/jquery-3.7.1.min.js", "/framer-motion.js", "/gsap.min.js", "/three.module.js", "/chart.umd.js", "/swiper-bundle.min.js"),
     "library": {"jQuery": [0.85, 0.5], "Material UI": [0.9, 0.8], "Ant Design": [0.85], "Chakra UI": [0.85], "Framer Motion": [0.6, 0.5], "GSAP": [0.85, 0.7], "Swiper": [0.85, 0.85], "Three.js": [0.85, 0.6], "Chart.js": [0.8, 0.5], "Recharts": [0.85, 0.6]}},
    {"html": '<link rel="stylesheet" href="/bootstrap.min.css"><link rel="stylesheet" href="/tailwindcss.css"><p class="btn-primary sm:flex">x</p><p class="hover:red">y</p>' + _src("/bootstrap.bundle.min.js"), "css": {"Bootstrap": [0.85, 0.8, 0.6], "Tailwind CSS": [0.7, 0.75]}},
    {"html": '<p class="one md:flex">a single token is not enough</p>'},
    {"html": '<!-- This site is optimized with the Yoast SEO plugin --><p class="yoast-seo"></p><!-- optimized with the SEO plugin Rank Math --><p class="rank-math"></p><!-- All in One SEO --><p class="aioseo"></p><meta name="google-site-verification" content="x">'
             '<meta property="og:title" content="x"><meta name="twitter:card" content="x"><link rel="canonical" href="/x"><script type="application/ld+json">{"@type":"Thing"}</script>', "sitemaps": ["/a"], "robots": True,
     "seo": {"Yoast SEO": [0.95, 0.6], "Rank Math": [0.95, 0.6], "AIO SEO": [0.85, 0.6], "Google Search Console": [0.9], "Schema.org": [0.9], "Open Graph": [0.9], "Twitter Cards": [0.9], "Canonical Tags": [0.95], "XML Sitemap": [0.9], "Robots.txt": [0.95]}},
    {"html": "<p>https://www.googletagmanager.com/gtag/js gtag('config', 'G-ABCDEF12') https://www.googletagmanager.com/gtm.js GTM-ABCD12 https://connect.facebook.net/en_US/fbevents.js fbq('init', 1) https://static.hotjar.com/x _hjSettings https://www.clarity.ms/tag</p>", "probes": ["/sitemap.xml"],
     "analytics": {"Google Analytics": [0.9, 0.7, 0.5], "Google Tag Manager": [0.9, 0.7], "Meta Pixel": [0.9, 0.8], "Hotjar": [0.9, 0.7], "Microsoft Clarity": [0.9]}, "seo": {"XML Sitemap": [0.9]}},
    {"html": "<p>cdn.mxpnl.com mixpanel.init(1) cdn.amplitude.com amplitude.getInstance() matomo.js _paq.push(1) snap.licdn.com/li.lms-analytics _linkedin_partner_id</p>", "analytics": {"Mixpanel": [0.9, 0.8], "Amplitude": [0.9, 0.8], "Matomo": [0.9, 0.8], "LinkedIn Insight Tag": [0.9, 0.8]}},
    {"html": "<p>js.stripe.com/v3 Stripe('pk_1') checkout.razorpay.com new Razorpay(1) www.paypal.com/sdk/js paypal.Buttons() js.squareup.com Square.payments() js.authorize.net Accept.dispatchData()</p>",
     "payment": {"Stripe": [0.9, 0.85], "Razorpay": [0.9, 0.85], "PayPal": [0.85, 0.85], "Square": [0.9, 0.85], "Authorize.Net": [0.9, 0.85]}},
    {"html": "<p>secure.payu.in bolt.payu(1) mercury.phonepe.com PhonePeCheckout.transact() sdk.cashfree.com Cashfree({}) secure.ccavenue.com</p>", "payment": {"PayU": [0.85, 0.8], "PhonePe": [0.9, 0.85], "Cashfree": [0.9, 0.8], "CCAvenue": [0.9]}},
    {"html": _form('action="/checkout"', 'name="sum"') + '<p class="x live-chat"></p>', "payment": {"Custom Payment": [0.3]}, "chat": {"Custom Chat": [0.3]}, "forms": {"Checkout Forms": [0.6]}},
    {"html": '<p class="g_id_signin fb-login-button">accounts.google.com/gsi/client FB.login( appleid.cdn-apple.com AppleID.auth.init( login.live.com msal.js jwt_decode(x) response_type=code</p>',
     "auth": {"Google Login": [0.9, 0.7], "Facebook Login": [0.85, 0.8], "Apple Login": [0.9, 0.85], "Microsoft Login": [0.85, 0.8], "JWT Authentication": [0.5], "OAuth": [0.6]}},
    {"html": _form('action="/login"', 'name="email" type="email"', 'type="password" name="p"') + _form('action="/v"', 'name="otp_code"') + "<p>one-time password</p>" + _form('action="/new-account" class="register"', 'name="email"', "type=password", "type=password") + _form('action="/s" method="get"', 'name="q"'),
     "cookies": ["PHPSESSID=1"], "auth": {"OTP Login": [0.75], "Session Authentication": [0.55]}, "forms": {"Login Forms": [0.6], "Registration Forms": [0.6], "Search Forms": [0.6]}},
    {"html": "<p>embed.tawk.to widget.intercom.io Intercom('boot') client.crisp.chat window.$crisp static.zdassets.com wchat.freshchat.com cdn.livechatinc.com js.driftt.com js.hs-scripts.com</p>"
             + _form('action="/booking"', 'name="day"') + _form('id="newsletter"', 'name="email"') + _form('action="/c"', 'name="full_name"', 'name="email"', 'name="message"') + _form('action="/d"', 'name="full_name"', 'name="email"', 'type="tel" name="n"') + _form('action="/e"', 'name="other"'),
     "chat": {"Tawk.to": [0.9], "Intercom": [0.9, 0.7], "Crisp": [0.9, 0.7], "Zendesk": [0.9], "Freshchat": [0.9], "LiveChat": [0.9], "Drift": [0.9], "HubSpot Chat": [0.85]},
     "forms": {"Appointment Forms": [0.6], "Newsletter Forms": [0.6], "Contact Forms": [0.6], "Lead Forms": [0.6]}},
]
# Means of figures with four digits, over whole numbers so that no sum depends on its order.
_mean = lambda c: F.round(F.sum(F.round(c * 10000).cast("long")) / F.count(c)) / 10000
_mean_sql = "round(sum(round(confidence * 10000)::BIGINT) / count(confidence)) / 10000"
_EVIDENCE = "case_id int, more string, headers map<string,string>, cookies array<string>, nameservers array<string>, probes array<string>, sitemaps array<string>, robots boolean, tls boolean"


def sites(s: SparkSession, d: str, shift: int = 0) -> DataFrame:
    """A page each with the evidence of its case (or of one further on)."""
    rows = [(i, c["html"], c.get("headers", {}), c.get("cookies", []), c.get("nameservers", []), c.get("probes", []), c.get("sitemaps", []), c.get("robots", False), i % 3 != 0) for i, c in enumerate(CASES)]
    cases = F.broadcast(s.createDataFrame(rows, _EVIDENCE))  # a literal list
    pages = table(s, d, "pages").select("page_id", "url", "html", ((F.col("page_id") + shift) % len(CASES)).cast("int").alias("case_id"))
    return pages.join(cases, "case_id").withColumn("html", F.concat("html", "more")).drop("more")


def _expected() -> str:
    rows = []
    for i, case in enumerate(CASES):
        found = {c: dict(case.get(c, {})) for c in G.CATEGORIES}
        found["language"]["JavaScript"] = [0.3, *found["language"].get("JavaScript", [])]  # every page has a script
        for category, name, weight in (("cms", "Custom CMS", 0.3), ("frontend", "HTML Static Website", 0.4), ("backend", "Custom Backend", 0.25), ("server", "Custom Server", 0.3), ("hosting", "Custom VPS or Dedicated Server", 0.3)):
            found[category] = found[category] or {name: [weight]}
        rows += [f"({i}, '{c}', '{n}', {w})" for c, names in found.items() for n, ws in names.items() for w in ws]
    return "(VALUES " + ", ".join(rows) + ") e(case_id, category, name, weight)"


_FOUND = f"(SELECT page_id, category, name, round(1 - product(1 - weight::DOUBLE), 4) AS confidence, count(*) AS signals FROM pages JOIN {_expected()} ON page_id % {len(CASES)} = case_id GROUP BY ALL)"
for _key, _category in (
    ("g1_cms", "cms"), ("g2_frontend", "frontend"), ("g3_backend", "backend"), ("g4_languages", "language"), ("g5_server", "server"), ("g6_cdn", "cdn"), ("g7_hosting", "hosting"), ("g8_databases", "database"), ("g9_js_libraries", "library"),
    ("g10_css_frameworks", "css"), ("g11_seo_tools", "seo"), ("g12_analytics", "analytics"), ("g13_payment", "payment"), ("g14_authentication", "auth"), ("g15_live_chat", "chat"), ("g16_form_category", "forms"),
):
    QUERIES[_key] = lambda s, d, c=_category: G.detect(sites(s, d), [c])
    ORACLE[_key] = f"SELECT * FROM {_FOUND} WHERE category = '{_category}'"
QUERIES["a25_noisy_or"] = lambda s, d: G.detect(sites(s, d))
ORACLE["a25_noisy_or"] = f"SELECT * FROM {_FOUND}"
QUERIES["a26_detect_tech"] = lambda s, d: G.detect(sites(s, d)).groupBy("category", "name").agg(F.count(F.lit(1)).alias("sites"), _mean(F.col("confidence")).alias("mean_confidence"))
ORACLE["a26_detect_tech"] = f"SELECT category, name, count(*) AS sites, {_mean_sql} AS mean_confidence FROM {_FOUND} GROUP BY ALL"

QUERIES["a13_technology_changes"] = lambda s, d: S.technology_changes(G.detect(sites(s, d)), G.detect(sites(s, d, 1)))
_names = lambda shift: f"(SELECT DISTINCT page_id, name FROM pages JOIN {_expected()} ON (page_id + {shift}) % {len(CASES)} = case_id)"
_only = lambda x, y, as_: f"(SELECT page_id, string_agg(name, ',' ORDER BY name) AS {as_} FROM (SELECT * FROM {_names(x)} EXCEPT SELECT * FROM {_names(y)}) GROUP BY 1)"
ORACLE["a13_technology_changes"] = f"SELECT page_id, coalesce(added, '') AS added, coalesce(removed, '') AS removed FROM {_only(1, 0, 'added')} FULL OUTER JOIN {_only(0, 1, 'removed')} USING (page_id)"

# Signal extraction over a page with every kind of tag.
_SIGNALS = (
    '<script src="/a.js"></script><script>inline()</script><meta name="Author" content="A"><meta property="og:type" content="t"><link rel="preload" href="/f.woff2" as="font">'
    '<form action="/go" method="POST" id="f1" class="big"><input name="a" placeholder="Your a"><input type="Email" name="b"><select name="c"></select><textarea name="d"></textarea></form>'
)


def _signals(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages").select("page_id", F.concat(F.lit(f'<html lang="en" ng-version="1"><body class="one  two">{_SIGNALS}</body></html>'), F.lit("<p>"), F.col("url"), F.lit("</p>")).alias("html"))
    return G.extract(rows).select("page_id", F.to_json(F.struct("scripts", "meta_tags", "link_tags", "forms", "html_attributes", "body_classes"), {"ignoreNullFields": "true"}).alias("signals"))


QUERIES["g17_signal_extraction"] = _signals
_signals_json = json.dumps({
    "scripts": [{"src": "/a.js"}, {}], "meta_tags": [{"name": "Author", "content": "A"}, {"property": "og:type", "content": "t"}], "link_tags": [{"rel": "preload", "href": "/f.woff2", "as": "font"}],
    "forms": [{"action": "/go", "method": "post", "id": "f1", "class_name": "big", "fields": [{"name": "a", "type": "text", "placeholder": "Your a"}, {"name": "b", "type": "email"}, {"name": "c", "type": "select"}, {"name": "d", "type": "textarea"}]}],
    "html_attributes": ["lang", "ng-version"], "body_classes": ["one", "two"],
}, separators=(",", ":"))
ORACLE["g17_signal_extraction"] = f"SELECT page_id, '{_signals_json}' AS signals FROM pages"


def security_scores(s: SparkSession, d: str) -> DataFrame:
    return G.score(G.security_findings(_headers(s, d)))


def _pick(values: list, k: Column, kind: str = "string") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (k % len(values) + 1).cast("int"))


def _headers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    given = {"strict-transport-security": ["max-age=300", "max-age=0", None], "content-security-policy": ["default-src 'self'", None, "frame-ancestors 'none'", None], "x-frame-options": [None, "DENY", None, None, None], "x-content-type-options": ["NoSniff", "x"], "x-xss-protection": [None, None, "1"],
             "access-control-allow-origin": [None, "*", "*", "https://a.example"], "access-control-allow-credentials": [None, None, "true", "true"]}
    headers = F.map_filter(F.create_map(*[x for name, values in given.items() for x in (F.lit(name), _pick(values, k))]), lambda _, v: v.isNotNull())
    cookies = F.when(k % 3 == 0, F.array(F.lit("a=1; Secure; HttpOnly"))).when(k % 3 == 1, F.array(F.lit("a=1; Secure; HttpOnly"), F.lit("b=2; Secure"))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "pages").select("page_id", "url", headers.alias("headers"), cookies.alias("cookies"), (k % 5 != 0).alias("tls"))


_security = """(SELECT page_id, unnest([{'check': 'HTTPS', 'passed': h, 'points': 25}, CASE WHEN h THEN {'check': 'SSL Certificate', 'passed': page_id % 5 <> 0, 'points': 25} END, {'check': 'HSTS', 'passed': page_id % 3 = 0, 'points': 15},
  {'check': 'Content-Security-Policy', 'passed': page_id % 2 = 0, 'points': 15}, {'check': 'Clickjacking Protection', 'passed': page_id % 5 = 1 OR page_id % 4 = 2, 'points': 10}, {'check': 'X-Content-Type-Options', 'passed': page_id % 2 = 0, 'points': 10},
  {'check': 'XSS Protection', 'passed': page_id % 3 = 2, 'points': 5}, CASE WHEN page_id % 4 <> 0 THEN {'check': 'CORS', 'passed': page_id % 4 <> 2, 'points': 10} END, CASE WHEN page_id % 3 <> 2 THEN {'check': 'Cookie Policy', 'passed': page_id % 3 = 0, 'points': 10} END]) AS f
  FROM (SELECT page_id, url LIKE 'https://%' AS h FROM pages))"""
_score = "CASE WHEN sum(points) > 0 THEN floor(100 * sum(CASE WHEN passed THEN points ELSE 0 END) / sum(points) + 0.5) ELSE 100 END::INT AS score"
QUERIES["a28_security_findings"] = lambda s, d: G.security_findings(_headers(s, d))
ORACLE["a28_security_findings"] = f"SELECT page_id, f.check AS \"check\", f.passed AS passed, f.points AS points FROM {_security} WHERE f IS NOT NULL"
QUERIES["a28_security_score"] = security_scores
_security_score = f"(SELECT page_id, {_score} FROM (SELECT page_id, f.passed AS passed, f.points AS points FROM {_security} WHERE f IS NOT NULL) GROUP BY 1)"
ORACLE["a28_security_score"] = f"SELECT * FROM {_security_score}"

#: Evidence of performance and, by hand, what each check says: lazy, sized, modern, compressed, cached, hinted, fonts, minified (None: does not apply).
_SPEED = [
    ("", {}, (None, None, None, False, False, False, None, None)),
    ('<img src="/a.png" loading="lazy" width="5" height="6"><img src="/b.webp" width=1 height=2><link rel="preconnect" href="//x"><script src="/a.min.js"></script><script src="/b.js"></script>', {"content-encoding": "br", "etag": "1"}, (True, True, True, True, True, True, None, True)),
    ('<img src="/a.png" width="5"><style>@font-face{font-display: swap}</style><link rel="stylesheet" href="/a.css?v=1"><script src="/a.js"></script>', {"content-encoding": "identity", "expires": "x"}, (False, False, False, False, True, False, True, False)),
    ('<picture><img src="/a.png" width="5" height="5" srcset="x 2x"></picture><link rel="stylesheet" href="https://fonts.googleapis.com/css"><link rel="icon" href="/i.png">', {"content-encoding": "gzip"}, (False, True, True, True, False, False, False, None)),
]
_CHECKS = [("Lazy Loading", 12), ("Image Dimensions", 12), ("Image Optimization", 12), ("Compression", 20), ("Caching", 20), ("Resource Hints", 6), ("Font Loading Strategy", 6), ("Asset Minification", 12)]


def _speed(s: SparkSession, d: str) -> DataFrame:
    cases = F.broadcast(s.createDataFrame([(i, html, headers) for i, (html, headers, _) in enumerate(_SPEED)], "case_id int, more string, headers map<string,string>"))
    rows = table(s, d, "pages").select("page_id", "html", (F.col("page_id") % len(_SPEED)).cast("int").alias("case_id")).join(cases, "case_id")
    return rows.select("page_id", F.concat("html", "more").alias("html"), "headers")


_speed_rows = ", ".join(f"({i}, '{name}', {str(passed).lower()}, {points})" for i, (_, _, said) in enumerate(_SPEED) for (name, points), passed in zip(_CHECKS, said, strict=True) if passed is not None)
_speed_sql = f"(SELECT page_id, \"check\", passed, points FROM pages JOIN (VALUES {_speed_rows}) v(case_id, \"check\", passed, points) ON page_id % {len(_SPEED)} = case_id)"
QUERIES["a29_performance_findings"] = lambda s, d: G.performance_findings(_speed(s, d))
ORACLE["a29_performance_findings"] = f"SELECT * FROM {_speed_sql}"
QUERIES["a29_performance_score"] = lambda s, d: G.score(G.performance_findings(_speed(s, d)))
ORACLE["a29_performance_score"] = f"SELECT page_id, {_score} FROM {_speed_sql} GROUP BY 1"

# Connectors by shop or content platform.
CONNECTORS = {
    "WordPress": "WordPress REST API Connector", "WooCommerce": "WooCommerce Order/Product Connector", "Shopify": "Shopify Admin API Connector", "Magento": "Magento REST API Connector", "OpenCart": "OpenCart REST API Connector",
    "PrestaShop": "PrestaShop Webservice API Connector", "Drupal": "Generic CMS Webhook Connector", "Joomla": "Generic CMS Webhook Connector", "Ghost": "Ghost Content/Admin API Connector",
}
GENERIC = "Generic JavaScript Embed Connector"


def tech_report(found: DataFrame, security: DataFrame, performance: DataFrame) -> DataFrame:
    """Per page: confidence (mean of each category's top one), stack, recommendations (codes) and connectors."""
    best = found.groupBy("page_id", "category").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "name")).alias("b"))
    top = best.groupBy("page_id").agg(_mean(-F.col("b.c")).alias("confidence"), F.array_join(F.array_sort(F.collect_list(F.concat("category", F.lit("="), "b.name"))), ",").alias("stack"), F.map_from_entries(F.collect_list(F.struct("category", "b"))).alias("top"))
    connector = F.create_map(*[F.lit(x) for kv in CONNECTORS.items() for x in kv])
    sure = F.when(F.col("category") == "cms", F.when(F.col("confidence") >= G.CONFIDENT, F.try_element_at(connector, F.col("name"))))
    has = lambda name: F.coalesce(F.bool_or((F.col("category") == "cms") & (F.col("name") == name) & (F.col("confidence") >= 0.7)), F.lit(False))
    said = found.groupBy("page_id").agg(F.collect_set(sure).alias("cms_connectors"), has("WordPress").alias("wordpress"), has("Shopify").alias("shopify"), F.bool_or(F.col("category") == "payment").alias("pays"))
    cookies = security.where("check = 'Cookie Policy' AND NOT passed").select("page_id", F.lit(True).alias("bare_cookies"))
    rows = top.join(said, "page_id").join(G.score(security).withColumnRenamed("score", "security"), "page_id").join(G.score(performance).withColumnRenamed("score", "performance"), "page_id").join(cookies, "page_id", "left")
    of = lambda c: -F.col("top")[c]["c"]
    chat = F.try_element_at("top", F.lit("chat"))["name"]
    backend = F.when((of("backend") >= G.CONFIDENT) & (F.col("top")["backend"]["name"] != "Custom Backend"), F.concat(F.lit("Custom API Connector (backend: "), F.col("top")["backend"]["name"], F.lit(")")))
    advice = F.array_compact(F.array(
        F.when(F.col("security") < 50, "security_weak").when(F.col("security") < 80, "security_gaps"), F.when(F.col("performance") < 50, "performance_poor"), F.when((of("cms") < G.CONFIDENT) & (of("frontend") < G.CONFIDENT), "custom_site"),
        F.when(F.col("wordpress"), "wordpress"), F.when(F.col("shopify"), "shopify"), F.when(F.col("pays"), "payment_present"), F.when(chat.isNotNull() & (chat != "Custom Chat"), "chat_present").otherwise("no_chat"), F.when(F.col("bare_cookies"), "cookie_flags"),
    ))
    connectors = F.array_join(F.concat(F.array_sort("cms_connectors"), F.array_compact(F.array(backend)), F.array(F.lit(GENERIC))), "; ")
    return rows.select("page_id", "confidence", "stack", F.array_join(advice, ",").alias("recommendations"), connectors.alias("connectors"))


QUERIES["a27_tech_report"] = lambda s, d: tech_report(G.detect(sites(s, d)), G.security_findings(_headers(s, d)), G.performance_findings(_speed(s, d)))
_speed_score = f"(SELECT page_id, {_score} FROM {_speed_sql} GROUP BY 1)"
_con = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in CONNECTORS.items()) + "}"
ORACLE["a27_tech_report"] = f"""
WITH f AS {_FOUND}, t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id, category ORDER BY confidence DESC, name) = 1),
g AS (SELECT page_id, {_mean_sql} AS confidence, string_agg(category || '=' || name, ',' ORDER BY category || '=' || name) AS stack,
  max(CASE WHEN category = 'chat' THEN name END) AS chat, max(CASE WHEN category = 'backend' AND confidence >= 0.4 AND name <> 'Custom Backend' THEN name END) AS backend,
  max(CASE WHEN category = 'cms' THEN confidence END) AS cms, max(CASE WHEN category = 'frontend' THEN confidence END) AS frontend FROM t GROUP BY 1),
h AS (SELECT page_id, string_agg(DISTINCT CASE WHEN category = 'cms' AND confidence >= 0.4 THEN {_con}[name] END, '; ' ORDER BY CASE WHEN category = 'cms' AND confidence >= 0.4 THEN {_con}[name] END) AS cc,
  bool_or(category = 'payment') AS pays, bool_or(category = 'cms' AND name = 'WordPress' AND confidence >= 0.7) AS wp, bool_or(category = 'cms' AND name = 'Shopify' AND confidence >= 0.7) AS shop FROM f GROUP BY 1)
SELECT page_id, g.confidence, stack,
  concat_ws(',', CASE WHEN s.score < 50 THEN 'security_weak' WHEN s.score < 80 THEN 'security_gaps' END, CASE WHEN p.score < 50 THEN 'performance_poor' END, CASE WHEN cms < 0.4 AND frontend < 0.4 THEN 'custom_site' END, CASE WHEN wp THEN 'wordpress' END,
    CASE WHEN shop THEN 'shopify' END, CASE WHEN pays THEN 'payment_present' END, CASE WHEN chat <> 'Custom Chat' THEN 'chat_present' ELSE 'no_chat' END, CASE WHEN page_id % 3 = 1 THEN 'cookie_flags' END) AS recommendations,
  concat_ws('; ', cc, CASE WHEN backend IS NOT NULL THEN 'Custom API Connector (backend: ' || backend || ')' END, '{GENERIC}') AS connectors
FROM g JOIN h USING (page_id) JOIN {_security_score} s USING (page_id) JOIN {_speed_score} p USING (page_id)"""


def recommend_connector(scores: DataFrame, definitions: DataFrame) -> DataFrame:
    """page_id, connector, confidence, auth: definition of the top CMS of 0.4 or more, else of the top backend, else universal at 0.3; sure OAuth or JWT evidence sets the authentication.

    ``definitions`` is the list of connectors that exist, some dozens of rows; it reaches all tasks."""
    best = lambda c: scores.where((F.col("category") == c) & (F.col("confidence") >= G.CONFIDENT)).groupBy("page_id").agg(F.max_by(F.struct("name", "confidence"), F.struct("confidence", "name")).alias(c))
    rows = scores.select("page_id").distinct().join(best("cms"), "page_id", "left").join(best("backend"), "page_id", "left").join(best("auth"), "page_id", "left")
    for c in ("cms", "backend"):
        rows = rows.join(F.broadcast(definitions.select(F.col("name").alias(f"{c}_name"), F.col("connector").alias(f"{c}_connector"), F.col("auth").alias(f"{c}_auth"))), F.col(f"{c}.name") == F.col(f"{c}_name"), "left")
    refined = F.when(F.lower("auth.name").contains("oauth"), "OAUTH2").when(F.lower("auth.name").contains("jwt"), "JWT")
    confidence = F.when(F.col("cms_connector").isNotNull(), F.col("cms.confidence")).when(F.col("backend_connector").isNotNull(), F.col("backend.confidence")).otherwise(0.3)
    return rows.select("page_id", F.coalesce("cms_connector", "backend_connector", F.lit("universal")).alias("connector"), confidence.alias("confidence"), F.coalesce(refined, "cms_auth", "backend_auth", F.lit("BEARER_TOKEN")).alias("auth"))


_DEFINITIONS = [("WordPress", "wordpress", "BASIC_AUTH"), ("Shopify", "shopify", "API_KEY"), ("Laravel", "laravel", "BEARER_TOKEN"), ("Django", "django", "BEARER_TOKEN")]
QUERIES["j15_recommend_connector"] = lambda s, d: recommend_connector(G.detect(sites(s, d), ["cms", "backend", "auth"]), s.createDataFrame(_DEFINITIONS, "name string, connector string, auth string"))
_conn, _auth = ("map {" + ", ".join(f"'{x[0]}': '{x[i]}'" for x in _DEFINITIONS) + "}" for i in (1, 2))
_best = lambda c: f"(SELECT * FROM {_FOUND} WHERE category = '{c}' AND confidence >= 0.4 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, name DESC) = 1)"
ORACLE["j15_recommend_connector"] = f"""SELECT page_id, coalesce({_conn}[a.name], {_conn}[b.name], 'universal') AS connector, CASE WHEN {_conn}[a.name] IS NOT NULL THEN a.confidence WHEN {_conn}[b.name] IS NOT NULL THEN b.confidence ELSE 0.3 END AS confidence,
  CASE WHEN contains(c.name, 'OAuth') THEN 'OAUTH2' WHEN contains(c.name, 'JWT') THEN 'JWT' ELSE coalesce({_auth}[a.name], {_auth}[b.name], 'BEARER_TOKEN') END AS auth
FROM (SELECT page_id FROM pages) LEFT JOIN {_best('cms')} a USING (page_id) LEFT JOIN {_best('backend')} b USING (page_id) LEFT JOIN {_best('auth')} c USING (page_id)"""

# The quick look at a page's platform (first that fits) and frameworks (all that fit): name, field, pattern.
QUICK_CMS = [
    ("WordPress", "html", r"(?i)/wp-content/|/wp-includes/|wp-json"), ("WordPress", "generator", r"(?i)wordpress"), ("WooCommerce", "html", r"(?i)woocommerce"), ("Shopify", "html", r"(?i)cdn\.shopify\.com|Shopify\.theme"), ("Magento", "html", r"(?i)Mage\.Cookies|/static/version\d+/frontend/"),
    ("Drupal", "html", r"(?i)Drupal\.settings|/sites/default/files/"), ("Drupal", "generator", r"(?i)drupal"), ("Joomla", "html", r"(?i)/media/jui/|Joomla!"), ("Wix", "html", r"(?i)static\.wixstatic\.com|wix-code"), ("Squarespace", "html", r"(?i)static1\.squarespace\.com"),
]
QUICK_FRAMEWORKS = [
    ("Next.js", "html", r"(?i)__NEXT_DATA__|_next/static"), ("React", "html", r"(?i)data-reactroot|react-dom"), ("Vue", "html", r"(?i)__NUXT__|data-v-[a-f0-9]{8}|vue\.(runtime\.)?(min\.)?js"), ("Angular", "html", r"(?i)<[^>]+\sng-version[\s=>]|<app-root[\s>]"),
    ("Laravel", "cookies", r"laravel_session"), ("Django", "cookies", r"csrftoken"), ("ASP.NET", "html", r"(?i)__VIEWSTATE"), ("ASP.NET", "aspnet", r".|ASP\.NET"), ("FastAPI", "timed", r"."),
]


def quick_stack(sites: DataFrame) -> DataFrame:
    """page_id, cms, frameworks, server, ecommerce, confidence (high from two signals, medium at one)."""
    header = lambda k: F.try_element_at("headers", F.lit(k))
    asp = F.coalesce(header("x-aspnet-version"), F.when(header("x-powered-by").contains("ASP.NET"), header("x-powered-by")), F.lit(""))
    fields = {"html": F.coalesce("html", F.lit("")), "generator": F.regexp_extract("html", r"""(?is)<meta[^>]*name=["']generator["'][^>]*content=["']([^"']*)""", 1), "cookies": F.coalesce(F.array_join("cookies", " "), F.lit("")), "aspnet": asp, "timed": F.coalesce(header("x-process-time"), F.lit(""))}
    rows = sites.select("page_id", "headers", *[v.alias(f"f_{k}") for k, v in fields.items()])
    hit = lambda field, pattern: F.col(f"f_{field}").rlike(pattern)
    cms = F.coalesce(*[F.when(hit(f, p), F.lit(n)) for n, f, p in QUICK_CMS])
    root = hit("html", r"""(?i)<[^>]+\sid=["']?(root|app)["'\s>]""") & hit("html", "(?i)react")
    found = [F.when(hit(f, p) | root if n == "React" else hit(f, p), F.lit(n)) for n, f, p in QUICK_FRAMEWORKS]
    rows = rows.select("page_id", cms.alias("cms"), F.array_distinct(F.array_compact(F.array(*found))).alias("frameworks"), F.coalesce(header("server"), header("x-powered-by")).alias("server"))
    n = F.col("cms").isNotNull().cast("int") + F.size("frameworks")
    return rows.select("page_id", "cms", F.array_join("frameworks", ",").alias("frameworks"), "server", F.when(F.col("cms").isin("WooCommerce", "Shopify", "Magento"), F.col("cms")).alias("ecommerce"), F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low").alias("confidence"))


QUERIES["h23_quick_stack"] = lambda s, d: quick_stack(sites(s, d))
#: By hand: case, platform, frameworks (cases not named have neither).
_QUICK = {0: ("WordPress", ""), 1: ("WooCommerce", ""), 2: ("Shopify", ""), 6: ("Drupal", ""), 7: ("Joomla", ""), 10: ("Wix", ""), 11: ("Squarespace", ""), 13: (None, "Next.js,React"), 14: (None, "Vue"), 15: (None, "Angular"), 18: (None, "Laravel"), 22: (None, "FastAPI"), 23: (None, "Django"), 26: (None, "ASP.NET")}
_quick_rows = []
for _i, _case in enumerate(CASES):
    _cms, _frameworks = _QUICK.get(_i, (None, ""))
    _server = _case.get("headers", {}).get("server") or _case.get("headers", {}).get("x-powered-by")
    _n = (_cms is not None) + len([x for x in _frameworks.split(",") if x])
    _shop = _cms if _cms in ("WooCommerce", "Shopify", "Magento") else None
    _quick_rows.append("(" + ", ".join([str(_i), *("NULL" if x is None else f"'{x}'" for x in (_cms, _frameworks, _server, _shop, "high" if _n >= 2 else "medium" if _n else "low"))]) + ")")
ORACLE["h23_quick_stack"] = f"SELECT page_id, cms, frameworks, server, ecommerce, confidence FROM pages JOIN (VALUES {', '.join(_quick_rows)}) q(case_id, cms, frameworks, server, ecommerce, confidence) ON page_id % {len(CASES)} = case_id"
