"""Technology detection over one row of evidence a site.

A site has html, url, headers (map of lower-case names), cookies (raw ``Set-Cookie`` values), nameservers, probes (well-known
paths that were found), sitemaps, robots (whether it was read) and tls (whether the certificate is valid). ``signals`` reads scripts,
meta and link tags and forms off the html. Every rule of all categories is tested in one pass over a row; literal patterns are searched as
substrings of the lower-cased field, others as regular expressions. Which substrings a page holds is found once for all rules, and a regular
expression meets only pages with a substring that all it can match have. Nulls count as absent evidence.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import once
from ..session import attach

# Category, name, weight, then field and pattern, all of which must match.
RULES = [
    ("cms", "WordPress", 0.85, "html", r"(?i)/wp-content/"), ("cms", "WordPress", 0.85, "html", r"(?i)/wp-includes/"), ("cms", "WordPress", 0.6, "html", r"(?i)\bwp-json\b"),
    ("cms", "WordPress", 0.95, "generator", r"(?i)wordpress"), ("cms", "WordPress", 0.9, "cookies", r"(?i)wp-settings-|wordpress_logged_in_"), ("cms", "WordPress", 0.8, "probe", "/wp-login.php"),
    ("cms", "WordPress", 0.75, "probe", "/wp-json/"), ("cms", "WordPress", 0.3, "probe", "/xmlrpc.php"), ("cms", "WordPress", 0.2, "probe", "/readme.html"),
    ("cms", "WooCommerce", 0.8, "html", r"""(?i)/plugins/woocommerce/|class="[^"]*\bwoocommerce\b|id="[^"]*\bwoocommerce\b|\bwc-ajax\b|\bwc_add_to_cart_params\b"""),
    ("cms", "WooCommerce", 0.9, "cookies", r"(?i)woocommerce_cart_hash|woocommerce_items_in_cart"), ("cms", "WooCommerce", 0.9, "generator", r"(?i)woocommerce"),
    ("cms", "Shopify", 0.9, "html", r"(?i)cdn\.shopify\.com"), ("cms", "Shopify", 0.9, "html", r"(?i)Shopify\.theme|Shopify\.shop"), ("cms", "Shopify", 0.85, "html", r"(?i)shopify-digital-wallet"),
    ("cms", "Shopify", 0.85, "cookies", r"(?i)_shopify_s|_shopify_y|cart_currency"), ("cms", "Shopify", 0.95, "headers", r"(?i)x-shopid|x-shopify-stage|x-sorting-hat"), ("cms", "Shopify", 0.8, "probe", "/products.json"),
    ("cms", "Magento", 0.85, "html", r"(?i)Mage\.Cookies|data-mage-init"), ("cms", "Magento", 0.75, "html", r"(?i)/skin/frontend/|/static/frontend/"), ("cms", "Magento", 0.9, "generator", r"(?i)magento"), ("cms", "Magento", 0.9, "headers", r"(?i)x-magento"),
    ("cms", "OpenCart", 0.6, "html", r"(?i)index\.php\?route="), ("cms", "OpenCart", 0.8, "html", r"(?i)catalog/view/theme/|catalog/view/javascript/"), ("cms", "OpenCart", 0.9, "cookies", r"(?i)\bOCSESSID\b"),
    ("cms", "PrestaShop", 0.75, "html", r"(?i)prestashop"), ("cms", "PrestaShop", 0.9, "generator", r"(?i)prestashop"), ("cms", "PrestaShop", 0.9, "cookies", r"(?i)PrestaShop-"),
    ("cms", "Drupal", 0.95, "generator", r"(?i)drupal"), ("cms", "Drupal", 0.85, "html", r"(?i)Drupal\.settings|drupal\.js"), ("cms", "Drupal", 0.7, "html", r"(?i)/sites/default/|/sites/all/"),
    ("cms", "Drupal", 0.7, "cookies", r"(?im)^SESS[a-f0-9]{32}=|\bSESS[a-f0-9]{10,}\b"), ("cms", "Drupal", 0.95, "headers", r"(?i)x-generator:\s*drupal"), ("cms", "Drupal", 0.2, "probe", "/user/login"),
    ("cms", "Joomla", 0.95, "generator", r"(?i)joomla"), ("cms", "Joomla", 0.8, "html", r"(?i)/media/jui/|Joomla\."), ("cms", "Joomla", 0.9, "cookies", r"(?i)joomla_user_state"), ("cms", "Joomla", 0.2, "probe", "/administrator/"),
    ("cms", "Ghost", 0.95, "generator", r"(?i)ghost"), ("cms", "Ghost", 0.85, "html", r"(?i)/ghost/api/"), ("cms", "Ghost", 0.6, "html", r"(?i)casper.*theme|ghost-sdk"),
    ("cms", "Blogger", 0.85, "html", r"(?i)\.blogspot\.com|blogger\.com"), ("cms", "Blogger", 0.95, "generator", r"(?i)blogger"),
    ("cms", "Wix", 0.85, "html", r"(?i)wixstatic\.com|static\.parastorage\.com"), ("cms", "Wix", 0.95, "generator", r"(?i)wix\.com"), ("cms", "Wix", 0.95, "headers", r"(?i)x-wix-request-id"),
    ("cms", "Squarespace", 0.85, "html", r"(?i)static\d*\.squarespace\.com"), ("cms", "Squarespace", 0.95, "generator", r"(?i)squarespace"), ("cms", "Squarespace", 0.8, "headers", r"(?i)squarespace"),
    ("cms", "Webflow", 0.85, "html", r"(?i)assets\.website-files\.com"), ("cms", "Webflow", 0.9, "html", r"(?i)data-wf-site|data-wf-page"), ("cms", "Webflow", 0.95, "generator", r"(?i)webflow"),
    ("frontend", "Next.js", 0.95, "html", r"(?i)__NEXT_DATA__"), ("frontend", "Next.js", 0.9, "html", r"(?i)/_next/static/"), ("frontend", "Next.js", 0.85, "html", r'(?i)name="next-head-count"'),
    ("frontend", "React", 0.85, "html", r"(?i)data-reactroot|data-reactid"), ("frontend", "React", 0.8, "scripts", r"(?i)react-dom(\.production|\.development)?(\.min)?\.js"), ("frontend", "React", 0.8, "html", r"<!--\$-->", "html", r"<!--/\$-->"),
    ("frontend", "Vue", 0.85, "html", r"(?i)data-v-[a-f0-9]{6,10}"), ("frontend", "Vue", 0.75, "scripts", r"(?i)\bvue(\.runtime)?(\.global)?(\.min)?\.js"), ("frontend", "Vue", 0.6, "html", r"(?i)\bv-cloak\b|\bv-if=|\bv-for=|\bv-bind:"),
    ("frontend", "Nuxt", 0.95, "html", r"(?i)__NUXT__"), ("frontend", "Nuxt", 0.9, "html", r"(?i)/_nuxt/"), ("frontend", "Nuxt", 0.85, "html", r'(?i)id="__nuxt"'),
    ("frontend", "Angular", 0.95, "html", r'(?i)\bng-version="'), ("frontend", "Angular", 0.75, "html", r"(?i)<app-root[\s>]"), ("frontend", "Angular", 0.85, "html", r"(?i)_nghost-|_ngcontent-"), ("frontend", "Angular", 0.6, "scripts", r"(?i)\bangular(\.min)?\.js\b"),
    ("frontend", "Svelte", 0.85, "html", r'(?i)class="[^"]*\bsvelte-[a-z0-9]{5,8}\b'), ("frontend", "Svelte", 0.9, "html", r"(?i)/_app/immutable/"),
    ("frontend", "Astro", 0.95, "html", r"(?i)<astro-island[\s>]"), ("frontend", "Astro", 0.85, "html", r"(?i)data-astro-cid-"), ("frontend", "Astro", 0.8, "html", r"(?i)/_astro/"),
    ("frontend", "Remix", 0.95, "html", r"(?i)__remixContext|__remixManifest"), ("frontend", "Gatsby", 0.9, "html", r'(?i)id="___gatsby"'), ("frontend", "Gatsby", 0.85, "html", r"(?i)/page-data/"),
    ("backend", "Laravel", 0.9, "cookies", r"(?i)laravel_session"), ("backend", "Laravel", 0.6, "html", r'(?i)name="_token"'), ("backend", "Laravel", 0.4, "headers", r"(?i)x-xsrf-token"),
    ("backend", "Symfony", 0.9, "headers", r"(?i)x-debug-token"), ("backend", "Symfony", 0.9, "html", r"(?i)symfony profiler|sf-toolbar"), ("backend", "CodeIgniter", 0.85, "cookies", r"(?i)\bci_session\b"),
    ("backend", "CakePHP", 0.6, "html_or_headers", r"(?i)\bcakephp\b"), ("backend", "Express.js", 0.9, "powered", r"(?i)^express$"), ("backend", "Express.js", 0.75, "cookies", r"(?i)\bconnect\.sid\b"),
    ("backend", "NestJS", 0.35, "headers", r"(?i)x-powered-by:\s*express", "html", r"(?i)nest"), ("backend", "FastAPI", 0.75, "server", r"(?i)^uvicorn$"), ("backend", "FastAPI", 0.4, "headers", r"(?i)x-process-time"),
    ("backend", "Django", 0.85, "html", r"(?i)csrfmiddlewaretoken"), ("backend", "Django", 0.5, "cookies", r"(?i)\bcsrftoken\b|\bdjango_language\b|\bsessionid\b"),
    ("backend", "Flask", 0.7, "server", r"(?i)^werkzeug"), ("backend", "Flask", 0.3, "cookies", r"(?i)\bsession=", "server", r"(?i)^gunicorn$"),
    ("backend", "Spring Boot", 0.85, "server", r"(?i)apache-coyote"), ("backend", "Spring Boot", 0.5, "cookies", r"\bJSESSIONID\b"),
    ("backend", "ASP.NET", 0.9, "powered", r"(?i)asp\.net"), ("backend", "ASP.NET", 0.9, "html", r"(?i)__VIEWSTATE"), ("backend", "ASP.NET", 0.85, "cookies", r"(?i)\.aspnetcore\.session|asp\.net_sessionid"),
    ("backend", "ASP.NET", 0.9, "headers", r"(?i)x-aspnet-version|x-aspnetmvc-version"), ("backend", "ASP.NET", 0.5, "server", r"(?i)^microsoft-iis"),
    ("backend", "Ruby on Rails", 0.85, "html", r"(?i)authenticity_token"), ("backend", "Ruby on Rails", 0.6, "headers", r"(?i)x-request-id", "html", r"(?i)data-turbo|data-controller="), ("backend", "Ruby on Rails", 0.5, "cookies", r"(?i)_session_id=|_rails_session"),
    ("backend", "Go", 0.8, "powered", r"(?i)^fiber$"),
    ("server", "OpenLiteSpeed", 0.95, "server", r"(?i)openlitespeed"), ("server", "LiteSpeed", 0.95, "server", r"(?i)^(?!.*openlitespeed).*litespeed"), ("server", "Apache", 0.95, "server", r"(?i)^apache"), ("server", "Nginx", 0.95, "server", r"(?i)^nginx"),
    ("server", "IIS", 0.95, "server", r"(?i)microsoft-iis"), ("server", "Caddy", 0.95, "server", r"(?i)^caddy"), ("server", "Node Server", 0.4, "server", r"(?i)^cowboy$"),
    ("cdn", "Cloudflare", 0.9, "server", r"(?i)^cloudflare$"), ("cdn", "Cloudflare", 0.9, "headers", r"(?i)\bcf-ray\b"), ("cdn", "Cloudflare", 0.85, "headers", r"(?i)\bcf-cache-status\b"),
    ("cdn", "CloudFront", 0.9, "server", r"(?i)^cloudfront$"), ("cdn", "CloudFront", 0.9, "headers", r"(?i)\bx-amz-cf-id\b"), ("cdn", "CloudFront", 0.9, "headers", r"(?i)from cloudfront"),
    ("cdn", "Fastly", 0.9, "headers", r"(?i)\bx-fastly-request-id\b"), ("cdn", "Fastly", 0.6, "headers", r"(?i)x-served-by:[^\n]*cache-"), ("cdn", "BunnyCDN", 0.9, "server", r"(?i)^bunnycdn$"), ("cdn", "BunnyCDN", 0.8, "html", r"(?i)\.b-cdn\.net"),
    ("cdn", "Akamai", 0.85, "headers", r"(?im)\bx-akamai-|^server:.*akamai"), ("cdn", "KeyCDN", 0.85, "html", r"(?i)\.kxcdn\.com"), ("cdn", "JSDelivr", 0.85, "html", r"(?i)cdn\.jsdelivr\.net"), ("cdn", "UNPKG", 0.85, "html", r"(?i)unpkg\.com"),
    ("hosting", "Vercel", 0.9, "headers", r"(?i)\bx-vercel-id\b"), ("hosting", "Netlify", 0.9, "headers", r"(?i)\bx-nf-request-id\b"), ("hosting", "Railway", 0.9, "headers", r"(?i)\bx-railway-"),
    ("hosting", "Heroku", 0.85, "headers", r"(?i)\bvia:[^\n]*vegur\b"), ("hosting", "Heroku", 0.35, "headers", r"(?im)^cowboy$"), ("hosting", "Render", 0.85, "headers", r"(?i)\bx-render-origin-server\b"),
    ("hosting", "Google Cloud", 0.6, "headers", r"(?i)server:\s*gws|x-goog-"), ("hosting", "Azure", 0.85, "headers", r"(?i)\bx-azure-ref\b"), ("hosting", "AWS", 0.6, "headers", r"(?i)\bx-amz-cf-id\b|\bx-amzn-"),
    ("hosting", "AWS", 0.8, "nameservers", r"(?i)awsdns-"), ("hosting", "Azure", 0.85, "nameservers", r"(?i)azure-dns\.(com|net|org|info)"), ("hosting", "Google Cloud", 0.6, "nameservers", r"(?i)googledomains\.com|google\.com$"),
    ("hosting", "DigitalOcean", 0.85, "nameservers", r"(?i)ns\d*\.digitalocean\.com"), ("hosting", "Hostinger", 0.8, "nameservers", r"(?i)hostinger\.(com|in)|dns-parking\.com"), ("hosting", "Bluehost", 0.85, "nameservers", r"(?i)bluehost\.com"),
    ("hosting", "SiteGround", 0.85, "nameservers", r"(?i)siteground\.(com|net)"), ("hosting", "Netlify", 0.85, "nameservers", r"(?i)netlifydns\.com"), ("hosting", "Vercel", 0.85, "nameservers", r"(?i)vercel-dns\.com"), ("hosting", "Cloudflare", 0.6, "nameservers", r"(?i)cloudflare\.com$"),
    ("database", "MySQL", 0.8, "html", r"(?i)you have an error in your sql syntax|mysqli_|warning: mysql_"), ("database", "MariaDB", 0.5, "html", r"(?i)\bmariadb\b"), ("database", "PostgreSQL", 0.8, "html", r"(?i)pg_query\(\)|org\.postgresql|postgresql query failed"),
    ("database", "PostgreSQL", 0.9, "html", r"""(?i)postgres(ql)?://[^\s"']+"""), ("database", "MongoDB", 0.8, "html", r"(?i)mongoerror|mongooseerror"), ("database", "MongoDB", 0.9, "html", r"""(?i)mongodb(\+srv)?://[^\s"']+"""),
    ("database", "SQLite", 0.6, "html", r"(?i)\bSQLITE_ERROR\b|\.sqlite3?\b"), ("database", "Redis", 0.9, "html", r"""(?i)redis://[^\s"']+"""), ("database", "Redis", 0.7, "html", r"(?i)ECONNREFUSED[^\n]*:6379"),
    ("database", "Oracle", 0.85, "html", r"\bORA-\d{5}\b"), ("database", "Oracle", 0.7, "html", r"(?i)oracle\.jdbc"), ("database", "SQL Server", 0.8, "html", r"(?i)unclosed quotation mark|system\.data\.sqlclient|microsoft sql server"),
    ("library", "jQuery", 0.85, "assets", r"(?i)\bjquery(-\d+\.\d+\.\d+)?(\.min)?\.js\b"), ("library", "jQuery", 0.5, "html", r"\bjQuery\s*\(|\$\.fn\.jquery"),
    ("library", "Material UI", 0.9, "html", r'class="[^"]*\bMui[A-Z][a-zA-Z]*-root\b'), ("library", "Material UI", 0.8, "html", r"(?i)@mui/material|material-ui/core"),
    ("library", "Ant Design", 0.85, "html", r'class="[^"]*\bant-[a-z]+(-[a-z]+)*\b'), ("library", "Chakra UI", 0.85, "html", r'class="[^"]*\bchakra-[a-z]+(-[a-z]+)*\b'),
    ("library", "Framer Motion", 0.6, "assets", r"(?i)framer-motion"), ("library", "Framer Motion", 0.5, "html", r"(?i)data-framer-[a-z-]+="), ("library", "GSAP", 0.85, "assets", r"(?i)\bgsap(\.min)?\.js\b"), ("library", "GSAP", 0.7, "html", r"\bTweenMax\b|\bTweenLite\b|\bScrollTrigger\b"),
    ("library", "Swiper", 0.85, "html", r"(?i)swiper-(container|wrapper|slide)\b"), ("library", "Swiper", 0.85, "assets", r"(?i)swiper-bundle(\.min)?\.(js|css)\b"), ("library", "Three.js", 0.85, "assets", r"(?i)\bthree(\.module|\.min)?\.js\b"), ("library", "Three.js", 0.6, "html", r"\bnew\s+THREE\.\w+"),
    ("library", "Chart.js", 0.8, "assets", r"(?i)\bchart(\.umd|\.min)?\.js\b"), ("library", "Chart.js", 0.5, "html", r"new\s+Chart\s*\("), ("library", "Recharts", 0.85, "html", r"(?i)recharts-(wrapper|surface)\b"), ("library", "Recharts", 0.6, "html", r'(?i)class="[^"]*recharts', "html", r"(?i)\brecharts\b"),
    ("css", "Bootstrap", 0.85, "assets", r"(?i)\bbootstrap(\.min)?\.css\b"), ("css", "Bootstrap", 0.8, "assets", r"(?i)\bbootstrap(\.bundle)?(\.min)?\.js\b"), ("css", "Bootstrap", 0.6, "html", r'class="[^"]*\b(container-fluid|navbar-expand-[a-z]+|btn-(primary|secondary|outline)|col-(xs|sm|md|lg|xl)-\d+)\b'),
    ("css", "Tailwind CSS", 0.7, "assets", r"(?i)tailwindcss"), ("css", "Tailwind CSS", 0.75, "classes", r"(?s)\b(sm|md|lg|xl|2xl|hover|focus|dark):[a-z-].*\b(sm|md|lg|xl|2xl|hover|focus|dark):[a-z-]"),
    ("seo", "Yoast SEO", 0.95, "html", r"(?i)optimized with the yoast seo plugin"), ("seo", "Yoast SEO", 0.6, "html", r'(?i)class="[^"]*\byoast-seo\b|yoast_seo'), ("seo", "Rank Math", 0.95, "html", r"(?i)optimized with the seo plugin rank math"), ("seo", "Rank Math", 0.6, "html", r"(?i)rank-math"),
    ("seo", "AIO SEO", 0.85, "html", r"(?i)all in one seo", "html", r"<!--"), ("seo", "AIO SEO", 0.6, "html", r"(?i)aioseo"), ("seo", "Google Search Console", 0.9, "html", r'(?i)name="google-site-verification"'),
    ("analytics", "Google Analytics", 0.9, "html", r"(?i)googletagmanager\.com/gtag/js|google-analytics\.com/analytics\.js"), ("analytics", "Google Analytics", 0.7, "html", r"""(?i)\bgtag\s*\(\s*['"]config['"]|\bga\s*\(\s*['"]create['"]"""), ("analytics", "Google Analytics", 0.5, "html", r"\b(G|UA)-[A-Z0-9-]{6,}\b"),
    ("analytics", "Google Tag Manager", 0.9, "html", r"(?i)googletagmanager\.com/gtm\.js"), ("analytics", "Google Tag Manager", 0.7, "html", r"\bGTM-[A-Z0-9]{4,}\b"),
    ("analytics", "Meta Pixel", 0.9, "html", r"""(?i)connect\.facebook\.net/[^"']*/fbevents\.js"""), ("analytics", "Meta Pixel", 0.8, "html", r"""(?i)\bfbq\s*\(\s*['"]init['"]"""),
    ("analytics", "Hotjar", 0.9, "html", r"(?i)static\.hotjar\.com"), ("analytics", "Hotjar", 0.7, "html", r"""(?i)\bhj\s*\(\s*['"]|_hjSettings"""), ("analytics", "Microsoft Clarity", 0.9, "html", r"(?i)\bclarity\.ms\b"),
    ("analytics", "Mixpanel", 0.9, "html", r"(?i)cdn\.mxpnl\.com"), ("analytics", "Mixpanel", 0.8, "html", r"(?i)mixpanel\.init\s*\("), ("analytics", "Amplitude", 0.9, "html", r"(?i)cdn\.amplitude\.com"), ("analytics", "Amplitude", 0.8, "html", r"(?i)amplitude\.getInstance\s*\("),
    ("analytics", "Matomo", 0.9, "html", r"(?i)\bmatomo\.js\b|\bpiwik\.js\b"), ("analytics", "Matomo", 0.8, "html", r"(?i)_paq\.push\s*\("), ("analytics", "LinkedIn Insight Tag", 0.9, "html", r"(?i)snap\.licdn\.com/li\.lms-analytics"), ("analytics", "LinkedIn Insight Tag", 0.8, "html", r"(?i)_linkedin_partner_id"),
    ("payment", "Stripe", 0.9, "html", r"(?i)js\.stripe\.com/v3"), ("payment", "Stripe", 0.85, "html", r"""(?i)\bStripe\s*\(\s*['"]pk_"""), ("payment", "Razorpay", 0.9, "html", r"(?i)checkout\.razorpay\.com"), ("payment", "Razorpay", 0.85, "html", r"(?i)new\s+Razorpay\s*\("),
    ("payment", "PayPal", 0.85, "html", r"(?i)www\.paypal\.com/sdk/js|paypalobjects\.com"), ("payment", "PayPal", 0.85, "html", r"(?i)paypal\.Buttons\s*\("), ("payment", "Square", 0.9, "html", r"(?i)js\.squareup\.com|web\.squarecdn\.com"), ("payment", "Square", 0.85, "html", r"(?i)Square\.payments\s*\("),
    ("payment", "Authorize.Net", 0.9, "html", r"(?i)js\.authorize\.net"), ("payment", "Authorize.Net", 0.85, "html", r"(?i)Accept\.dispatchData\s*\("), ("payment", "PayU", 0.85, "html", r"(?i)secure\.payu\.com|secure\.payu\.in|checkout\.payu\.in"), ("payment", "PayU", 0.8, "html", r"(?i)bolt\.payu\s*\("),
    ("payment", "PhonePe", 0.9, "html", r"(?i)mercury\.phonepe\.com"), ("payment", "PhonePe", 0.85, "html", r"(?i)PhonePeCheckout\.transact\s*\("), ("payment", "Cashfree", 0.9, "html", r"(?i)sdk\.cashfree\.com"), ("payment", "Cashfree", 0.8, "html", r"(?i)\bCashfree\s*\(\s*\{"), ("payment", "CCAvenue", 0.9, "html", r"(?i)secure\.ccavenue\.com"),
    ("auth", "Google Login", 0.9, "html", r"(?i)accounts\.google\.com/gsi/client"), ("auth", "Google Login", 0.7, "html", r'(?i)class="[^"]*\bg_id_signin\b'), ("auth", "Facebook Login", 0.85, "html", r"(?i)FB\.login\s*\("), ("auth", "Facebook Login", 0.8, "html", r'(?i)class="[^"]*\bfb-login-button\b'),
    ("auth", "Apple Login", 0.9, "html", r"(?i)appleid\.cdn-apple\.com"), ("auth", "Apple Login", 0.85, "html", r"(?i)AppleID\.auth\.init\s*\("), ("auth", "Microsoft Login", 0.85, "html", r"(?i)login\.microsoftonline\.com|login\.live\.com"), ("auth", "Microsoft Login", 0.8, "html", r"(?i)@azure/msal-browser|\bmsal\.js\b"),
    ("auth", "JWT Authentication", 0.5, "html", r"""(?i)jwt_decode\s*\(|localStorage\.(get|set)Item\s*\(\s*['"]([a-z_]*token|jwt)['"]"""), ("auth", "OAuth", 0.6, "html", r"(?i)response_type=code|/oauth/authorize"),
    ("chat", "Tawk.to", 0.9, "html", r"(?i)embed\.tawk\.to"), ("chat", "Intercom", 0.9, "html", r"(?i)widget\.intercom\.io"), ("chat", "Crisp", 0.9, "html", r"(?i)client\.crisp\.chat"), ("chat", "Zendesk", 0.9, "html", r"(?i)static\.zdassets\.com|ekr\.zdassets\.com"),
    ("chat", "Freshchat", 0.9, "html", r"(?i)wchat\.freshchat\.com"), ("chat", "LiveChat", 0.9, "html", r"(?i)cdn\.livechatinc\.com"), ("chat", "Drift", 0.9, "html", r"(?i)js\.driftt\.com"), ("chat", "HubSpot Chat", 0.85, "html", r"(?i)js\.hs-scripts\.com|static\.hsappstatic\.net"),
    ("chat", "Crisp", 0.7, "html", r"(?i)window\.\$crisp\b"), ("chat", "Intercom", 0.7, "html", r"""(?i)\bIntercom\s*\(\s*['"]boot['"]"""),
]
# What a category counts as where none of its rules fires.
DEFAULTS = {"cms": ("Custom CMS", 0.3), "frontend": ("HTML Static Website", 0.4), "backend": ("Custom Backend", 0.25), "hosting": ("Custom VPS or Dedicated Server", 0.3)}
LANGUAGES = {"Laravel": "PHP", "Symfony": "PHP", "CodeIgniter": "PHP", "CakePHP": "PHP", "Express.js": "JavaScript", "NestJS": "TypeScript", "FastAPI": "Python", "Django": "Python", "Flask": "Python", "Spring Boot": "Java", "ASP.NET": "C#", "Ruby on Rails": "Ruby", "Go": "Go"}
MANAGED = ["Shopify", "Wix", "Squarespace", "Webflow", "Blogger"]
#: Platforms that imply a database: any of the names, database, weight.
USUAL = [
    (["WordPress", "WooCommerce", "Drupal", "Joomla", "Magento", "OpenCart", "PrestaShop"], "MySQL", 0.3), (["WordPress", "WooCommerce", "Drupal", "Joomla", "Magento", "OpenCart", "PrestaShop"], "MariaDB", 0.15),
    (["Laravel", "CodeIgniter", "CakePHP"], "MySQL", 0.25), (["Django"], "PostgreSQL", 0.3), (["Django"], "SQLite", 0.2), (["Ruby on Rails"], "PostgreSQL", 0.3), (["Ruby on Rails"], "SQLite", 0.2),
    (["ASP.NET"], "SQL Server", 0.4), (["Ghost"], "SQLite", 0.25), (["Ghost"], "MySQL", 0.25),
]
CATEGORIES = ["cms", "frontend", "backend", "language", "server", "cdn", "hosting", "database", "library", "css", "seo", "analytics", "payment", "auth", "chat", "forms"]
CONFIDENT = 0.4

_LITERAL = re.compile(r"(?:[\w/ :@\"=<>!-]|\\[./$?+()-])+")
_HIT = "struct<category:string,name:string,weight:double>"


def literals(pattern: str) -> list[str]:
    """The substrings (in lower case) that a pattern is a choice of, none where it is more than that."""
    parts = pattern.removeprefix("(?i)").split("|")
    plain = pattern.startswith("(?i)") and all(_LITERAL.fullmatch(p) for p in parts)
    return [re.sub(r"\\(.)", r"\1", p).lower() for p in parts] if plain else []


def needed(pattern: str) -> list[str]:
    """Substrings (in lower case) of which every match of a pattern holds one, none where no such is seen: of each alternative the longest
    run of plain characters outside groups, an opened attribute only where there is no other."""
    gap, moved = "\0", lambda m: chr(0xE000 + ord(m[1]))
    body = re.sub(r"\[(?:\\.|[^\]\\])+\]|\\[A-Za-z]", gap, re.sub(r"^\(\?[a-z]+\)", "", pattern))
    body = re.sub(r"\\(.)", moved, body)
    while "(" in body:
        body = re.sub(r"\([^()]*\)", gap, body)
    body = re.sub(r"(?s)(.)([+*?]|\{[\d,]*\})[+?]?", lambda m: (m[1] if m[2] == "+" else "") + gap, body)
    found = []
    for choice in re.sub(r"[.^$]", gap, body).split("|"):
        runs = [re.sub("[\uE000-\uE0FF]", lambda m: chr(ord(m[0]) - 0xE000), r).lower() for r in choice.split(gap)]
        found.append(max(runs, key=lambda r: (len(r) > 1 and not r.endswith('="'), len(r))))
    return found if all(len(w) > 1 for w in found) else []


#: Patterns on the html besides the rules: languages by file names, codes asked for, chat windows.
PHP, ASPX, CODE = r"""(?i)\.php(\?|"|'|$)""", r"""(?i)\.aspx(\?|"|'|$)|\.ashx(\?|"|'|$)""", r"\botp\b|one-time password|verification code"
CHAT = r'(?i)class="[^"]*\b(chat-widget|chat-bubble|live-chat)\b'


def sought() -> list[str]:
    """Every substring that some pattern on the html is or needs."""
    patterns = [p for _, _, _, *tests in RULES for f, p in zip(tests[::2], tests[1::2], strict=True) if f in ("html", "html_or_headers")]
    return sorted({w for p in [*patterns, PHP, ASPX, CODE] for w in literals(p) or needed(p)} | {"chat-widget", "chat-bubble", "live-chat"})


SOUGHT = {w: i for i, w in enumerate(sought())}


def holding(text: Column) -> Column:
    """Which of ``SOUGHT`` a text in lower case holds, by number. Texts are searched as bytes, so none needs to be valid."""
    words = [w.encode() for w in SOUGHT]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [i for i, w in enumerate(words) if w in x])

    return F.pandas_udf(run, "array<int>")(text.cast("binary"))


def held(words: list[str]) -> Column:
    """Whether the page's html holds one of the words."""
    return F.arrays_overlap("holds", F.array(*[F.lit(SOUGHT[w]) for w in words])) if len(words) > 1 else F.array_contains("holds", SOUGHT[words[0]])


def matches(fields: dict[str, Column], lowered: dict[str, Column], field: str, pattern: str) -> Column:
    """Whether a rule's pattern is found in its field: by substrings where the pattern is a choice of literals."""
    if field == "probe":
        return F.coalesce(F.array_contains(fields["probes"], pattern), F.lit(False))
    plain = literals(pattern)
    if plain and field == "html":
        return held(plain)
    if plain:
        found = None
        for p in plain:
            hit = lowered[field].contains(p)
            found = hit if found is None else found | hit
        return F.coalesce(found, F.lit(False))
    hit, words = F.coalesce(fields[field].rlike(pattern), F.lit(False)), needed(pattern)
    if words and field == "html":
        return held(words) & hit
    if words and field == "html_or_headers":  # no needed substring spans the line between them
        elsewhere = lowered["headers"].contains(words[0])
        for w in words[1:]:
            elsewhere = elsewhere | lowered["headers"].contains(w)
        return (held(words) | elsewhere) & hit
    return hit


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in the text of a tag, null where it is missing."""
    got = lambda quote: F.regexp_extract(tag, rf"(?is)(?:^|\s){name}\s*=\s*{quote}([^{quote}]*){quote}", 1)
    bare = F.regexp_extract(tag, rf"(?is)(?:^|\s){name}\s*=\s*([^\s\"'>]+)", 1)
    return F.coalesce(F.nullif(got('"'), F.lit("")), F.nullif(got("'"), F.lit("")), F.nullif(bare, F.lit("")))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b([^>]*)>"), 1)


def extract(sites: DataFrame) -> DataFrame:
    """``sites`` with scripts, meta_tags, link_tags, forms, html_attributes and body_classes read off the html."""
    html = F.coalesce("html", F.lit(""))
    scripts = F.transform(_tags(html, "script"), lambda t: F.struct(attribute(t, "src").alias("src"), attribute(t, "type").alias("type")))
    metas = F.transform(_tags(html, "meta"), lambda t: F.struct(attribute(t, "name").alias("name"), attribute(t, "property").alias("property"), attribute(t, "content").alias("content")))
    links = F.transform(_tags(html, "link"), lambda t: F.struct(attribute(t, "rel").alias("rel"), attribute(t, "href").alias("href"), attribute(t, "as").alias("as")))

    def field(tag: Column) -> Column:
        kind = F.lower(F.regexp_extract(tag, r"^<(\w+)", 1))
        return F.struct(attribute(tag, "name").alias("name"), F.when(kind == "input", F.lower(F.coalesce(attribute(tag, "type"), F.lit("text")))).otherwise(kind).alias("type"), attribute(tag, "placeholder").alias("placeholder"))

    def form(text: Column) -> Column:
        head = F.regexp_extract(text, r"(?is)^<form\b([^>]*)>", 1)
        inside = F.regexp_extract_all(text, F.lit(r"(?is)<(?:input|textarea|select)\b[^>]*"), 0)
        return F.struct(
            attribute(head, "action").alias("action"), F.lower(F.coalesce(attribute(head, "method"), F.lit("get"))).alias("method"), attribute(head, "id").alias("id"),
            attribute(head, "class").alias("class_name"), F.transform(inside, field).alias("fields"),
        )

    forms = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<form\b.*?</form>"), 0), form)
    names = F.regexp_extract_all(F.regexp_extract(html, r"(?is)<html\b([^>]*)>", 1), F.lit(r"([\w:-]+)\s*="), 1)
    classes = F.filter(F.split(F.coalesce(attribute(F.regexp_extract(html, r"(?is)<body\b([^>]*)>", 1), "class"), F.lit("")), r"\s+"), lambda c: c != "")
    return sites.select("*", scripts.alias("scripts"), metas.alias("meta_tags"), links.alias("link_tags"), forms.alias("forms"), names.alias("html_attributes"), classes.alias("body_classes"))


def form_category(form: Column) -> Column:
    """The first category that fits a form, null if none does."""
    none = lambda c: F.coalesce(c, F.lit(""))
    names = F.lower(F.array_join(F.transform(form["fields"], lambda f: F.concat_ws(" ", none(f["name"]), none(f["placeholder"]))), " "))
    context = F.lower(F.concat_ws(" ", none(form["action"]), none(form["id"]), none(form["class_name"])))
    n = F.size(form["fields"])
    passwords = F.size(F.filter(form["fields"], lambda f: f["type"] == "password"))
    typed = lambda kind: F.exists(form["fields"], lambda f: f["type"] == kind)
    email, name = names.rlike("email|e-mail") | typed("email"), names.contains("name")
    phone = names.rlike(r"phone|mobile|tel\b") | typed("tel")
    card = F.exists(form["fields"], lambda f: none(f["name"]).rlike("card[-_]?number|cvv|expiry"))
    return (
        F.when((passwords >= 2) | (passwords == 1) & context.rlike("register|signup|sign-up|create[-_]?account"), "Registration Forms")
        .when((passwords == 1) & (email | context.rlike("login|sign-in|signin")), "Login Forms")
        .when(context.contains("search") | typed("search") | (form["method"] == "get") & (n == 1) & F.trim(names).rlike("^q$|search"), "Search Forms")
        .when(context.rlike("checkout|billing|shipping|payment|cart") | card, "Checkout Forms")
        .when(context.rlike("appointment|booking|schedule|reservation") | names.rlike("appointment|booking date|preferred date"), "Appointment Forms")
        .when(context.rlike("newsletter|subscribe") | email & (n <= 2) & ~name, "Newsletter Forms")
        .when(context.contains("contact") | name & email & names.contains("message"), "Contact Forms")
        .when(name & email & phone, "Lead Forms")
    )


def _hit(category: str, name: Column | str, weight: Column | float) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return F.struct(F.lit(category).alias("category"), name.alias("name"), weight.cast("double").alias("weight"))


def _languages(found: Column) -> Column:
    """Languages implied by frameworks: 0.9 of a framework's strongest hit."""
    implied = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    names = F.filter(F.array_distinct(F.transform(found, lambda h: h["name"])), lambda n: F.map_contains_key(implied, n))
    strongest = lambda n: F.array_max(F.transform(F.filter(found, lambda h: h["name"] == n), lambda h: h["weight"]))
    return F.transform(names, lambda n: _hit("language", F.element_at(implied, n), strongest(n) * 0.9))


def _databases(found: Column) -> Column:
    """Databases usual with platforms of confidence 0.4 or more, none for managed platforms."""
    score = lambda n: 1 - F.aggregate(F.filter(found, lambda h: h["name"] == n), F.lit(1.0), lambda a, h: a * (1 - h["weight"]))
    sure = F.filter(F.array_distinct(F.transform(found, lambda h: h["name"])), lambda n: F.round(score(n), 4) >= CONFIDENT)

    def usual(names: Column) -> Column:
        any_of = lambda xs: F.arrays_overlap(names, F.array(*map(F.lit, xs)))
        return F.when(any_of(MANAGED), F.array().cast(f"array<{_HIT}>")).otherwise(F.array_compact(F.array(*[F.when(any_of(platforms), _hit("database", name, weight)) for platforms, name, weight in USUAL])))

    return once(sure, usual)


def hits(sites: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """page_id, category, name, weight: every rule that fires and what the platforms found imply, in one pass without a shuffle."""
    attach(sites.sparkSession)
    wanted = set(categories or CATEGORIES)
    header = lambda k: F.coalesce(F.try_element_at("headers", F.lit(k)), F.lit(""))
    join = lambda c, sep=" ": F.coalesce(F.array_join(c, sep), F.lit(""))
    html = F.coalesce("html", F.lit(""))
    sources = F.array_compact(F.transform("scripts", lambda s: s["src"]))
    refs = F.array_compact(F.transform("link_tags", lambda x: x["href"]))
    rows = extract(sites).select(
        "page_id", html.alias("html"), F.concat_ws("\n", F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))).alias("headers_text"),
        F.trim(header("server")).alias("server"), F.trim(header("x-powered-by")).alias("powered"), join("cookies").alias("cookies"), join("nameservers").alias("nameservers"), F.coalesce("probes", F.array()).alias("probes"),
        join(sources).alias("scripts"), F.concat_ws(" ", join(sources), join(refs)).alias("assets"), F.coalesce(F.get(F.filter("meta_tags", lambda m: F.lower(m["name"]) == "generator"), 0)["content"], F.lit("")).alias("generator"),
        join(F.regexp_extract_all(html, F.lit(r'class="([^"]*)"'), 1)).alias("classes"), "meta_tags", "link_tags", "forms", (F.size(F.coalesce("sitemaps", F.array())) > 0).alias("sitemap"), F.coalesce("robots", F.lit(False)).alias("robots"),
        F.size("scripts").alias("n_scripts"), F.exists("scripts", lambda s: F.lower(s["type"]) == "application/ld+json").alias("json_ld"),
    )
    columns = {"html": "html", "headers": "headers_text", "server": "server", "powered": "powered", "cookies": "cookies", "nameservers": "nameservers", "scripts": "scripts", "assets": "assets", "generator": "generator", "classes": "classes"}
    lower = {f: f"{f}_lower" for f in columns}
    rows = rows.select("*", *[F.lower(columns[f]).alias(lower[f]) for f in columns])
    rows = rows.withColumn("holds", holding(F.col("html_lower")))
    fields = {f: F.col(c) for f, c in columns.items()} | {"probes": F.col("probes"), "html_or_headers": F.concat_ws("\n", "html", "headers_text")}
    lowered = {f: F.col(c) for f, c in lower.items()} | {"html_or_headers": F.concat_ws("\n", "html_lower", "headers_lower")}

    def of(category: str) -> Column:
        fired = []
        for c, name, weight, *tests in RULES:
            if c == category:
                good = None
                for field, pattern in zip(tests[::2], tests[1::2], strict=True):
                    hit = matches(fields, lowered, field, pattern)
                    good = hit if good is None else good & hit
                fired.append(F.when(good, _hit(c, name, weight)))
        return F.array_compact(F.array(*(fired + _more(category)))) if fired or _more(category) else F.array().cast(f"array<{_HIT}>")

    def _more(category: str) -> list[Column]:
        if category == "language":
            php = F.col("powered").rlike("(?i)^php/")
            return [
                F.when(php, _hit(category, "PHP", 0.9)).when(held(needed(PHP)) & F.col("html").rlike(PHP), _hit(category, "PHP", 0.4)), F.when(held(needed(ASPX)) & F.col("html").rlike(ASPX), _hit(category, "C#", 0.5)),
                F.when(F.col("headers_text").rlike(r"(?i)x-generator:\s*(drupal|joomla)"), _hit(category, "PHP", 0.5)), F.when(F.col("server").rlike("(?i)^(gunicorn|uvicorn|werkzeug|waitress)"), _hit(category, "Python", 0.6)),
                F.when(F.col("server").rlike("(?i)^apache-coyote"), _hit(category, "Java", 0.6)), F.when(F.col("n_scripts") > 0, _hit(category, "JavaScript", 0.3)),
            ]
        if category == "seo":
            prefixed = lambda p: F.exists("meta_tags", lambda m: F.lower(F.coalesce(m["property"], m["name"])).startswith(p))
            return [
                F.when(F.col("json_ld"), _hit(category, "Schema.org", 0.9)), F.when(prefixed("og:"), _hit(category, "Open Graph", 0.9)), F.when(prefixed("twitter:"), _hit(category, "Twitter Cards", 0.9)),
                F.when(F.exists("link_tags", lambda x: F.lower(x["rel"]) == "canonical"), _hit(category, "Canonical Tags", 0.95)), F.when(F.col("sitemap") | F.array_contains("probes", "/sitemap.xml"), _hit(category, "XML Sitemap", 0.9)),
                F.when(F.col("robots"), _hit(category, "Robots.txt", 0.95)),
            ]
        if category == "auth":
            code = lambda f: F.coalesce(F.lower(f["name"]).rlike("otp|verification[-_ ]?code"), F.lit(False)) | F.coalesce(F.lower(f["placeholder"]).rlike("otp|verification code"), F.lit(False))
            asks = F.exists("forms", lambda f: F.exists(f["fields"], code))
            login = F.exists("forms", lambda f: F.exists(f["fields"], lambda x: x["type"] == "password") & F.exists(f["fields"], lambda x: F.coalesce(F.lower(x["name"]).rlike("email|user"), F.lit(False))))
            return [
                F.when(held(needed(CODE)) & F.col("html_lower").rlike(CODE) & asks, _hit(category, "OTP Login", 0.75)),
                F.when(login & F.col("cookies_lower").rlike(r"connect\.sid|phpsessid|jsessionid|sessionid"), _hit(category, "Session Authentication", 0.55)),
            ]
        return []

    def settled(category: str) -> Column:
        def default(found: Column) -> Column:
            blank = F.trim("html") == ""
            if category in DEFAULTS:
                # Hosting is inferred from headers and names alone, so it has a default without any html.
                last = F.when(F.lit(category == "hosting") | ~blank, F.array(_hit(category, *DEFAULTS[category]))).otherwise(found)
            elif category == "server":
                weight = F.when(F.col("server") == "", 0.3).when(F.col("server").rlike(r"(?i)^(vercel|netlify|cloudflare|cloudfront|github\.com)$"), 0.2).otherwise(0.35)
                last = F.array(_hit(category, "Custom Server", weight))
            elif category == "payment":
                pays = lambda f: F.coalesce(F.lower(f["action"]).rlike("pay|checkout|billing|cart"), F.lit(False)) | F.coalesce(F.lower(f["id"]).rlike("pay|checkout"), F.lit(False)) | F.coalesce(F.lower(f["class_name"]).rlike("pay|checkout"), F.lit(False))
                last = F.when(F.exists("forms", pays), F.array(_hit(category, "Custom Payment", 0.3))).otherwise(found)
            elif category == "chat":
                last = F.when(held(["chat-widget", "chat-bubble", "live-chat"]) & F.col("html").rlike(CHAT), F.array(_hit(category, "Custom Chat", 0.3))).otherwise(found)
            else:
                return found
            return F.when(F.size(found) > 0, found).otherwise(last)

        return once(of(category), default)

    parts = []
    if wanted & {"cms", "backend", "language", "database"}:

        def platforms(found: Column) -> Column:
            of = lambda c: F.filter(found, lambda h: h["category"] == c)
            out = [of(c) for c in ("cms", "backend") if c in wanted]
            if "language" in wanted:
                out.append(_languages(of("backend")))
            if "database" in wanted:
                out.append(_databases(found))
            return F.concat(*out)

        asked = [c for c in ("cms", "backend") if c in wanted or "database" in wanted or c == "backend" and "language" in wanted]
        parts.append(once(F.concat(*[settled(c) for c in asked]), platforms))
    parts += [settled(c) for c in CATEGORIES if c in wanted - {"cms", "backend", "forms"}]
    if "forms" in wanted:
        parts.append(F.transform(F.filter(F.transform("forms", form_category), lambda c: c.isNotNull()), lambda c: _hit("forms", c, 0.6)))
    return rows.select("page_id", F.inline(F.concat(*parts)))


def noisy_or(found: DataFrame) -> DataFrame:
    """page_id, category, name, confidence, signals: 1 - product of (1 - weight)."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "weight"))
    return found.groupBy("page_id", "category", "name").agg(F.round(1 - F.product(1 - w), 4).alias("confidence"), F.count(F.lit(1)).alias("signals"))


def detect(sites: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Scored technologies of each site in the categories (all sixteen by default)."""
    return noisy_or(hits(sites, categories))


def _scored(findings: list[tuple[str, Column, Column, int]]) -> Column:
    """array<struct<check, passed, points>>: only checks that apply."""
    return F.array_compact(F.array(*[F.when(applies, F.struct(F.lit(name).alias("check"), passed.alias("passed"), F.lit(points).alias("points"))) for name, applies, passed, points in findings]))


def security_findings(sites: DataFrame) -> DataFrame:
    """page_id, check, passed, points of the checks that apply; points are 25, 15, 10 or 5 by severity."""
    header = lambda k: F.coalesce(F.try_element_at("headers", F.lit(k)), F.lit(""))
    yes, https = F.lit(True), F.coalesce(F.col("url").startswith("https://"), F.lit(False))
    csp = header("content-security-policy")
    open_to_all = (F.trim(header("access-control-allow-origin")) == "*") & header("access-control-allow-credentials").rlike("(?i)true")
    bare = F.exists("cookies", lambda c: ~(c.rlike(r"(?i);\s*secure\b") & c.rlike(r"(?i);\s*httponly\b")))
    return sites.select("page_id", F.inline(_scored([
        ("HTTPS", yes, https, 25), ("SSL Certificate", https, F.coalesce("tls", F.lit(False)), 25),
        ("HSTS", yes, header("strict-transport-security").rlike(r"(?i)max-age=0*[1-9]"), 15), ("Content-Security-Policy", yes, csp != "", 15),
        ("Clickjacking Protection", yes, (header("x-frame-options") != "") | csp.rlike("(?i)frame-ancestors"), 10), ("X-Content-Type-Options", yes, header("x-content-type-options").rlike("(?i)nosniff"), 10),
        ("XSS Protection", yes, header("x-xss-protection") != "", 5), ("CORS", header("access-control-allow-origin") != "", ~open_to_all, 10), ("Cookie Policy", F.size("cookies") > 0, ~bare, 10),
    ])))


def performance_findings(sites: DataFrame) -> DataFrame:
    """page_id, check, passed, points of the checks that apply; points are 20, 12 or 6 by severity."""
    header = lambda k: F.coalesce(F.try_element_at("headers", F.lit(k)), F.lit(""))
    html, yes = F.coalesce("html", F.lit("")), F.lit(True)
    rows = extract(sites).select(
        "page_id", html.alias("html"), F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), 0).alias("images"), header("content-encoding").alias("encoding"),
        (F.concat(header("cache-control"), header("etag"), header("expires")) != "").alias("cached"),
        F.concat(F.array_compact(F.transform("scripts", lambda s: s["src"])), F.filter(F.array_compact(F.transform("link_tags", lambda x: x["href"])), lambda h: h.rlike(r"(?i)\.css(\?|$)"))).alias("assets"),
    )
    some = F.size("images") > 0
    sized = F.forall("images", lambda t: t.rlike(r"""(?i)\bwidth=["']?\d""") & t.rlike(r"""(?i)\bheight=["']?\d"""))
    modern = F.col("html").rlike(r"""(?i)\.(webp|avif)(\?|["'])|<picture[\s>]""") | F.exists("images", lambda t: t.rlike(r"(?i)\bsrcset="))
    small = F.size(F.filter("assets", lambda a: a.rlike(r"(?i)\.min\.(js|css)(\?|$)")))
    return rows.select("page_id", F.inline(_scored([
        ("Lazy Loading", some, F.exists("images", lambda t: t.rlike(r"""(?i)loading=["']lazy["']""")), 12), ("Image Dimensions", some, sized, 12), ("Image Optimization", some, modern, 12),
        ("Compression", yes, F.col("encoding").rlike("(?i)gzip|br|deflate|zstd"), 20), ("Caching", yes, F.col("cached"), 20), ("Resource Hints", yes, F.col("html").rlike(r"""(?i)<link[^>]+rel=["'](preconnect|dns-prefetch|preload)["']"""), 6),
        ("Font Loading Strategy", F.col("html").rlike(r"(?i)@font-face|fonts\.googleapis\.com"), F.col("html").rlike(r"(?i)font-display:\s*swap"), 6), ("Asset Minification", F.size("assets") > 0, small / F.size("assets") >= 0.5, 12),
    ])))


def score(findings: DataFrame) -> DataFrame:
    """page_id, score: points earned of those that apply, in percent (halves round up)."""
    earned = F.sum(F.when(F.col("passed"), F.col("points")).otherwise(0))
    return findings.groupBy("page_id").agg(F.when(F.sum("points") > 0, F.floor(100 * earned / F.sum("points") + 0.5)).otherwise(100).cast("int").alias("score"))
