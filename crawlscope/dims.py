"""Fixed values of the audit rules: word lists, thresholds, patterns and formats.

They must equal the published rules for results to agree, so they are kept together and
plain. All of them are short lists, so they enter plans as literals, not as joins.
"""

from __future__ import annotations

# Query keys that only carry campaign tracking.
TRACKING_KEYS = [
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
    "ref",
    "source",
    "mc_cid",
    "mc_eid",
    "_ga",
]

SENSITIVE_HEADERS = ["authorization", "cookie", "set-cookie", "x-csrf-token"]

# User agents whose robots groups apply to us; the first is the wildcard.
ROBOTS_AGENTS = ["*", "crawlscope"]

SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
ATOM_NAMESPACE = "http://www.w3.org/2005/Atom"
DEFAULT_SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml"]
DEFAULT_FEEDS = ["/feed", "/rss", "/atom.xml"]
MAX_SITEMAP_DEPTH = 3
MAX_SITEMAP_URLS = 2000
MAX_FEEDS = 3

CONTENT_ROOT = "_audit/content"
SCREENSHOT_ROOT = "_audit/screenshots"

# Ordered rewrites: (kind, pattern, replacement). (?U) pins Unicode \b, \d, \s and case.
PII_RULES = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "***@***.***"),
    ("phone", r"01[0-9]-?[0-9]{3,4}-?[0-9]{4}", "***-****-****"),
    ("resident", r"(?U)\b\d{6}-?[1-4]\d{6}\b", "******-*******"),
    ("card", r"(?U)\b(?:\d[ -]?){13,19}\b", "****-****-****-****"),
    (
        "secret",
        r'(?Ui)("?(?:api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret'
        r'|authorization)"?\s*[:=]\s*)"[^"]+"',
        '$1"***REDACTED***"',
    ),
    ("bearer", r"(?Ui)\bBearer\s+[A-Za-z0-9._\-+/=]+\b", "Bearer ***REDACTED***"),
]
# Text every match of a slow pattern contains; most texts lack it and skip the pattern.
PII_NEEDS = {"email": "@", "phone": "01", "secret": '"'}

PREVIEW_CHARS = 2000
PREVIEW_SUFFIX = "... (truncated)"
URL_CHARS = 300
WORDS_PER_MINUTE = 200

PALETTE_ROLES = ["Primary", "Secondary", "Accent", "Surface", "Muted"]

# Caps of single pages and reports.
PAGE_COLORS, PAGE_FONTS = 25, 20
EXPORT_COLORS = 25  # of the whole crawl, in the flat export
TOP_COLORS, TOP_FONTS, TOP_NAV, TOP_RESOURCES = 12, 10, 12, 10
REPORT_SLICES = {"palette": 5, "typography": 4, "navigation": 8, "frameworks": 6, "api": 6}
MIRROR_IMAGES = 50
MIRROR_IMAGES_HEADING = "이미지"

# Framework fingerprints: (name, places with patterns of which one must match, confidence, evidence,
# place and pattern of the version). Places: text of scripts, script and stylesheet addresses, generator,
# ids and classes of elements, opening tags.
FINGERPRINTS = [
    ("Next.js", [("script", r"__NEXT_DATA__"), ("id", r"(?m)^__NEXT_DATA__$")], "Confirmed", "__NEXT_DATA__ global", None),
    ("Nuxt.js", [("script", r"__NUXT__")], "Confirmed", "__NUXT__ global", None),
    ("React", [("id", r"(?m)^__next$"), ("tag", r"\sdata-reactroot[\s=/>]")], "Confirmed", "#__next / data-reactroot", None),
    ("jQuery", [("script_src", r"(?i)jquery")], "Likely", "script src", ("script_src", r"(?i)jquery[-./@]v?(\d+(?:\.\d+)+)")),
    ("WordPress", [("generator", r"(?i)WordPress"), ("class", r"(?m)(?:^|\s)wp-")], "Confirmed", "generator meta / wp-* class", None),
    ("Tailwind CSS", [("stylesheet", r"(?i)tailwind")], "Likely", "stylesheet href", None),
    ("Bootstrap", [("stylesheet", r"(?i)bootstrap")], "Confirmed", "stylesheet href", None),
]

# Types an input element reports; all other values count as text.
INPUT_TYPES = (
    "button checkbox color date datetime-local email file hidden image month number password radio range reset search "
    "submit tel text time url week"
).split()

API_TYPES = ["fetch", "xhr"]
HEAVY_ASSET_TYPES = ["script", "stylesheet", "image", "font"]

# Third-party purpose by host: first match wins.
HOST_PURPOSES = [
    ("Analytics", r"analytics|segment|mixpanel|hotjar|googletagmanager"),
    ("Ads", r"doubleclick|adservice|adsystem|criteo"),
    ("Fonts", r"fonts\.|typekit"),
    ("Widget", r"intercom|zendesk|facebook|channel\.io|youtube"),
    ("Security", r"recaptcha|hcaptcha|cloudflareinsights|sentry"),
]

# Metric thresholds: (metric, good below).
TIMING_LIMITS = [
    ("dom_content_loaded", 1500.0),
    ("load_complete", 3000.0),
    ("lcp", 2500.0),
    ("cls", 0.1),
]
LIGHTHOUSE_CATEGORIES = ["performance", "accessibility", "best-practices", "seo"]
SCORE_GOOD, SCORE_FAIR = 90.0, 50.0

# Keyword in navigation text -> feature, in rank order.
FEATURE_KEYWORDS = [
    ("문의", "contact_form"),
    ("contact", "contact_form"),
    ("portfolio", "portfolio"),
    ("gallery", "portfolio"),
    ("service", "services"),
    ("about", "about_team"),
    ("blog", "blog_news"),
    ("login", "login_signup"),
    ("signup", "login_signup"),
    ("admin", "admin"),
    ("shop", "payment"),
    ("product", "payment"),
]
HOME_FEATURE = "home"
DEFAULT_FEATURES = ["home", "services", "contact_form"]
STANDARD_FEATURES = [
    "home",
    "portfolio",
    "services",
    "about_team",
    "blog_news",
    "contact_form",
    "login_signup",
    "admin",
    "payment",
    "multilingual",
]

CONFIDENCE = ["Confirmed", "Likely", "Hypothesis", "Unknown"]

STAGES = ["target", "ux", "ia", "tech", "db", "report", "handover"]
# Stage -> stages that must be done before it.
STAGE_NEEDS = {
    "ux": ["target"],
    "ia": ["ux"],
    "tech": ["ia"],
    "db": ["ia", "tech"],
    "report": ["ux", "ia", "tech", "db"],
}

REQUESTS = [
    "review_known_gaps",
    "complete_budget_schedule_owner",
]
API_CAUTION_REQUEST = "verify_api_structure"

# Journey grades by pages on the path.
JOURNEY_GOOD, JOURNEY_FAIR = 3, 5

# What browsers apply before any sheet of a page, and the window of the desktop view.
BASE_STYLES = (
    "html { color: #000; font-family: 'Times New Roman'; font-size: 16px; font-weight: 400 } a:any-link { color: #0000ee }"
    " h1 { font-size: 2em } h2 { font-size: 1.5em } h3 { font-size: 1.17em } h5 { font-size: .83em } h6 { font-size: .67em }"
    " h1, h2, h3, h4, h5, h6, b, strong, th { font-weight: 700 } b, strong { font-weight: bolder }"
    " small { font-size: smaller } mark { background-color: #ff0; color: #000 }"
)
VIEWPORT_WIDTH = 1920
