"""They must equal the published ones for results to agree."""

from __future__ import annotations

# --- fixed values: categories, in order -------------------------------------
CLASSES = (
    "adult", "alcohol", "automobile", "cooking", "dating", "downloads", "drugs", "education", "finance", "fortunetelling", "forum", "gamble", "games",
    "gardening", "government", "homestyle", "hospitals", "humor", "imagehosting", "isp", "jobsearch", "library", "military", "movies", "music", "news",
    "pets", "politics", "radiotv", "realestate", "religion", "restaurants", "science", "searchengines", "shopping", "socialnet", "sports", "travel",
    "urlshortener", "weapons", "webmail", "wellness", "parked", "unavailable",
)

# --- fixed values: outcome codes, stages ------------------------------------
STAGES = ("validate", "fetch", "process", "infer")
ERROR_CODES = (
    "invalid_domain", "dns_error", "private_address", "connection_error", "timeout", "http_error", "robots_blocked", "content_type_rejected",
    "content_too_large", "no_archive_snapshot", "archive_rate_limited", "empty_text", "missing_input_path", "missing_screenshot", "model_load_error",
    "model_error", "llm_error", "bot_blocked", "thin_content", "cannot_classify", "unknown",
)
RETRYABLE = ("dns_error", "connection_error", "timeout", "http_error", "archive_rate_limited", "bot_blocked")
ARCHIVE_RECOVERABLE = ("bot_blocked", "timeout", "connection_error", "dns_error", "http_error")

# --- fixed values: pages that are no pages ----------------------------------
STRONG_MARKERS = (
    ("datadome", ("captcha-delivery.com", "geo.captcha-delivery")),
    ("cloudflare", ("cf_chl_opt", "cf-browser-verification", "cf-please-wait")),
    ("imperva", ("incapsula incident id",)),
    ("akamai", ("reference #18.",)),
)
WEAK_MARKERS = (
    ("cloudflare", ("challenges.cloudflare.com",)),
    ("perimeterx", ("perimeterx", "px-captcha")),
    ("datadome", ("datadome",)),
    ("recaptcha", ("g-recaptcha", "recaptcha/api.js")),
)
CHALLENGE_TITLES = ("just a moment...", "attention required! | cloudflare", "access denied", "security check", "are you a robot?", "verifying you are human")
BLOCK_STATUSES = (401, 403, 429, 503)
DENIAL = "(?i)(you don'?t have permission to access|access denied|enable javascript and cookies to continue|verify you are (?:a )?human)"
INTERSTITIAL_MAX, STUB_MAX = 60_000, 4_000
PARKING_SERVICES = ("dan.com", "sedo.com", "hugedomains", "afternic", "bodis.com", "parkingcrew", "wc_landing", "domainmarket", "undeveloped.com", "namesilo.com")
PARKING_PHRASES = (
    "is for sale", "buy this domain", "may be for sale", "domain for sale", "this domain is parked", "domain parking", "inquire about this domain",
    "domain name is for sale", "the domain you are looking for is for sale", "available for sale", "available to purchase", "parked free of charge",
    "is available -- inquire",
)
PARKED_MAX_WORDS = 250
SERVER_ARTIFACTS = ("index of /", "parent directory", "proudly served by", "litespeed web server", "welcome to nginx", "default web page", "it works!", "object not found!")
UNAVAILABLE_PHRASES = (
    "coming soon", "under construction", "im aufbau", "en construcci", "en travaux", "account suspended", "site is offline", "seite ist offline",
    "maintenance page", "we will be back", "website expired", "bandwidth limit exceeded", "site temporarily unavailable", "page is under maintenance",
)
UNAVAILABLE_MAX_WORDS = 60
MIN_TOKENS, CORPUS_MIN_TOKENS = 30, 6

# --- fixed values: addresses --------------------------------------------------
BLOCKED_EXTENSIONS = (
    ".exe", ".msi", ".scr", ".bat", ".cmd", ".com", ".pif", ".vbs", ".jar", ".app", ".dmg", ".pkg", ".deb", ".rpm", ".run", ".bin", ".elf", ".so", ".dll", ".dylib",
)
SUSPICIOUS_URLS = (
    r".*\/[^\/]*\.(exe|msi|scr|bat|cmd|pif|vbs|jar)(\?.*)?$",
    r".*\.com\/.*\.(exe|msi|scr|bat|cmd|pif|vbs|jar)(\?.*)?$",
    r".*\/download\/.*\.(zip|rar|7z|tar\.gz|tgz)(\?.*)?$",
    r".*\/attachment\/.*",
    r".*[?&](download|attachment)=.*",
)
INTERNAL_SUFFIXES = (".onion", ".local", ".internal", ".localhost")
HTML_LIMIT, PDF_LIMIT, OTHER_LIMIT = 5 * 1024 * 1024, 50 * 1024 * 1024, 10 * 1024 * 1024
ROBOTS_MAX = 512_000

# --- fixed values: words the frequency cleaner leaves out ----------------------
COMMON_WORDS = (
    "home", "contact", "us", "new", "news", "site", "privacy", "search", "help", "copyright", "free", "service", "en", "get", "one", "find", "menu", "account", "next",
)

# --- fixed values: taxonomy ----------------------------------------------------
EXCLUDED = ("adv", "tracker", "spyware", "redirector", "aggressive")
DROPPED = ("chat", "hacking", "webtv")
SPLIT_PARENTS = ("recreation", "hobby")
PROMOTED = (("finance/realestate", "realestate"), ("sex/education", "education"))
MERGED = (("porn", "adult"), ("sex", "adult"), ("models", "adult"), ("webradio", "radiotv"), ("warez", "downloads"))
MERGED_PATHS = (("hobby/games-misc", "games"), ("hobby/games-online", "games"))
DIRECTORY = (
    ("news", "News"), ("radiotv", "News"), ("movies", "Arts"), ("music", "Arts"), ("shopping", "Shopping"), ("finance", "Business"), ("jobsearch", "Business"),
    ("realestate", "Business"), ("automobile", "Recreation"), ("travel", "Recreation"), ("humor", "Recreation"), ("restaurants", "Recreation"),
    ("wellness", "Health"), ("sports", "Sports"), ("hospitals", "Health"), ("education", "Reference"), ("library", "Reference"), ("science", "Science"),
    ("government", "Society"), ("politics", "Society"), ("religion", "Society"), ("military", "Society"), ("forum", "Society"), ("fortunetelling", "Society"),
    ("cooking", "Home"), ("gardening", "Home"), ("pets", "Home"), ("homestyle", "Home"), ("games", "Games"), ("searchengines", "Computers"),
    ("webmail", "Computers"), ("socialnet", "Computers"), ("isp", "Computers"), ("imagehosting", "Computers"), ("downloads", "Computers"), ("urlshortener", "Computers"),
)

# --- fixed values: metrics -------------------------------------------------------
LABEL_FLOOR = 0.10
ECE_BINS = 10
WILSON_Z = 1.96
TRAIN_BELOW, VAL_BELOW = 80, 90
ARCHIVE_DAYS = 365
