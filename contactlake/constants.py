"""Word lists, patterns and bounds that define the results.

Everything here is a fixed value (not logic).  Lists keep their published
order where the order matters (typo targets, network owners, title patterns).
Callers can override every list through a function parameter.
"""

# --- fixed values: file extensions that look like a top-level domain -------
ASSET_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico",
    "js", "jsx", "ts", "tsx", "css", "scss", "less", "map",
    "woff", "woff2", "ttf", "eot", "otf",
    "mp4", "webm", "ogg", "mp3", "wav",
    "json", "xml", "pdf", "zip", "tar", "gz",
)

# --- fixed values: role mailboxes recognised by exact name or prefix -------
ROLE_PREFIXES = (
    "info", "support", "contact", "contactus", "sales", "admin", "administrator",
    "team", "help", "helpdesk", "press", "media", "pr", "billing", "accounts",
    "careers", "jobs", "hr", "recruiting", "talent", "privacy", "legal",
    "compliance", "security", "hello", "hi", "office", "inquiries", "enquiries",
    "service", "customer", "feedback", "marketing", "investors",
    "general", "mailbox", "frontdesk", "reception", "newsletter", "editor",
)

# --- fixed values: role mailboxes of the static checks (exact match) -------
ROLE_ACCOUNTS = (
    "support", "info", "sales", "admin", "administrator", "billing", "accounts",
    "contact", "contactus", "team", "help", "helpdesk", "press", "media", "pr",
    "careers", "jobs", "hr", "recruiting", "talent", "privacy", "legal",
    "compliance", "security", "hello", "hi", "office", "inquiries", "enquiries",
    "marketing", "investors", "general", "mailbox", "frontdesk", "reception",
    "newsletter", "editor", "webmaster", "hostmaster", "devnull",
)

# --- fixed values: disposable mail domains ---------------------------------
DISPOSABLE_DOMAINS = (
    "tempmail.com", "mailinator.com", "guerrillamail.com", "10minutemail.com",
    "throwawaymail.com", "yopmail.com", "trashmail.com", "dispostable.com",
    "sharklasers.com", "getairmail.com", "fakemailgenerator.com",
)

# --- fixed values: reserved names (RFC 2606, RFC 6761) ---------------------
RESERVED_TLDS = (
    "test", "example", "invalid", "localhost", "local", "onion", "internal",
    "arpa", "localdomain", "domain", "lan", "home", "corp", "priv", "intranet",
)
RESERVED_DOMAINS = ("example.com", "example.org", "example.net", "example.edu")

# --- fixed values: consumer mail providers ---------------------------------
FREEMAIL_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "ymail.com", "rocketmail.com",
    "hotmail.com", "outlook.com", "live.com", "msn.com", "aol.com", "aim.com",
    "icloud.com", "me.com", "mac.com", "proton.me", "protonmail.com", "zoho.com",
    "mail.com", "gmx.com", "gmx.net", "yandex.com", "yandex.ru", "tutanota.com",
    "tuta.io", "fastmail.com", "hushmail.com", "inbox.com", "lycos.com",
)

# --- fixed values: providers that make an address "Personal" ---------------
PERSONAL_PROVIDERS = (
    "gmail.com", "googlemail.com", "yahoo.com", "hotmail.com",
    "outlook.com", "live.com", "icloud.com", "me.com", "aol.com",
    "protonmail.com", "proton.me", "zoho.com", "mail.com", "gmx.com",
)

# --- fixed values: spam-trap mailbox names ---------------------------------
SPAM_TRAPS = (
    "spam", "spamtrap", "trap", "abuse", "postmaster", "nospam", "honeypot",
    "dontsend", "junk", "sinkhole", "blackhole", "fake", "testuser", "root",
)

# --- fixed values: typo targets, first match wins --------------------------
POPULAR_DOMAINS = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com",
    "aol.com", "proton.me", "protonmail.com", "zoho.com", "mail.com", "live.com", "msn.com",
    "cloudflare.com", "google.com", "microsoft.com", "apple.com", "ymail.com",
)

# --- fixed values: known misspellings --------------------------------------
TYPO_DOMAINS = {
    "gmial.com": "gmail.com", "gamil.com": "gmail.com", "gmaill.com": "gmail.com", "gmai.com": "gmail.com",
    "yaho.com": "yahoo.com", "yahooo.com": "yahoo.com", "hotmial.com": "hotmail.com", "hotmai.com": "hotmail.com",
    "outlok.com": "outlook.com", "outloo.com": "outlook.com", "iclud.com": "icloud.com",
}

# --- fixed values: owners of mail networks (key, isp, asn, country, city) --
MX_NETWORKS = (
    ("google.com", "Google LLC", "AS15169", "United States", "Mountain View"),
    ("googlemail.com", "Google LLC", "AS15169", "United States", "Mountain View"),
    ("l.google.com", "Google LLC", "AS15169", "United States", "Mountain View"),
    ("outlook.com", "Microsoft Corporation", "AS8075", "United States", "Redmond"),
    ("protection.outlook.com", "Microsoft Corporation", "AS8075", "United States", "Redmond"),
    ("pphosted.com", "Proofpoint Inc.", "AS33070", "United States", "Sunnyvale"),
    ("mimecast.com", "Mimecast Services Ltd", "AS31493", "United Kingdom", "London"),
    ("barracudanetworks.com", "Barracuda Networks Inc.", "AS22201", "United States", "Campbell"),
    ("zoho.com", "Zoho Corporation", "AS2639", "United States", "Pleasanton"),
    ("amazonaws.com", "Amazon.com Inc.", "AS16509", "United States", "Seattle"),
    ("cloudflare.net", "Cloudflare Inc.", "AS13335", "United States", "San Francisco"),
    ("secureserver.net", "GoDaddy Operating Co.", "AS26496", "United States", "Tempe"),
    ("ovh.net", "OVH SAS", "AS16276", "France", "Roubaix"),
    ("protonmail.ch", "Proton Technologies AG", "AS62371", "Switzerland", "Geneva"),
    ("apple.com", "Apple Inc.", "AS714", "United States", "Cupertino"),
)

# --- fixed values: provider by any MX host (substrings, provider, catch-all)
PROVIDERS_ANY_HOST = (
    (("pphosted.com", "proofpoint"), "Proofpoint Enterprise Gateway", True),
    (("mimecast.com",), "Mimecast Gateway", True),
    (("barracudanetworks.com", "barracuda"), "Barracuda Sentinel", True),
    (("ironport", "iphmx.com"), "Cisco IronPort Gateway", True),
    (("tmes.trendmicro.com", "trendmicro"), "Trend Micro Email Security", True),
    (("google.com", "googlemail.com", "aspmx.l.google.com"), "Google Workspace", False),
    (("outlook.com", "protection.outlook.com", "lync.com"), "Microsoft 365 / Exchange", False),
    (("zoho.com", "zoho.eu"), "Zoho Mail", False),
    (("amazonaws.com", "awses"), "Amazon SES", False),
    (("secureserver.net",), "GoDaddy / Secureserver", False),
    (("ovh.net",), "OVHcloud Mail", False),
    (("protonmail.ch", "proton.me"), "ProtonMail", False),
    (("fastmail.com",), "Fastmail", False),
    (("yahoodns.net",), "Yahoo Mail", False),
    (("icloud.com", "apple.com"), "Apple iCloud Mail", False),
)
PROVIDER_ANY_HOST_DEFAULT = "Custom / Self-Hosted Server"

# --- fixed values: provider by the primary MX host -------------------------
PROVIDERS_PRIMARY_HOST = (
    (("google.com", "googlemail.com", "l.google.com"), "Google Workspace", False),
    (("outlook.com", "protection.outlook.com"), "Microsoft 365 / Exchange", False),
    (("pphosted.com", "proofpoint"), "Proofpoint Enterprise Gateway", True),
    (("mimecast.com",), "Mimecast Secure Email Gateway", True),
    (("barracudanetworks.com", "barracuda"), "Barracuda Sentinel", True),
    (("zoho.com", "zoho.eu"), "Zoho Mail", False),
    (("amazonaws.com",), "Amazon SES", False),
    (("secureserver.net",), "GoDaddy Secureserver", False),
)
PROVIDER_PRIMARY_HOST_DEFAULT = "Custom Mail Server"

# --- fixed values: provider label per deliverability outcome ---------------
LABEL_DISPOSABLE = "Disposable Temporary Mailbox"
LABEL_DISPOSABLE_SIMPLE = "Disposable Mail Service"
LABEL_FAILED_STATIC = "None (Failed Static Validation)"
LABEL_NULL_MX = "RFC 7505 Null MX (Strict No-Mail Policy)"
LABEL_NO_DNS = "None (No MX or A Record Found)"
LABEL_NO_MX = "None (No MX Records Found)"

# --- fixed values: the sixteen static checks (id, title, fatal) ------------
STATIC_CHECKS = (
    ("rfc5321_syntax", "RFC 5321 Envelope Syntax", True),
    ("rfc1035_labels", "RFC 1035 DNS Label Rules", True),
    ("reserved", "Reserved TLDs (RFC 2606/6761)", True),
    ("iana_tld", "Live IANA TLD Feed Registry", True),
    ("disposable", "Disposable Domain Database", True),
    ("role_account", "Role-Account Classification", False),
    ("freemail", "FreeMail Provider Detection", False),
    ("gibberish", "Gibberish & Entropy Scoring", False),
    ("typo", "Levenshtein Typo Correction", False),
    ("local_format", "Local-Part Length & Boundary Rules", True),
    ("local_charset", "Local-Part Character Set Validation", True),
    ("spam_trap", "Blacklist & Spam Trap Cross-Reference", False),
    ("fqdn", "Domain FQDN Syntax Compliance", True),
    ("subdomain_depth", "DNS Subdomain Depth Bounds", False),
    ("punycode", "IDN Punycode Compliance", False),
    ("canonical_form", "Canonical Deduplication Form Normalization", False),
)
# --- fixed values: reason texts ({} marks the value filled in per row) -----
CHECK_REASONS = {
    "rfc5321_syntax": "Must contain exactly one @, no spaces, no consecutive dots, max 254 characters",
    "rfc1035_labels": "Domain labels must be 1-63 chars, alphanumeric, cannot begin or end with hyphens",
    "reserved_domain": "Domain {} is explicitly reserved by RFC 2606 for documentation and testing",
    "reserved_tld": "TLD .{} is reserved for special-use/internal non-routable testing per RFC 2606/6761",
    "iana_tld": "TLD .{} is not a valid global IANA recognized top-level domain",
    "disposable": "Domain identified as temporary, throwaway, or burner inbox service",
    "gibberish": "Local-part exhibits high Shannon randomness ({}) or consonant clusters",
    "typo": "Likely typo for {}",
    "local_format": "Local-part must be 1-64 characters and cannot begin or end with a dot",
    "local_charset": "Contains characters or quote sequencing violating dot-atom rules",
    "spam_trap": "Known spam trap, honeypot, or sinkhole administrative prefix",
    "fqdn": "Raw IPv4 address in domain without MX mapping",
    "subdomain_depth": "Subdomain nesting exceeds 5 levels",
    "punycode": "Malformed internationalized domain punycode",
}

# --- fixed values: job-title patterns, first match wins --------------------
# Written without word boundaries; the caller adds ASCII boundaries.
TITLE_PATTERNS = (
    "Chief Executive Officer",
    "Chief Technology Officer",
    "Chief Operating Officer",
    "Chief Financial Officer",
    r"Vice President(?:\s+of\s+[A-Za-z]+)?",
    "(?:Co-Founder|Founder)",
    "(?:President|Executive Director)",
    r"Head of\s+[A-Za-z]+",
    r"Director(?:\s+of\s+[A-Za-z]+)?",
    "(?:Engineering Lead|Team Lead|Tech Lead)",
    r"Senior\s+[A-Za-z]+\s+Engineer",
    "(?:Software Engineer|Developer|Architect)",
    "(?:Marketing Manager|Product Manager|Project Manager)",
    "(?:Sales Representative|Account Executive)",
    "(?:CEO|CTO|COO|CFO|VP)",
)

# --- fixed values: address patterns ----------------------------------------
# The rules of imported addresses, in linear-time parts.
IMPORT_ADDRESS_CHARS = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9.-]+$"
IMPORT_LABEL = r"^[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?$"
DOT_ATOM_CHARS = r"^[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~.]+$"
DNS_LABEL = r"^[a-z0-9]([a-z0-9\-]*[a-z0-9])?$"

# --- fixed values: social profile links ------------------------------------
LINKEDIN_PATTERN = r"https?://(?:www\.)?linkedin\.com/(?:in|company)/[a-zA-Z0-9._%-]+"
TWITTER_PATTERN = r"https?://(?:www\.)?(?:twitter\.com|x\.com)/[a-zA-Z0-9_]+"
GITHUB_PATTERN = r"https?://(?:www\.)?github\.com/[a-zA-Z0-9._%-]+"

# --- fixed values: redaction patterns (boundaries added by the caller) -----
CARD_PATTERNS = (r"(?:\d{4}[-\s]?){3}\d{4}", r"3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}")
SSN_PATTERN = r"\d{3}-\d{2}-\d{4}"
JWT_PATTERN = r"eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"

# --- fixed values: restricted paths ----------------------------------------
RESTRICTED_PATHS = (
    r"^/(?:wp-admin|admin|administrator|backend|manage|controlpanel)(?:/.*)?$",
    r"^/(?:login|signin|auth|oauth|session|authenticate|sso)(?:/.*)?$",
    r"^/(?:checkout|cart|basket|payment|order|invoice|billing)(?:/.*)?$",
    r"^/(?:user/password|reset-password|forgot-password)(?:/.*)?$",
    r"^/(?:\.git|\.env|\.svn|\.hg|\.well-known/security\.txt|\.aws|\.ssh)(?:/.*)?$",
    r"^/(?:private|internal|confidential|secret|sysadmin)(?:/.*)?$",
)

# --- fixed values: URL normalisation ---------------------------------------
STATIC_ASSET_PATH = (
    r"\.(png|jpg|jpeg|gif|svg|webp|ico|css|js|woff|woff2|ttf|pdf|zip|mp4|webm|avi|mp3|wav|tar|gz|exe)$"
)
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid",
)
PRIORITY_WORDS = ("contact", "about", "team", "staff", "people", "support", "reach", "impressum", "touch")

# --- fixed values: hosts and IPv4 ranges that must not be fetched ----------
METADATA_HOSTS = (
    "metadata.google.internal", "169.254.169.254", "instance-data", "metadata.titus.netflix.com",
)
RESTRICTED_CIDRS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)

# --- fixed values: export fields (key, column, label), default order -------
EXPORT_FIELDS = (
    ("email", "email", "Email"),
    ("name", "name", "Name"),
    ("company", "company", "Company"),
    ("jobTitle", "job_title", "Job Title"),
    ("phone", "phone", "Phone Number"),
    ("type", "type", "Type"),
    ("domain", "domain", "Domain"),
    ("mxStatus", "mx_status", "MX Deliverability"),
    ("provider", "provider", "Mail Provider"),
    ("isCatchAll", "is_catch_all", "Catch-All Risk"),
    ("linkedin", "socials.linkedin", "LinkedIn Profile"),
    ("sourceUrl", "source_url", "Source URL"),
    ("pageTitle", "page_title", "Page Title"),
    ("contextSnippet", "context_snippet", "Context Snippet"),
    ("discoveredAt", "discovered_at", "Discovered At"),
)
DEFAULT_EXPORT_FIELDS = tuple(key for key, _, _ in EXPORT_FIELDS if key != "linkedin")

# --- fixed values: export segments (aliases, file prefix, label) -----------
SEGMENTS = (
    (("clean", "deliverable"), "clean_deliverable_leads", "Clean Deliverable Leads"),
    (("suppression", "bad", "blacklist"), "suppression_blacklist", "Suppression & Bounce Blacklist"),
    (("risky", "catch-all", "catchall"), "catch_all_risky_leads", "Catch-All / Risky Leads"),
    (("all",), "all_discovered_leads", "All Leads"),
)

# --- fixed values: compliance notice ---------------------------------------
COMPLIANCE_DISCLAIMER = (
    "An MX lookup, syntax check, or DNS verification does NOT constitute proof that an individual "
    "mailbox exists, is active, or that its owner consented to marketing outreach or cold communications "
    "under CAN-SPAM, GDPR, CASL, PECR, or applicable data protection regulations."
)
VERIFICATION_TYPE = "deliverability_and_syntax_heuristics_only"

# --- public generic top-level domains --------------------------------------
# Country codes follow a rule (see functions.addresses.tld_is_known); the full
# registry is a parameter, read from the published root-zone list.
GENERIC_TLDS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop",
    "museum", "jobs", "mobi", "travel", "tel", "cat", "asia", "post", "xxx", "arpa",
    "app", "dev", "page", "xyz", "online", "site", "website", "tech", "store", "shop", "blog",
    "cloud", "email", "agency", "company", "solutions", "services", "digital", "media", "news",
    "live", "life", "world", "today", "group", "team", "work", "works", "studio", "design",
    "network", "systems", "software", "support", "center", "academy", "school", "university",
    "college", "health", "care", "clinic", "dental", "doctor", "law", "legal", "attorney",
    "finance", "financial", "money", "bank", "capital", "fund", "ventures", "partners",
    "consulting", "expert", "guru", "club", "social", "community", "foundation", "church",
    "events", "tours", "holiday", "hotel", "restaurant", "bar", "cafe", "kitchen", "recipes",
    "games", "game", "play", "fun", "art", "gallery", "photos", "photography", "video", "film",
    "music", "audio", "fashion", "shoes", "beauty", "fit", "fitness", "yoga", "run", "bike",
    "car", "cars", "auto", "taxi", "energy", "solar", "green", "eco", "farm", "garden", "land",
    "homes", "house", "estate", "properties", "rent", "city", "town", "london", "berlin", "paris",
    "nyc", "tokyo", "africa", "lat", "top", "vip", "win", "link", "click", "space", "zone", "wiki",
    "tools", "directory", "reviews", "careers", "global", "international", "industries", "inc",
    "ltd", "llc", "gmbh", "google", "amazon", "microsoft", "apple", "how", "new", "one", "ing",
)

# --- fixed values: messages of outputs --------------------------------------
MALFORMED_PATH = "Malformed URL path cannot be verified for compliance."
RESTRICTED_PATH = ('Access to restricted/sensitive path "', '" is prohibited under platform compliance policies.')
ROBOTS_SHUT = ("Robots.txt on ", " disallows automated crawling for all agents.")
FETCH_SUCCESS = "Request succeeded"
FETCH_REASONS = {
    401: "Target website requires authentication credentials",
    403: "Target website explicitly denied access (HTTP 403 Forbidden)",
    404: "Page not found (HTTP 404)",
    410: "Resource permanently removed (HTTP 410)",
    429: "Target site rate-limit encountered (HTTP 429 Too Many Requests)",
    503: "Target server is temporarily unavailable or overloaded (HTTP 503)",
}
FETCH_TRANSIENT = ("Transient server error encountered (HTTP ", ")")
FETCH_REJECTED = ("Client request rejected (HTTP ", ")")
FETCH_UNEXPECTED = "Server returned unexpected HTTP "
RECOVERED = "Recovered after server restart; scheduled for retry"
NOT_RECOVERED = "Server restarted while job was in-flight; maximum retries exceeded"
IMPORT_REJECTS = {
    "no_json_email": "No email field found",
    "no_email": "Empty line or email column not found",
    "no_at": 'Missing "@" symbol or empty email',
    "syntax": "Invalid email syntax format",
    "tld": "Invalid or unrecognized Top-Level Domain (TLD)",
}
BATCH_EMPTY_URL = "Empty or invalid URL string"
BATCH_PROTOCOL = "Invalid protocol. Only http: and https: are allowed."
BATCH_REJECTED = "URL rejected: "
BATCH_ABSENT = "Page not in snapshot"
