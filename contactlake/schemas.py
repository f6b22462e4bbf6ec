"""Table schemas of the data model, as DDL."""

SOCIALS = "struct<linkedin:string,twitter:string,github:string>"

CONTACTS = (
    "email string, domain string, type string, source_url string, page_title string, context_snippet string, "
    "depth int, discovered_at timestamp, name string, job_title string, phone string, "
    f"socials {SOCIALS}, mx_status string, mx_records array<string>, "
    "validity struct<syntax:boolean,tld:boolean,is_disposable:boolean,is_catch_all:boolean,provider:string>, "
    "provider string, is_catch_all boolean, company string, email_category string, job_id string, tags array<string>, "
    "extraction_method string, context_type string, is_suppressed boolean, suppression_reason string, "
    "import_confidence double, evidence_confidence double, canonical_email string, typo_suggestion string, "
    "entropy_score double, is_gibberish boolean, is_free_mail boolean, is_role_account boolean, is_spam_trap boolean, "
    "checks_passed int, checks_total int, failed_checks array<string>, "
    "mx_enrichment struct<ip:string,hostname:string,priority:int,country:string,city:string,isp:string,asn:string>"
)
PAGES = ("page_id bigint, url string, html string")
TEXTS = ("doc_id bigint, text string, source string")
DNS_SNAPSHOT = ("domain string, rr_type int, data string")
SUPPRESSION = (
    "id string, type string, value string, reason string, added_by string, created_at timestamp, note string"
)
FOLDERS = ("folder_id string, name string, owner_id string, created_at timestamp, updated_at timestamp")
JOBS = (
    "job_id string, owner string, url string, status string, started_at timestamp, ended_at timestamp, "
    "retry_count int, max_retries int, error_message string, is_browser boolean"
)
CRAWL_EVENTS = ("job_id string, seq bigint, event string, data string, ts timestamp")
ROBOTS = ("host string, content string")
SESSION_SUMMARY = (
    "target_url string, pages_visited bigint, emails_found bigint, unique_domains bigint, role_count bigint, "
    "personal_count bigint, duration_ms bigint, started_at timestamp, finished_at timestamp"
)
