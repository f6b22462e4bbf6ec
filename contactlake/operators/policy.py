"""Crawl policy over URL tables: restricted paths, robots rules, URL safety, fetch outcomes, pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.functions import ip as IP
from contactlake.functions import urls as U
from contactlake.functions.redact import safe_filename
from contactlake.functions.text import let, strip_ws
from contactlake.operators.firsts import first_per_key
from contactlake.operators.joins import lookup
from contactlake.operators.ranges import longest_match
from contactlake.operators.ordering import running

DEFAULT_AGENT = "contactlake/1.0"


def restricted_paths(urls: DataFrame, url: str = "url") -> DataFrame:
    """Flag admin, login, checkout, reset, dot-file and private paths; malformed URLs too."""
    u = F.col(url)
    p = F.lower(U.path(u))
    family = F.coalesce(*[F.when(p.rlike(rx), F.lit(i + 1)) for i, rx in enumerate(K.RESTRICTED_PATHS)])
    broken = ~F.coalesce(U.is_wellformed(u), F.lit(False))
    return (
        urls.withColumn("__family", F.when(~broken, family))
        .withColumn("restricted", broken | F.col("__family").isNotNull())
        .withColumn(
            "reason",
            F.when(broken, K.MALFORMED_PATH).when(
                F.col("__family").isNotNull(),
                F.concat(
                    F.lit(K.RESTRICTED_PATH[0]), p, F.lit(K.RESTRICTED_PATH[1]),
                ),
            ),
        )
        .drop("__family")
    )


def robots_rules(robots: DataFrame) -> DataFrame:
    """Groups of robots files: (host, group_no, ua_no, ua, crawl_delay_ms, allow[], disallow[]).

    Lines are windowed per file.  A robots file is one small text (crawlers read
    500 KiB of it), so no window or list grows with the number of hosts or rows.
    """
    files = first_per_key(
        robots.select(F.lower("host").alias("host"), "content"), ["host"], ["content"]
    )
    lines = files.select("host", F.posexplode(F.split("content", "\n")).alias("no", "line")).select(
        "host", "no", strip_ws(F.regexp_replace("line", "#.*$", "")).alias("line")
    ).where(F.contains("line", F.lit(":")))
    fields = lines.select(
        "host", "no",
        strip_ws(F.lower(F.regexp_extract("line", "^([^:]*):", 1))).alias("field"),
        strip_ws(F.regexp_extract("line", "(?s)^[^:]*:(.*)$", 1)).alias("value"),
    ).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    is_ua = F.col("field") == "user-agent"
    is_rule = F.col("field").isin("allow", "disallow") & (F.length("value") > 0)
    by_line = Window.partitionBy("host").orderBy("no")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, -1)
    # An agent line opens a new group when the last agent-or-rule line was a rule.
    last_kind = F.last(F.when(is_ua, F.lit("ua")).when(is_rule, F.lit("rule")), True).over(so_far)
    opens = F.when(is_ua & (last_kind == "rule"), 1).otherwise(0)
    grouped = fields.withColumn("__open", opens).withColumn("group_no", F.sum("__open").over(by_line))
    seconds = F.regexp_extract("value", r"^[+-]?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")

    def patterns(kind: str) -> Column:
        hit = F.when((F.col("field") == kind) & (F.length("value") > 0), F.struct("no", "value"))
        return F.transform(F.sort_array(F.collect_list(hit)), lambda x: x["value"])

    delay = F.when((F.col("field") == "crawl-delay") & (seconds > 0), F.struct("no", seconds.alias("s")))
    groups = grouped.groupBy("host", "group_no").agg(
        patterns("allow").alias("allow"),
        patterns("disallow").alias("disallow"),
        F.max(delay).alias("__delay"),
        F.sort_array(F.collect_list(F.when(is_ua, F.struct("no", F.lower("value").alias("ua"))))).alias("__agents"),
    )
    return groups.select(
        "host", "group_no", F.posexplode("__agents").alias("ua_no", "__a"), "allow", "disallow",
        F.round(F.col("__delay.s") * 1000).cast("bigint").alias("crawl_delay_ms"),
    ).select("host", "group_no", "ua_no", F.col("__a.ua").alias("ua"), "crawl_delay_ms", "allow", "disallow")


def robots_policy(rules: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """The one group per host that applies to ``agent``: first specific, else first '*'."""
    named = (F.col("ua") != "*") & F.contains(F.lit(agent.lower()), F.col("ua"))
    usable = rules.withColumn("__rank", F.when(named, 0).when(F.col("ua") == "*", 1)).where(F.col("__rank").isNotNull())
    return first_per_key(usable, ["host"], ["__rank", "group_no", "ua_no"]).drop("__rank", "group_no", "ua_no")


def closed_hosts(rules: DataFrame) -> DataFrame:
    """Hosts whose rules keep every crawler out, with the reason for a crawl report."""
    shut = rules.where((F.col("ua") == "*") & F.array_contains("disallow", "/")).select("host").distinct()
    return shut.withColumn(
        "reason", F.concat(F.lit(K.ROBOTS_SHUT[0]), "host", F.lit(K.ROBOTS_SHUT[1]))
    )


def pattern_regex(p: Column) -> Column:
    """Robots pattern as an anchored regular expression: * any run, final $ the end."""
    quoted = F.regexp_replace(p, r"[.+?^${}()|\[\]\\]", r"\\$0")
    return F.concat(F.lit("^"), F.regexp_replace(F.replace(quoted, F.lit("*"), F.lit(".*")), r"\\\$$", r"\$"))


def _prepared(patterns: str) -> Column:
    """Patterns with a regular expression only where a plain prefix test does not do."""
    wild = lambda p: p.contains("*") | p.endswith("$")
    return F.transform(patterns, lambda p: F.struct(p.alias("p"), F.when(wild(p), pattern_regex(p)).alias("rx")))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = DEFAULT_AGENT, url: str = "url") -> DataFrame:
    """Add allowed, crawl_delay_ms and blocked_by.  Any allow match wins over disallow."""
    # Patterns are translated once per host, before they meet the URLs.
    policy = robots_policy(rules, agent).withColumnRenamed("host", "__host").withColumnRenamed("ua", "robots_agent")
    policy = policy.withColumn("allow", _prepared("allow")).withColumn("disallow", _prepared("disallow"))
    joined = lookup(
        urls.withColumn("__host", U.host(F.col(url))).withColumn("__pq", U.path_and_query(F.col(url))), policy, "__host"
    )

    def hit(x: Column) -> Column:
        pq = F.col("__pq")
        return (x["p"] == "/") | F.when(x["rx"].isNull(), F.startswith(pq, x["p"])).otherwise(F.regexp_like(pq, x["rx"]))

    allowed = F.coalesce(F.exists("allow", hit), F.lit(False))
    blocked = F.when(~allowed, F.get(F.filter("disallow", hit), F.lit(0))["p"])
    broken = F.length("__host") == 0
    return (
        joined.withColumn("blocked_by", F.when(~broken, blocked))
        .withColumn("allowed", F.col("blocked_by").isNull() & ~(broken & F.col("robots_agent").isNotNull()))
        .drop("__host", "__pq", "allow", "disallow")
    )


def robots_prefix_blocked(urls: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """Simple form: any disallow prefix of a '*' or matching group blocks."""
    # The agent's groups are merged per host; a file's patterns stay a short list.
    mine = rules.where((F.col("ua") == "*") | F.contains(F.col("ua"), F.lit(agent.lower())))
    merged = mine.groupBy("host").agg(F.flatten(F.collect_list("disallow")).alias("__no")).withColumnRenamed("host", "__host")
    joined = lookup(urls.withColumn("__host", U.host(F.col(url))), merged, "__host")
    hit = F.exists("__no", lambda p: (p == "/") | F.startswith(U.path(F.col(url)), p))
    return joined.withColumn("blocked", F.coalesce(hit, F.lit(False))).drop("__host", "__no")


def url_safety(
    urls: DataFrame, resolved: DataFrame | None = None, allow_local: bool = False, compat: bool = False, url: str = "url",
    ranges: DataFrame | None = None,
) -> DataFrame:
    """Add safe and unsafe_reason.  ``resolved(host, ip)`` also judges what hosts resolve to.

    ``ranges(cidr)``, IPv4 or IPv6 and of any number, are restricted beside the fixed ones.
    """
    judged = urls.withColumn("unsafe_reason", _unsafe_reason(F.col(url), allow_local, compat))
    if ranges is not None:
        hosts = judged.withColumn("__ip", IP.bare_host(U.host(strip_ws(F.col(url)))))
        held = ranges.select(F.col("cidr").alias("__cidr"))
        judged = longest_match(hosts, held, "__ip", "__cidr").withColumn(
            "unsafe_reason", F.coalesce("unsafe_reason", F.when(F.col("__cidr").isNotNull(), "restricted_ip"))
        ).drop("__ip", "__cidr")
    if resolved is not None:
        bad = IP.is_restricted(F.col("ip"))
        if ranges is not None:
            # Many hosts share an address: each is judged once; one that is missing is restricted.
            verdicts = longest_match(resolved.select("ip").distinct(), held, "ip", "__cidr")
            resolved = lookup(resolved.select("host", "ip"), verdicts.select("ip", (bad | F.col("__cidr").isNotNull()).alias("__bad")), "ip")
            bad = F.coalesce("__bad", F.lit(True))
        answers = resolved.groupBy(F.lower("host").alias("__host")).agg(F.max(bad).alias("__bad"))
        named = judged.withColumn("__host", IP.bare_host(U.host(strip_ws(F.col(url)))))
        joined = lookup(named, answers, "__host")
        h = F.col("__host")
        is_name = ~h.contains(":") & ~h.rlike(r"^(?:0x)?[0-9a-f.x]*[0-9]$|^localhost$|\.localhost$")
        bad = F.lit(False) if allow_local else F.col("__bad")
        judged = joined.withColumn(
            "unsafe_reason",
            F.when(F.col("unsafe_reason").isNotNull() | ~is_name, F.col("unsafe_reason"))
            .when(F.col("__bad").isNull(), "unresolved")
            .when(bad, "resolves_to_restricted_ip"),
        ).drop("__bad", "__host")
    return judged.withColumn("safe", F.col("unsafe_reason").isNull())


def _unsafe_reason(url: Column, allow_local: bool, compat: bool) -> Column:
    """Why a URL must not be fetched, from its text alone; null when nothing speaks against it."""

    def by_number(h: Column, n: Column) -> Column:
        local = (h == "localhost") | h.endswith(".localhost") | (h == "::1")
        loopback = n.between(0x7F000000, 0x7FFFFFFF)
        metadata = n.between(0xA9FE0000, 0xA9FEFFFF) | (n == 0x646464C8)
        here = F.lit(None).cast("string") if allow_local else None
        return (
            F.when(loopback, here if allow_local else F.lit("loopback"))
            .when(metadata, "metadata_ip")
            .when(n.isNotNull(), F.when(IP.in_ranges(n), "restricted_ip"))
            .when(IP.looks_numeric(h), "malformed_ip")
            .when(local, here if allow_local else F.lit("localhost"))
            .when(IP.restricted_ipv6(h, compat), "restricted_ip")
        )

    def by_host(h: Column) -> Column:
        return (
            F.when((F.length(h) == 0) | h.rlike(r"[\s<>^|%]"), "invalid_url")
            .when(h.isin(*K.METADATA_HOSTS), "metadata_host")
            .otherwise(let(IP.ipv4_number(h), lambda n: by_number(h, n)))
        )

    def by_text(u: Column) -> Column:
        sch = U.scheme(u)
        return (
            F.when(F.length(sch) == 0, "invalid_url")
            .when(~sch.isin("http", "https"), "invalid_protocol")
            .otherwise(
                let(
                    U.authority(u),
                    lambda auth: F.when(auth.contains("@"), "url_credentials").otherwise(
                        let(IP.bare_host(U.host_in(auth)), by_host)
                    ),
                )
            )
        )

    return (
        F.when(F.coalesce(F.length(url), F.lit(0)) == 0, "missing_url")
        .when(url.rlike(r"[\x00\r\n\t]|%00"), "control_characters")
        .otherwise(let(strip_ws(url), by_text))
    )


def safe_filenames(df: DataFrame, col: str = "filename", out: str | None = None, fallback: str = "export.csv") -> DataFrame:
    return df.withColumn(out or col, safe_filename(F.col(col), fallback))


def classify_fetch_log(
    log: DataFrame, now: Column | None = None, base_ms: int = 500, max_ms: int = 10_000
) -> DataFrame:
    """Add category, retryable, reason, retry_after_ms and wait_ms to (status[, retry_after, attempt])."""
    s = F.col("status")
    text = s.cast("string")
    category = (
        F.when(s.between(200, 299), "SUCCESS")
        .when(s.isin(401, 403), "ACCESS_RESTRICTED")
        .when(s.isin(404, 410), "NOT_FOUND")
        .when(s.isin(429, 503), "RATE_LIMITED")
        .when(s.isin(500, 502, 504, 408), "TRANSIENT_SERVER_ERROR")
        .when(s.between(400, 499), "CLIENT_ERROR")
        .otherwise("TRANSIENT_SERVER_ERROR")
    )
    def around(words: tuple[str, str]) -> Column:
        return F.concat(F.lit(words[0]), text, F.lit(words[1]))

    reason = F.when(s.between(200, 299), K.FETCH_SUCCESS)
    for code, words in K.FETCH_REASONS.items():
        reason = reason.when(s == code, words)
    reason = (
        reason.when(s.isin(500, 502, 504, 408), around(K.FETCH_TRANSIENT))
        .when(s.between(400, 499), around(K.FETCH_REJECTED))
        .otherwise(F.concat(F.lit(K.FETCH_UNEXPECTED), text))
    )
    out = log.withColumn("category", category).withColumn("reason", reason)
    retryable = F.col("category").isin("RATE_LIMITED", "TRANSIENT_SERVER_ERROR")
    out = out.withColumn("retryable", retryable)
    if "retry_after" in log.columns:
        header = F.trim("retry_after")
        at = F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
        clock = now if now is not None else F.current_timestamp()
        hinted = F.when(header.rlike(r"^\d+$"), header.try_cast("bigint") * 1000).when(
            header.rlike(r"(?i)^[a-z]{3},? .*GMT$"), F.greatest(F.lit(0), F.unix_millis(at) - F.unix_millis(clock))
        )
        kept = retryable & s.isin(429, 503, 500, 502, 504, 408)
        out = out.withColumn("retry_after_ms", F.when(kept, hinted))
    else:
        out = out.withColumn("retry_after_ms", F.lit(None).cast("bigint"))
    attempt = F.col("attempt") if "attempt" in log.columns else F.lit(1)
    backoff = F.least(F.lit(float(max_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt)).cast("bigint")
    # A zero hint counts as none.
    return out.withColumn("wait_ms", F.when(retryable, F.coalesce(F.nullif("retry_after_ms", F.lit(0)), backoff)))


def polite_schedule(
    urls: DataFrame, host: str = "host", arrival_ms: str = "arrival_ms", id_col: str = "url",
    delay_ms: int = 0, min_delay_ms: int = 250,
) -> DataFrame:
    """Earliest start per URL with at least the delay between requests to one host."""
    d = max(delay_ms, min_delay_ms)
    # start(i) = i*d + max over j <= i of (arrival(j) - j*d), i the slot within the host.
    out = running(
        urls, [host], [F.col(arrival_ms), F.col(id_col)], row_number="slot",
        maxima={"lead_ms": F.col(arrival_ms) - F.col("slot") * d},
    )
    return out.withColumn("start_ms", F.col("lead_ms") + F.col("slot") * d).drop("lead_ms")
