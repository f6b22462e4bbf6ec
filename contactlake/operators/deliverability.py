"""Deliverability as joins to a DNS snapshot ``dns(domain, rr_type, data[, ord])``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.functions import addresses as A
from contactlake.operators.joins import lookup
from contactlake.operators.rules import first_rule

MX, A_RECORD = 15, 1


def _with_order(dns: DataFrame) -> DataFrame:
    return dns if "ord" in dns.columns else dns.withColumn("ord", F.lit(0))


def parse_mx(dns: DataFrame) -> DataFrame:
    """MX answers as (domain, ord, raw_priority, priority, host)."""
    words = F.split(F.trim("data"), r"\s+")
    raw = F.regexp_extract(F.get(words, F.lit(0)), r"^[+-]?\d+", 0).try_cast("int")
    host = F.lower(F.regexp_replace(F.coalesce(F.get(words, F.lit(1)), F.lit("")), r"\.$", ""))
    return _with_order(dns).where((F.col("rr_type") == MX) & (F.length("data") > 0)).select(
        F.lower(F.trim("domain")).alias("domain"),
        "ord",
        raw.alias("raw_priority"),
        # A missing, unreadable or zero priority counts as ten.
        F.coalesce(F.nullif(raw, F.lit(0)), F.lit(10)).alias("priority"),
        host.alias("host"),
    )


def _addresses(dns: DataFrame) -> DataFrame:
    return (
        _with_order(dns)
        .where((F.col("rr_type") == A_RECORD) & (F.length("data") > 0))
        .groupBy(F.lower(F.trim("domain")).alias("domain"))
        .agg(F.min_by(F.trim("data"), F.struct("ord", "data")).alias("ip"))
    )


def resolve_mx(domains: DataFrame, dns: DataFrame, compat: bool = False) -> DataFrame:
    """Per distinct domain: ordered hosts, primary host, fallback and Null-MX flags.

    ``collect_set`` is bounded: all MX answers of a name fit one DNS message
    (64 KiB), and repeated rows collapse before the shuffle.
    """
    wanted = domains.select("domain").distinct()
    mx = parse_mx(dns)
    usable = F.length("host") > 0
    null_mx = F.lit(False) if compat else F.max((F.col("raw_priority") == 0) & ~usable)
    answers = mx.groupBy("domain").agg(
        F.sort_array(
            F.collect_set(F.when(usable, F.struct("priority", "ord", "host")))
        ).alias("__mx"),
        F.coalesce(null_mx, F.lit(False)).alias("is_null_mx"),
    )
    a = _addresses(dns)
    found = (
        wanted.join(answers, "domain", "left")
        .join(a.withColumnRenamed("ip", "__domain_ip"), "domain", "left")
        .withColumn("has_mx", F.coalesce(F.size("__mx") > 0, F.lit(False)))
        .withColumn("has_a", ~F.col("has_mx") & F.col("__domain_ip").isNotNull())
        .withColumn("is_null_mx", F.coalesce("is_null_mx", F.lit(False)))
    )
    first = F.get("__mx", F.lit(0))
    hosted = found.select(
        "domain", "has_mx", "has_a", "is_null_mx",
        F.when(F.col("has_mx"), F.transform("__mx", lambda m: m["host"])).alias("mx_hosts"),
        F.when(F.col("has_mx"), first["host"]).when(F.col("has_a"), F.col("domain")).alias("hostname"),
        F.when(F.col("has_mx"), first["priority"]).when(F.col("has_a"), F.lit(0)).alias("priority"),
        F.when(F.col("has_a"), F.col("__domain_ip")).alias("__fallback_ip"),
    )
    host_ip = a.select(F.col("domain").alias("hostname"), F.col("ip").alias("__host_ip"))
    return lookup(hosted, host_ip, "hostname").select(
        "domain", "has_mx", "has_a", "is_null_mx", "mx_hosts", "hostname", "priority",
        F.coalesce("__fallback_ip", "__host_ip").alias("ip"),
    )


def _rule_hit(text: Column, keys) -> Column:
    hit = F.lit(False)
    for key in keys:
        hit = hit | F.contains(text, F.lit(key))
    return hit


def fingerprint_provider(
    df: DataFrame, host: str, rules=K.PROVIDERS_PRIMARY_HOST, default: str = K.PROVIDER_PRIMARY_HOST_DEFAULT
) -> DataFrame:
    """First matching substring rule gives provider and catch-all risk.

    ``rules`` is a short fixed list, or a table (ord, pattern, provider, is_catch_all) of any size.
    """
    if isinstance(rules, DataFrame):
        found = first_rule(df.drop("provider", "is_catch_all"), rules, host, ["provider", "is_catch_all"])
        return found.withColumns(
            {"provider": F.coalesce("provider", F.lit(default)), "is_catch_all": F.coalesce("is_catch_all", F.lit(False))}
        )
    text = F.lower(F.col(host))
    provider, risk = None, None
    for keys, name, catch_all in rules:
        hit = _rule_hit(text, keys)
        provider = F.when(hit, name) if provider is None else provider.when(hit, name)
        risk = F.when(hit, F.lit(catch_all)) if risk is None else risk.when(hit, F.lit(catch_all))
    return df.withColumn("provider", provider.otherwise(default)).withColumn("is_catch_all", risk.otherwise(False))


def enrich_asn(df: DataFrame, host: str = "hostname", networks=K.MX_NETWORKS) -> DataFrame:
    """First network key contained in the host gives owner and location, else null.

    ``networks`` is a short fixed list, or a table (ord, pattern, isp, asn, country, city) of any size.
    """
    owner_columns = ["isp", "asn", "country", "city"]
    if isinstance(networks, DataFrame):
        return first_rule(df.drop(*owner_columns), networks, host, owner_columns)
    text = F.lower(F.col(host))
    block = None
    for key, isp, asn, country, city in networks:
        owner = F.struct(
            F.lit(isp).alias("isp"), F.lit(asn).alias("asn"), F.lit(country).alias("country"), F.lit(city).alias("city")
        )
        hit = F.contains(text, F.lit(key))
        block = F.when(hit, owner) if block is None else block.when(hit, owner)
    return df.withColumn("__net", block).select(
        "*", *[F.col(f"__net.{f}").alias(f) for f in owner_columns]
    ).drop("__net")


def mailbox_status(df: DataFrame) -> DataFrame:
    """Status and provider label from static verdict and DNS facts.

    Needs is_disposable, passed, has_mx, has_a, is_null_mx, provider, is_catch_all.
    """
    no_dns = ~F.coalesce("has_mx", F.lit(False)) & ~F.coalesce("has_a", F.lit(False))
    null_mx = F.coalesce("is_null_mx", F.lit(False))
    blocked = F.col("is_disposable") | ~F.col("passed") | null_mx | no_dns
    catch_all = F.coalesce("is_catch_all", F.lit(False))
    return (
        df.withColumn(
            "mailbox_status",
            F.when(F.col("is_disposable"), "disposable")
            .when(blocked, "undeliverable")
            .when(catch_all, "risky")
            .otherwise("deliverable"),
        )
        .withColumn(
            "provider",
            F.when(F.col("is_disposable"), K.LABEL_DISPOSABLE)
            .when(~F.col("passed"), K.LABEL_FAILED_STATIC)
            .when(null_mx, K.LABEL_NULL_MX)
            .when(no_dns, K.LABEL_NO_DNS)
            .otherwise(F.col("provider")),
        )
        .withColumn("is_catch_all", catch_all & ~blocked)
    )


def domain_facts(domains: DataFrame, dns: DataFrame, compat: bool = False) -> DataFrame:
    """M1-M3 once per distinct domain."""
    return enrich_asn(fingerprint_provider(resolve_mx(domains, dns, compat), "hostname"))


def verify_domains(contacts: DataFrame, dns: DataFrame, compat: bool = False) -> DataFrame:
    """Simple verifier: disposable, else MX present, resolved once per domain."""
    c = contacts.withColumn("__d", A.normalise(F.col("domain")))
    answers = (
        _with_order(dns)
        .where((F.col("rr_type") == MX) & (F.length("data") > 0))
        .groupBy(F.lower(F.trim("domain")).alias("__d"))
        .agg(F.sort_array(F.collect_set(F.struct("ord", F.trim("data").alias("data")))).alias("__a"))
        .select("__d", F.transform("__a", lambda x: x["data"]).alias("__records"))
    )
    wanted = c.select("__d").where(~A.is_disposable(F.col("__d"))).distinct()
    named = fingerprint_provider(
        wanted.join(answers, "__d").withColumn("__joined", F.array_join("__records", " ")),
        "__joined", K.PROVIDERS_ANY_HOST, K.PROVIDER_ANY_HOST_DEFAULT,
    ).select("__d", "__records", F.col("provider").alias("__provider"), F.col("is_catch_all").alias("__risk"))
    out = lookup(c, named, "__d")
    disposable, found = A.is_disposable(F.col("__d")), F.col("__records").isNotNull()
    risk = F.coalesce("__risk", F.lit(False))
    status = (
        F.when(disposable, "disposable").when(~found, "undeliverable").when(risk, "risky").otherwise("deliverable")
    )
    label = F.when(disposable, K.LABEL_DISPOSABLE_SIMPLE).when(found, F.col("__provider")).otherwise(K.LABEL_NO_MX)

    def kept(flag: str) -> Column:
        if "validity" in contacts.columns:
            return F.coalesce(F.col(f"validity.{flag}"), F.lit(True))
        return F.lit(True)

    validity = F.struct(
        kept("syntax").alias("syntax"), kept("tld").alias("tld"), disposable.alias("is_disposable"),
        risk.alias("is_catch_all"), label.alias("provider"),
    )
    return (
        out.withColumn("mx_status", status)
        .withColumn("mx_records", F.coalesce("__records", F.array().cast("array<string>")))
        .withColumn("provider", label)
        .withColumn("is_catch_all", risk)
        .withColumn("validity", validity)
        .drop("__d", "__records", "__provider", "__risk")
    )


def verification_view(validated: DataFrame) -> DataFrame:
    """Flat answer per address: status, flags, suggestion, MX block, legal notice."""
    return validated.select(
        "email",
        F.coalesce("canonical_email", "email").alias("canonical_email"),
        F.coalesce("mailbox_status", F.lit("unknown")).alias("mailbox_status"),
        F.struct(
            "is_free_mail", "is_role_account", "is_disposable", "is_gibberish", "is_spam_trap",
            F.coalesce("is_catch_all", F.lit(False)).alias("is_catch_all"),
            F.coalesce("entropy_score", F.lit(0.0)).alias("entropy_score"),
            F.struct("checks_passed", "checks_total", "failed_checks").alias("static_checks"),
        ).alias("intelligence_flags"),
        "typo_suggestion",
        F.struct(
            F.col("mx_enrichment.ip").alias("ip"),
            F.col("mx_enrichment.hostname").alias("hostname"),
            F.col("mx_enrichment.priority").alias("priority"),
            F.coalesce("mx_enrichment.country", F.lit("Unknown")).alias("country"),
            F.coalesce("mx_enrichment.city", F.lit("Unknown")).alias("city"),
            F.coalesce("mx_enrichment.isp", F.lit("Unknown ISP")).alias("isp"),
            F.coalesce("mx_enrichment.asn", F.lit("Unknown")).alias("asn"),
        ).alias("mx_enrichment"),
        F.lit(False).alias("proof_of_mailbox_existence"),
        F.lit(False).alias("outreach_consent_confirmed"),
        F.lit(K.COMPLIANCE_DISCLAIMER).alias("legal_disclaimer"),
        F.lit(K.VERIFICATION_TYPE).alias("verification_type"),
    )
