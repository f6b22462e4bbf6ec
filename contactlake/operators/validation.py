"""Static address validation: sixteen checks, roll-up, canonical deduplication."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.functions import addresses as A
from contactlake.functions.text import strip_ws
from contactlake.operators.joins import lookup

_CHECKS = [check for check, _, _ in K.STATIC_CHECKS]
_ALWAYS_PASS = {"role_account", "freemail", "canonical_form"}


def _fill(template: str, value: Column) -> Column:
    head, tail = template.split("{}")
    return F.concat(F.lit(head), value, F.lit(tail))


def _plain_number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def validate_static(
    contacts: DataFrame,
    email: str = "email",
    tlds: Iterable[str] | None = None,
    disposable: DataFrame | None = None,
    compat: bool = False,
) -> DataFrame:
    """Add the check, flag, reason and roll-up columns.  Map-only by default.

    ``disposable(domain)`` replaces the built-in list of throw-away domains by
    a table of any size (joined, not collected).
    """
    raw = strip_ws(F.col(email))
    parts = contacts.withColumn("__raw", raw)
    parts = parts.withColumn("__local", strip_ws(F.lower(A.part(F.col("__raw"), 0)))).withColumn(
        "__domain", A.domain_of(F.col("__raw"))
    )
    if disposable is None:
        parts = parts.withColumn("is_disposable", A.is_disposable(F.col("__domain")))
    else:
        listed = disposable.select(A.normalise(F.col("domain")).alias("__domain")).distinct()
        listed = listed.withColumn("__listed", F.lit(True))
        parts = lookup(parts, listed, "__domain").withColumn(
            "is_disposable", F.coalesce(F.col("__listed"), F.lit(False))
        ).drop("__listed")

    r, local, domain = F.col("__raw"), F.col("__local"), F.col("__domain")
    labels = F.split(domain, r"\.")
    tld = F.element_at(labels, -1)
    flagged = parts.select(
        "*",
        A.entropy(local).alias("entropy_score"),
        A.typo_target(domain, compat).alias("__typo"),
        tld.isin(*K.RESERVED_TLDS).alias("__reserved_tld"),
        domain.isin(*K.RESERVED_DOMAINS).alias("__reserved_domain"),
        A.tld_is_known(domain, tlds).alias("__iana"),
        local.isin(*K.ROLE_ACCOUNTS).alias("is_role_account"),
        domain.isin(*K.FREEMAIL_DOMAINS).alias("is_free_mail"),
        local.isin(*K.SPAM_TRAPS).alias("is_spam_trap"),
        A.canonical(r).alias("canonical_email"),
    ).withColumn("is_gibberish", A.is_gibberish(local, F.col("entropy_score")))

    one_at = F.length(r) - F.length(F.replace(r, F.lit("@"), F.lit(""))) == 1
    tests = {
        "rfc5321_syntax": one_at & (F.length(r) <= 254) & ~r.contains(" ") & ~r.contains(".."),
        "rfc1035_labels": (F.size(labels) >= 2)
        & F.forall(labels, lambda x: F.length(x).between(1, 63) & x.rlike("(?i)" + K.DNS_LABEL)),
        "reserved": ~(F.col("__reserved_tld") | F.col("__reserved_domain")),
        "iana_tld": F.col("__iana") & ~F.col("__reserved_tld"),
        "disposable": ~F.col("is_disposable"),
        "role_account": F.lit(True),
        "freemail": F.lit(True),
        "gibberish": ~F.col("is_gibberish"),
        "typo": F.col("__typo").isNull(),
        "local_format": F.length(local).between(1, 64) & ~local.startswith(".") & ~local.endswith("."),
        "local_charset": A.is_dot_atom(local),
        "spam_trap": ~F.col("is_spam_trap"),
        "fqdn": ~domain.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
        "subdomain_depth": F.size(labels) <= 5,
        "punycode": ~domain.contains("xn--") | F.element_at(labels, 1).rlike(r"(?i)^xn--[a-z0-9\-]+$"),
        "canonical_form": F.lit(True),
    }
    checked = flagged.select("*", *[tests[c].alias(f"chk_{c}") for c in _CHECKS])

    text = K.CHECK_REASONS
    reasons = {
        "reserved": F.when(F.col("__reserved_domain"), _fill(text["reserved_domain"], domain)).otherwise(
            _fill(text["reserved_tld"], tld)
        ),
        "iana_tld": F.when(~F.col("__iana"), _fill(text["iana_tld"], tld)),
        "gibberish": _fill(text["gibberish"], _plain_number(F.col("entropy_score"))),
        "typo": _fill(text["typo"], F.col("__typo")),
    }
    with_reasons = checked.select(
        "*",
        *[
            F.when(~F.col(f"chk_{c}"), reasons.get(c, F.lit(text.get(c)))).alias(f"reason_{c}")
            for c in _CHECKS
            if c not in _ALWAYS_PASS
        ],
        F.when(
            F.col("__typo").isNotNull(), F.concat(local, F.lit("@"), F.col("__typo"))
        ).alias("typo_suggestion"),
    )
    return validation_rollup(with_reasons).drop(
        "__raw", "__local", "__domain", "__typo", "__reserved_tld", "__reserved_domain", "__iana"
    )


def validation_rollup(checked: DataFrame) -> DataFrame:
    """Passed count, score, verdict and the list of failed checks in check order."""
    passed = sum((F.col(f"chk_{c}").cast("int") for c in _CHECKS), F.lit(0))
    total = len(_CHECKS)
    failed = [
        F.when(F.col(f"reason_{c}").isNotNull(), F.concat(F.lit(f"{title}: "), F.col(f"reason_{c}")))
        for c, title, _ in K.STATIC_CHECKS
        if c not in _ALWAYS_PASS
    ]
    fatal = [
        F.col(f"reason_{c}").isNotNull() for c, _, is_fatal in K.STATIC_CHECKS if is_fatal
    ]
    any_fatal = fatal[0]
    for f in fatal[1:]:
        any_fatal = any_fatal | f
    return (
        checked.withColumn("checks_passed", passed)
        .withColumn("checks_total", F.lit(total))
        .withColumn("score", F.floor(F.col("checks_passed") * 100 / total + 0.5).cast("int"))
        .withColumn("passed", ~any_fatal)
        .withColumn("failed_checks", F.array_compact(F.array(*failed)))
    )


def dedupe_canonical(contacts: DataFrame, order: str, email: str = "email") -> DataFrame:
    """One row per canonical form: first address, number of rows and of spellings."""
    keyed = contacts.select(A.canonical(F.col(email)).alias("canonical_email"), F.col(email).alias("email"), order)
    # Collapse identical addresses first: a hot form shrinks before its spellings are counted.
    spelled = keyed.groupBy("canonical_email", "email").agg(
        F.count("*").alias("__n"), F.min(order).alias("__first")
    )
    return spelled.groupBy("canonical_email").agg(
        F.min_by("email", F.struct("__first", "email")).alias("kept_email"),
        F.sum("__n").alias("n_rows"),
        F.count("*").alias("n_aliases"),
    )


def fix_domain_typos(contacts: DataFrame) -> DataFrame:
    """Rewrite misspelled domains and send those contacts back to verification."""
    e = F.col("email")
    fix = F.when(F.size(F.split(e, "@")) == 2, A.lookup(K.TYPO_DOMAINS, F.lower(A.part(e, 1))))
    return (
        contacts.withColumn("__fix", fix)
        .withColumn("typo_fixed", F.col("__fix").isNotNull())
        .withColumn("domain", F.coalesce(F.col("__fix"), F.col("domain")))
        .withColumn("mx_status", F.when(F.col("typo_fixed"), "pending").otherwise(F.col("mx_status")))
        .withColumn("email", F.when(F.col("typo_fixed"), F.concat(A.part(e, 0), F.lit("@"), F.col("__fix"))).otherwise(e))
        .drop("__fix")
    )


def validation_summary(validated: DataFrame, status: str = "mx_status") -> DataFrame:
    """One row: totals per status and the share stopped by the static checks."""
    s = F.col(status)
    filtered = F.count_if(F.col("checks_passed") < F.col("checks_total"))
    total = F.count("*")
    return validated.agg(
        total.alias("total"),
        F.count_if(s == "deliverable").alias("deliverable"),
        F.count_if(s == "undeliverable").alias("undeliverable"),
        F.count_if(s == "disposable").alias("disposable"),
        F.count_if(s == "risky").alias("risky"),
        F.count_if(s.isNull() | (s == "pending")).alias("pending"),
        filtered.alias("layer1_filtered"),
        F.when(total > 0, F.format_string("%.1f%%", filtered * 100.0 / total)).alias("layer1_filter_rate"),
    )


# Quality bounds on incoming rows: column kind -> predicate that a good value meets.
MAX_URL, MAX_TEXT, MAX_SUPPRESSION = 2048, 10_000_000, 320


def email_ok(c: Column) -> Column:
    return F.length(c).between(3, 320) & c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def url_ok(c: Column) -> Column:
    return (
        F.length(c).between(1, MAX_URL)
        & ~c.rlike(r"[\x00\r\n\t]")
        & c.rlike(r"(?i)^https?:/*[^\s/?#]+")
    )


def text_ok(c: Column) -> Column:
    return F.length(c).between(1, MAX_TEXT)


def suppression_ok(kind: Column, value: Column) -> Column:
    return kind.isin("email", "domain", "sha256", "md5") & F.length(value).between(1, MAX_SUPPRESSION)


def syntax_filter_records(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, quarantined); the latter name the rules they break."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    marked = df.withColumn("violations", broken)
    good = marked.where(F.size("violations") == 0).drop("violations")
    return good, marked.where(F.size("violations") > 0)
