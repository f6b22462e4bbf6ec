"""Address expressions: parts, classes, canonical form, entropy, typos."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.functions.text import let, strip_ws
from contactlake.functions.tlds import delegated


def normalise(email: Column) -> Column:
    return strip_ws(F.lower(email))


def part(email: Column, index: int) -> Column:
    """Text between the @ signs; '' when there is no such part."""
    return F.coalesce(F.get(F.split(email, "@"), F.lit(index)), F.lit(""))


def domain_of(email: Column) -> Column:
    return strip_ws(F.lower(part(email, 1)))


def last_label(domain: Column) -> Column:
    return F.element_at(F.split(domain, r"\."), -1)


def _among(value: Column, names: Iterable[str]) -> Column:
    """Membership in a set of plain names; one parsed expression, as a thousand literals are slow to build."""
    quoted = ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in sorted(set(names))) or "null"
    found = F.call_function("exists", F.array(value), F.expr(f"x -> x in ({quoted})"))
    return F.coalesce(found, F.lit(False))


def tld_is_known(domain: Column, tlds: Iterable[str] | None = None) -> Column:
    """Is the last label a top-level domain?

    Membership in ``tlds``, by default the delegated names (see ``tlds``).  Only
    where no list is found a rule applies: a generic name of our list, or a
    two-letter country code outside the ranges that ISO 3166-1 keeps for private
    use (AA, QM-QZ, XA-XZ, ZZ).
    """
    label = last_label(domain)
    names = delegated() if tlds is None else tlds
    if names or tlds is not None:
        return _among(label, names)
    country = label.rlike("^[a-z]{2}$") & ~label.rlike("^(?:aa|q[m-z]|x[a-z]|zz)$")
    return country | label.isin(*K.GENERIC_TLDS)


def has_valid_tld(email: Column, tlds: Iterable[str] | None = None) -> Column:
    """Exactly one @, two or more labels, and a last label that is a TLD, not a file type."""
    domain = F.lower(part(email, 1))
    labels = F.split(domain, r"\.")
    known = tld_is_known(domain, tlds)
    if tlds is not None:
        pair = F.concat_ws(".", F.slice(labels, -2, 2))
        known = known | ((F.size(labels) >= 3) & _among(pair, [t for t in tlds if "." in t]))
    return (
        (F.size(F.split(email, "@")) == 2)
        & (F.size(labels) >= 2)
        & ~F.element_at(labels, -1).isin(*K.ASSET_EXTENSIONS)
        & known
    )


_ROLE_PREFIX_RE = "^(?:" + "|".join(K.ROLE_PREFIXES) + ")[._-]"


def is_role_address(email: Column) -> Column:
    user = F.lower(part(email, 0))
    bare = F.regexp_replace(user, "[^a-z0-9]", "")
    return user.isin(*K.ROLE_PREFIXES) | bare.isin(*K.ROLE_PREFIXES) | user.rlike(_ROLE_PREFIX_RE)


def is_disposable(domain: Column) -> Column:
    return F.lower(domain).isin(*K.DISPOSABLE_DOMAINS)


def category(email: Column, domain: Column) -> Column:
    return (
        F.when(is_role_address(email), "General")
        .when(F.lower(domain).isin(*K.PERSONAL_PROVIDERS), "Personal")
        .otherwise("Business")
    )


def _capitalised(words: Column) -> Column:
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))),
        " ",
    )


def infer_name(email: Column) -> Column:
    """john.doe7@x -> 'John Doe'; null when no word of two letters remains."""
    words = F.transform(
        F.split(part(email, 0), r"[._\-+]+"), lambda w: strip_ws(F.regexp_replace(w, r"\d+", ""))
    )
    words = F.filter(words, lambda w: F.length(w) >= 2)
    return F.when(F.contains(email, F.lit("@")) & (F.size(words) > 0), _capitalised(words))


def display_name(email: Column) -> Column:
    """Export variant: digits and short words stay; falls back to the address."""
    words = F.filter(F.split(part(email, 0), r"[._\-+]"), lambda w: F.length(w) > 0)
    return F.when(F.size(words) > 0, _capitalised(words)).otherwise(email)


def canonical(email: Column) -> Column:
    """Lower case, no +tag, Gmail dots removed, googlemail.com unified."""

    def rebuild(parts: Column) -> Column:
        domain = F.get(parts, F.lit(1))
        local = F.regexp_replace(F.get(parts, F.lit(0)), r"^([^+]+)\+.*$", "$1")
        gmail = domain.isin("gmail.com", "googlemail.com")
        return (
            F.when(F.size(parts) != 2, F.array_join(parts, "@"))
            .when(gmail, F.concat(F.replace(local, F.lit("."), F.lit("")), F.lit("@gmail.com")))
            .otherwise(F.concat(local, F.lit("@"), domain))
        )

    return let(F.split(normalise(email), "@"), rebuild)


def round2(x: Column) -> Column:
    """Two decimals, halves up (floor keeps both engines and scales alike)."""
    return F.floor(x * 100 + 0.5) / 100


def entropy(s: Column) -> Column:
    """Shannon entropy per character over 4.5 bits, at most 1, two decimals."""
    n = F.length(s)
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda ch: F.length(ch) > 0))

    shares = F.transform(chars, lambda ch: (n - F.length(F.replace(s, ch, F.lit("")))) / n)
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n == 0, F.lit(0.0)).otherwise(round2(F.least(F.lit(1.0), bits / 4.5)))


def is_dot_atom(local: Column) -> Column:
    """Dot-separated runs of allowed characters, without a repeated group (any length is safe)."""
    return local.rlike(K.DOT_ATOM_CHARS) & ~local.startswith(".") & ~local.endswith(".") & ~local.contains("..")


def has_import_syntax(email: Column) -> Column:
    """Allowed local characters, one @, and two or more well-formed labels."""
    labels = F.split(part(email, 1), r"\.")
    return (
        email.rlike(K.IMPORT_ADDRESS_CHARS)
        & (F.size(labels) >= 2)
        & F.forall(labels, lambda x: x.rlike(K.IMPORT_LABEL))
    )


def is_gibberish(local: Column, entropy_score: Column) -> Column:
    n = F.length(local)
    digits = F.length(F.regexp_replace(local, "[^0-9]", ""))
    return (
        local.rlike(r"(?i)[^aeiouy0-9_\-\.]{5,}")
        | ((entropy_score >= 0.78) & (n >= 8))
        | ((n >= 10) & (digits * 100 >= n * 65))
    )


def lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[key]


def typo_target(domain: Column, compat: bool = False, popular=K.POPULAR_DOMAINS) -> Column:
    """Likely intended domain: known misspelling, else first popular domain in reach.

    Both accepted distances imply lengths that differ by at most one, so most
    rows compare only a few of the fixed targets and no join is needed.
    ``compat`` also offers corrections for domains that are real providers.
    """
    d = strip_ws(F.lower(domain))
    near = [
        F.when(
            # Beyond two edits the distance is -1, and zero means the same name.
            F.length(d).between(len(target) - 1, len(target) + 1) & (F.levenshtein(d, F.lit(target), 2) > 0),
            F.lit(target),
        )
        for target in popular
    ]
    by_distance = F.coalesce(*near)
    if not compat:
        real = sorted(set(popular) | set(K.FREEMAIL_DOMAINS))
        by_distance = F.when(~d.isin(*real), by_distance)
    return F.coalesce(lookup(K.TYPO_DOMAINS, d), by_distance)
