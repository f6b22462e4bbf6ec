"""Redaction and masking expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.functions.text import WORD_END, WORD_START, WS, WS_INNER, blank_to_null, collapse_ws, let, strip_tags, strip_ws

CARD, SSN = "[REDACTED_CARD]", "[REDACTED_SSN]"
SECRET, TOKEN = "[REDACTED_SECRET]", "[REDACTED_TOKEN]"


# A run of token characters is looked at once, from its start: what follows the run decides for
# every start inside it.
_RUN = "[a-zA-Z0-9_-]"
_TOKEN = rf"(?<!{_RUN})(?={_RUN}++\.eyJ{_RUN}{{10,}}\.{_RUN}{{10,}})({_RUN}*?){WORD_START}{K.JWT_PATTERN}{WORD_END}"


def redact_pii(c: Column) -> Column:
    """Cards, social security numbers, inline passwords, JSON web tokens, in this order."""
    # Each pattern is led by a class of the characters it may start with, which rules out most places at once.
    cards = rf"(?=\d){WORD_START}(?:{'|'.join(f'(?:{p}){WORD_END}' for p in K.CARD_PATTERNS)})"
    out = F.regexp_replace(c, cards, CARD)
    out = F.regexp_replace(out, rf"(?=\d){WORD_START}{K.SSN_PATTERN}{WORD_END}", SSN)
    out = F.regexp_replace(
        out,
        rf"""(?i)(?=[ps])((?:password|passwd|pwd|secret){WS}*[:=]{WS}*["']?)[^{WS_INNER}"';,]+""",
        "$1" + SECRET,
    )
    return let(out, lambda t: F.when(F.contains(t, F.lit(".eyJ")), F.regexp_replace(t, _TOKEN, "$1" + TOKEN)).otherwise(t))


def clean_snippet(c: Column, max_chars: int | None = 150, redact: bool = True) -> Column:
    out = collapse_ws(strip_tags(strip_ws(c)))
    if redact:
        out = redact_pii(out)
    if max_chars is None:
        return blank_to_null(out)
    cut = lambda t: F.concat(strip_ws(F.substring(t, 1, max_chars)), F.lit("..."))
    return blank_to_null(let(out, lambda t: F.when(F.length(t) > max_chars, cut(t)).otherwise(t)))


def mask_email(c: Column) -> Column:
    """j***e@host; '*@host' for local parts of one or two characters."""
    trimmed = strip_ws(c)
    parts = F.split(trimmed, "@")
    local, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    masked = F.when(F.length(local) <= 2, F.concat(F.lit("*@"), domain)).otherwise(
        F.concat(F.substring(local, 1, 1), F.lit("***"), F.substring(local, -1, 1), F.lit("@"), domain)
    )
    return (
        F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "")
        .when(F.size(parts) != 2, "[INVALID_EMAIL]")
        .otherwise(masked)
    )


_LOCAL = "[a-zA-Z0-9_.+-]"
_HOST = r"(@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)"
_START = rf"(?:\G|(?<!{_LOCAL}))"


def redact_log(c: Column) -> Column:
    """Secrets, then addresses, then line breaks of a log message."""
    out = F.regexp_replace(c, rf"(?i)bearer{WS}+[a-zA-Z0-9\-._~+/]+=*", "Bearer " + TOKEN)
    out = F.regexp_replace(
        out,
        rf"""(?i)((?:api[-_]?key|token|secret)["']?{WS}*[:=]{WS}*["']?)[a-zA-Z0-9_-]{{16,}}""",
        "$1" + SECRET,
    )
    # Short local parts first: their mask holds no character a longer one could start with.
    out = F.regexp_replace(out, rf"{_START}{_LOCAL}{{1,2}}{_HOST}", r"*$1")
    out = F.regexp_replace(out, rf"{_START}({_LOCAL}){_LOCAL}+({_LOCAL}){_HOST}", r"$1***$2$3")
    return F.regexp_replace(out, r"[\r\n]+", " ")


def plain_log(c: Column) -> Column:
    """Log text without line breaks and control characters."""
    out = F.regexp_replace(c, r"[\r\n\t]", " ")
    return strip_ws(F.coalesce(F.regexp_replace(out, r"[\x00-\x1F\x{7F}-\x{9F}]", ""), F.lit("")))


def safe_filename(c: Column, fallback: str = "export.csv") -> Column:
    """File name without control, traversal or reserved characters, at most 128 long."""
    out = F.regexp_replace(c, r"[\x00\r\n\t]", "")
    out = F.regexp_replace(out, r"\.{2,}", ".")
    out = strip_ws(F.regexp_replace(out, r"""[<>:"/\\|?*]""", "_"))
    out = F.regexp_replace(out, r"^[./\\]+", "")

    def shorten(name: Column) -> Column:
        ext = F.regexp_extract(name, r"(?s)^.+?(\.[^.]*)$", 1)
        keep = (F.length(ext) > 0) & (F.length(ext) < 10)
        return F.when(
            keep, F.concat(F.substr(name, F.lit(1), F.lit(128) - F.length(ext)), ext)
        ).otherwise(F.substring(name, 1, 128))

    return let(
        out,
        lambda n: F.when(F.coalesce(F.length(n), F.lit(0)) == 0, fallback).when(F.length(n) > 128, shorten(n)).otherwise(n),
    )


def csv_guard(c: Column) -> Column:
    """Prefix a quote to text a spreadsheet would read as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
