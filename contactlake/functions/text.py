"""Text expressions: decoding, markup removal, snippets, address extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake import constants as K

# Unicode white space (the set a browser engine trims and matches as \s).
WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_INNER = WS[1:-1]
# The same set as characters: what lies beyond ASCII, and all of it.
_WIDE_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BLANKS = " \t\n\x0b\f\r" + _WIDE_BLANKS

_W = "[A-Za-z0-9_]"
# ASCII word boundaries: Java's \b also counts accented letters as word characters.
WORD_START = f"(?<!{_W})"
WORD_END = f"(?!{_W})"
BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse_ws(c: Column) -> Column:
    """Runs of white space as one blank.

    A class of wide blanks costs many times an ASCII one at every character, so it serves
    only the texts that a plain search finds one in.
    """

    def by_kind(t: Column) -> Column:
        wide = F.contains(t, F.lit(_WIDE_BLANKS[0]))
        for blank in _WIDE_BLANKS[1:]:
            wide = wide | F.contains(t, F.lit(blank))
        return F.when(wide, F.regexp_replace(t, WS + "+", " ")).otherwise(F.regexp_replace(t, r"[\x09-\x0D\x20]+", " "))

    return let(c, by_kind)


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda t: F.when(F.length(t) > 0, t))


# Cheap necessary condition for "user at host dot tld"; starts with a letter, so scans fast.
_SPELLED = rf"at{WS}+[a-z0-9-]+{WS}+dot{WS}"


def may_contain_address(c: Column) -> Column:
    """Necessary condition for an address to appear once the text is decoded.

    One scan that spares texts without any address form the decoding chain: a
    literal @, percent or entity encoding, a bracketed "at", or "x at y dot z".
    """
    return c.contains("@") | c.rlike(
        rf"(?i)%[0-9a-f]{{2}}|&(?:#|commat;|amp;|lt;)|[\(\[{{<]{WS}*at{WS}*[\)\]}}>]|" + _SPELLED
    )


def _percent_decode(c: Column) -> Column:
    # All or nothing: one malformed escape leaves only the two address escapes decoded.
    marker = F.lit("\ufffd")
    whole = let(
        F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))),
        lambda w: F.when(~F.contains(w, marker) | F.contains(c, marker), w),
    )
    partial = F.regexp_replace(F.regexp_replace(c, "%40", "@"), "(?i)%2e", ".")
    return F.when(~F.contains(c, F.lit("%")), c).otherwise(F.coalesce(whole, partial))


def _code_unit(n: Column) -> Column:
    unit = F.lpad(F.hex((n % F.lit(65536)).cast("int")), 4, "0")
    return F.decode(F.unhex(unit), "UTF-16BE")


def _numeric_entities(c: Column, pattern: str, to_number) -> Column:
    """Replace each distinct entity of the text by its character."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    decoded = F.aggregate(
        found,
        c,
        lambda acc, ent: F.replace(acc, ent, F.coalesce(_code_unit(to_number(ent)), ent)),
    )
    return F.when(F.contains(c, F.lit("&#")), decoded).otherwise(c)


def deobfuscate(c: Column) -> Column:
    """Undo percent, entity, bracket and spelled-out address obfuscation."""
    out = _percent_decode(c)
    out = _numeric_entities(
        out,
        r"&#\d+;",
        lambda e: F.regexp_extract(e, r"\d+", 0).try_cast("decimal(38,0)"),
    )
    out = _numeric_entities(
        out,
        r"&#x[0-9a-fA-F]+;",
        # Only the low 16 bits name the character, so the last four digits decide.
        lambda e: F.conv(F.regexp_extract(e, r"([0-9a-fA-F]{1,4});", 1), 16, 10).cast("int"),
    )
    for entity, char in (("commat", "@"), ("period", "."), ("amp", "&"), ("lt", "<"), ("gt", ">")):
        out = F.regexp_replace(out, f"(?i)&{entity};", char)
    # Both rewrites start at blanks or words; a cheap test spares most texts the slow scan.
    bracketed = rf"(?i)[\(\[\{{<]{WS}*(?:at|@|dot|\.){WS}*[\)\]\}}>]"
    # Blank runs and words are tried once, at their start or after the previous match.
    run_start = rf"(?:\G|(?<!{WS}))"
    word_start = r"(?:\G|(?<![a-zA-Z0-9._%+-]))"

    def unbracket(t: Column) -> Column:
        for word, char in ((r"(?:at|@)", "@"), (r"(?:dot|\.)", ".")):
            t = F.regexp_replace(
                t, rf"(?i){run_start}{WS}*+[\(\[\{{<]{WS}*{word}{WS}*[\)\]\}}>]{WS}*", char
            )
        return t

    spelled = (
        rf"(?i){word_start}([.%+-]*+)([a-zA-Z0-9_][a-zA-Z0-9._%+-]*+){WS}++at{WS}++([a-zA-Z0-9-]++){WS}++dot{WS}++"
        rf"([a-zA-Z]{{2,}}){BOUNDARY}"
    )
    out = let(out, lambda t: F.when(t.rlike(bracketed), unbracket(t)).otherwise(t))
    return let(
        out,
        lambda t: F.when(t.rlike("(?i)" + _SPELLED), F.regexp_replace(t, spelled, "$1$2@$3.$4")).otherwise(t),
    )


# Each run of local-part characters is tried once: at its start or right after
# the previous match, which keeps long runs linear.
_ADDRESS = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def find_addresses(c: Column) -> Column:
    """Every address-shaped substring, in reading order (array<string>)."""
    return F.regexp_extract_all(c, F.lit(_ADDRESS), F.lit(0))


def page_title(html: Column) -> Column:
    # A tag ends at the next bracket of either kind, so each start scans its own stretch only.
    raw = F.regexp_extract(html, r"(?i)<title[^<>]*+>([^<]++)</title>", 1)
    return collapse_ws(strip_ws(raw))


def strip_tags(c: Column) -> Column:
    """Every tag as one blank.

    Behind the last closing bracket nothing can be a tag; before it every opening one finds an
    end, so the scan never goes back.
    """

    def split(t: Column) -> Column:
        back = F.position(F.lit(">"), F.reverse(t))
        return let(F.when(back > 0, F.length(t) - back + 1).otherwise(0), lambda n: replace(t, n))

    def replace(t: Column, n: Column) -> Column:
        head = F.regexp_replace(F.substring(t, F.lit(1), n), "<[^>]+>", " ")
        return F.concat(head, F.substring(t, n + 1, F.length(t)))

    return let(c, lambda t: F.when(F.contains(t, F.lit("<")), split(t)).otherwise(t))


def _without_element(c: Column, name: str) -> Column:
    """Elements of one kind, with their content, as one blank; what is never closed stays."""

    def split(t: Column) -> Column:
        return let(F.regexp_extract(t, rf"(?is)^(.*</{name}>)", 1), lambda head: replace(t, head))

    def replace(t: Column, head: Column) -> Column:
        # Up to the last end every start finds one.
        cut = F.regexp_replace(head, rf"(?is)<{name}\b.*?</{name}>", " ")
        return F.concat(cut, F.substring(t, F.length(head) + 1, F.length(t)))

    return let(c, lambda t: F.when(t.rlike(rf"(?i)<{name}\b"), split(t)).otherwise(t))


def strip_markup(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags become one blank."""
    out = strip_tags(_without_element(_without_element(html, "script"), "style"))
    out = F.regexp_replace(out, "(?i)&nbsp;", " ")
    return F.trim(collapse_ws(out))


def snippet(text: Column, needle: Column, radius: int = 50, lowered: Column | None = None, size: Column | None = None) -> Column:
    """Text around the first case-insensitive occurrence; '' when absent.

    ``lowered`` and ``size`` spare many needles of one text its lower case and length.
    """
    size = F.length(text) if size is None else size
    lowered = F.lower(text) if lowered is None else lowered

    def cut(at: Column) -> Column:
        start = F.greatest(F.lit(1), at - F.lit(radius))
        stop = F.least(size, at + F.length(needle) - F.lit(1) + F.lit(radius))
        return F.when(at == 0, F.lit("")).otherwise(
            F.concat(
                F.when(start > 1, F.lit("...")).otherwise(F.lit("")),
                strip_ws(collapse_ws(F.substring(text, start, stop - start + 1))),
                F.when(stop < size, F.lit("...")).otherwise(F.lit("")),
            )
        )

    return let(F.position(F.lower(needle), lowered), cut)


def phones(html: Column) -> Column:
    """Distinct phone numbers of a page: tel: links first, then printed ones."""
    tel = F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)href=["']tel:([^"']+)["']"""), F.lit(1)), strip_ws)
    tel = F.filter(tel, lambda p: F.length(F.regexp_replace(p, r"[^\d+]", "")) >= 7)
    sep = rf"[-.{WS_INNER}]"
    printed = F.transform(
        F.regexp_extract_all(
            html,
            F.lit(rf"(?:\+?\d{{1,3}}{sep}?)?\(?\d{{3}}\)?{sep}?\d{{3}}{sep}?\d{{4}}{WORD_END}"),
            F.lit(0),
        ),
        strip_ws,
    )
    printed = F.filter(printed, lambda p: ~p.startswith("202") & (F.length(p) >= 10))
    return F.array_distinct(F.concat(tel, printed))


def phones_strict(html: Column) -> Column:
    """Phones whose digits are not a cut-out of a longer number."""
    whole = F.transform(
        F.regexp_extract_all(html, F.lit(r"[+(]?\d[\d\-. ()]*"), F.lit(0)), strip_ws
    )
    return let(whole, lambda ws: F.filter(phones(html), lambda p: F.array_contains(ws, p)))


def socials(html: Column) -> Column:
    def first(pattern: str) -> Column:
        return blank_to_null(F.regexp_extract(html, "(?i)" + pattern, 0))

    return F.struct(
        first(K.LINKEDIN_PATTERN).alias("linkedin"),
        first(K.TWITTER_PATTERN).alias("twitter"),
        first(K.GITHUB_PATTERN).alias("github"),
    )


def job_title(text: Column) -> Column:
    """First title pattern found, in priority order; short ones upper-cased."""
    clean = F.regexp_replace(text, r"""(?i)https?://[^\s"'<>]+""", " ")
    clean = collapse_ws(strip_tags(clean))
    # Most texts hold no title word at all: one scan spares them the fifteen.
    any_title = "|".join(f"(?:{p})" for p in K.TITLE_PATTERNS)

    def first_hit(t: Column) -> Column:
        return F.coalesce(
            *[blank_to_null(F.regexp_extract(t, f"(?i){WORD_START}{p}{WORD_END}", 0)) for p in K.TITLE_PATTERNS]
        )

    shout = lambda m: F.when(F.length(m) <= 3, F.upper(m)).otherwise(m)
    return F.when(text.rlike(f"(?i){any_title}"), let(let(clean, first_hit), shout))
