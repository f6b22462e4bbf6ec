"""DuckDB SQL fragments used by several registered queries."""

from __future__ import annotations

from contactlake import constants as K
from contactlake.functions.tlds import delegated

WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# fixed values: whole address patterns; the engine tests their linear-time parts (see constants)
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
IMPORT_SYNTAX = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$"
)
DOT_ATOM = r"^[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~]+(\.[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~]+)*$"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def sub(c: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, '{flags}')"


def strip(c: str) -> str:
    return sub(c, f"^{WS}+|{WS}+$", "")


def collapse(c: str) -> str:
    return sub(c, WS + "+", " ")


def deobfuscate(c: str) -> str:
    """Percent, named-entity, bracket and spelled-out forms (no numeric entities)."""
    fallback = sub(sub(c, "%40", "@"), "(?i)%2e", ".")
    bad = "%(?:[^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)"
    out = (
        f"(case when not contains({c}, '%') then {c} when regexp_matches({c}, {lit(bad)}) then {fallback} "
        f"else url_decode({c}) end)"
    )
    for name, char in (("commat", "@"), ("period", "."), ("amp", "&"), ("lt", "<"), ("gt", ">")):
        out = sub(out, f"&{name};", char, "gi")
    for word, char in (("(?:at|@)", "@"), (r"(?:dot|\.)", ".")):
        out = sub(out, rf"{WS}*[\(\[\{{<]{WS}*{word}{WS}*[\)\]\}}>]{WS}*", char, "gi")
    return sub(
        out, rf"\b([a-zA-Z0-9._%+-]+){WS}+at{WS}+([a-zA-Z0-9-]+){WS}+dot{WS}+([a-zA-Z]{{2,}})\b", r"\1@\2.\3", "gi"
    )


def tld_known(label: str) -> str:
    if delegated():
        return f"{label} in {in_list(delegated())}"
    return (
        f"((regexp_matches({label}, '^[a-z]{{2}}$') and not regexp_matches({label}, '^(?:aa|q[m-z]|x[a-z]|zz)$')) "
        f"or {label} in {in_list(K.GENERIC_TLDS)})"
    )


def valid_tld(email: str) -> str:
    domain = f"lower(split_part({email}, '@', 2))"
    last = f"list_extract(string_split({domain}, '.'), -1)"
    return (
        f"(length({email}) - length(replace({email}, '@', '')) = 1 and contains({domain}, '.') "
        f"and {last} not in {in_list(K.ASSET_EXTENSIONS)} and {tld_known(last)})"
    )


def found(c: str) -> str:
    return f"regexp_extract_all({c}, {lit(EMAIL_PATTERN)})"


def valid_emails(c: str) -> str:
    """Distinct valid normalised addresses of an already decoded text."""
    return (
        f"list_distinct(list_transform(list_filter({found(c)}, lambda e: {valid_tld('e')}), lambda e: lower(e)))"
    )


def strip_markup(c: str) -> str:
    out = sub(c, r"(?is)<script\b.*?</script>", " ")
    out = sub(out, r"(?is)<style\b.*?</style>", " ")
    out = sub(out, "<[^>]+>", " ")
    return f"trim({collapse(sub(out, '&nbsp;', ' ', 'gi'))})"


def snippet(text: str, needle: str, radius: int) -> str:
    at = f"strpos(lower({text}), lower({needle}))"
    start = f"greatest(1, {at} - {radius})"
    stop = f"least(length({text}), {at} + length({needle}) - 1 + {radius})"
    body = strip(collapse(f"substring({text}, {start}, {stop} - {start} + 1)"))
    return (
        f"(case when {at} = 0 then '' else concat(case when {start} > 1 then '...' else '' end, {body}, "
        f"case when {stop} < length({text}) then '...' else '' end) end)"
    )


def role(email: str) -> str:
    user = f"lower(split_part({email}, '@', 1))"
    names = in_list(K.ROLE_PREFIXES)
    prefix = "^(?:" + "|".join(K.ROLE_PREFIXES) + ")[._-]"
    return f"({user} in {names} or {sub(user, '[^a-z0-9]', '')} in {names} or regexp_matches({user}, {lit(prefix)}))"


def capitalised(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ')"


def infer_name(email: str) -> str:
    words = (
        f"list_filter(list_transform(regexp_split_to_array(split_part({email}, '@', 1), '[._\\-+]+'), "
        f"lambda w: regexp_replace(w, '\\d+', '', 'g')), lambda w: length(w) >= 2)"
    )
    return f"(case when len({words}) > 0 then {capitalised(words)} end)"


def display_name(email: str) -> str:
    words = f"list_filter(regexp_split_to_array(split_part({email}, '@', 1), '[._\\-+]'), lambda w: length(w) > 0)"
    return f"(case when len({words}) > 0 then {capitalised(words)} else {email} end)"


def canonical(email: str) -> str:
    low = strip(f"lower({email})")
    local = sub(f"split_part({low}, '@', 1)", r"^([^+]+)\+.*$", r"\1")
    gm = f"split_part({low}, '@', 2) in ('gmail.com', 'googlemail.com')"
    return (
        f"(case when length({low}) - length(replace({low}, '@', '')) <> 1 then {low} "
        f"when {gm} then replace({local}, '.', '') || '@gmail.com' else {local} || '@' || split_part({low}, '@', 2) end)"
    )


def entropy(s: str) -> str:
    share = f"((length({s}) - length(replace({s}, ch, ''))) / length({s})::double)"
    bits = f"list_sum(list_transform(list_distinct(string_split({s}, '')), lambda ch: -({share}) * log2({share})))"
    return f"(case when length({s}) = 0 then 0.0 else floor(least(1.0, {bits} / 4.5) * 100 + 0.5) / 100 end)"


def gibberish(s: str, score: str) -> str:
    digits = f"length({sub(s, '[^0-9]', '')})"
    return (
        f"(regexp_matches({s}, '(?i)[^aeiouy0-9_\\-\\.]{{5,}}') or ({score} >= 0.78 and length({s}) >= 8) "
        f"or (length({s}) >= 10 and {digits} * 100 >= length({s}) * 65))"
    )


def typo_target(domain: str) -> str:
    known = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in K.TYPO_DOMAINS.items())
    real = in_list(sorted(set(K.POPULAR_DOMAINS) | set(K.FREEMAIL_DOMAINS)))
    near = " ".join(
        f"when levenshtein({domain}, {lit(t)}) = 1 or (levenshtein({domain}, {lit(t)}) = 2 and abs(length({domain}) - {len(t)}) <= 1) then {lit(t)}"
        for t in K.POPULAR_DOMAINS
    )
    return f"coalesce(case {domain} {known} end, case when {domain} in {real} then null {near} end)"


def title(text: str) -> str:
    clean = collapse(sub(sub(text, r"""https?://[^\s"'<>]+""", " ", "gi"), "<[^>]+>", " "))
    hits = ", ".join(f"nullif(regexp_extract({clean}, {lit('(?i)' + chr(92) + 'b' + p + chr(92) + 'b')}), '')" for p in K.TITLE_PATTERNS)
    return f"(select case when length(t) <= 3 then upper(t) else t end from (select coalesce({hits}) as t))"


def phones(html: str) -> str:
    tel = (
        f"list_filter(list_transform(regexp_extract_all({html}, {lit('(?i)href=[' + chr(34) + chr(39) + ']tel:([^' + chr(34) + chr(39) + ']+)[' + chr(34) + chr(39) + ']')}, 1), "
        f"lambda p: {strip('p')}), lambda p: length({sub('p', '[^0-9+]', '')}) >= 7)"
    )
    sep = r"[-." + WS[1:-1] + "]"
    pattern = rf"(?:\+?\d{{1,3}}{sep}?)?\(?\d{{3}}\)?{sep}?\d{{3}}{sep}?\d{{4}}\b"
    printed = (
        f"list_filter(list_transform(regexp_extract_all({html}, {lit(pattern)}), lambda p: {strip('p')}), "
        f"lambda p: not starts_with(p, '202') and length(p) >= 10)"
    )
    return f"list_concat({tel}, {printed})"
