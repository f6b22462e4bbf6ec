"""Links of a crawl snapshot and their normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.functions import urls as U
from contactlake.functions.text import blank_to_null, let, strip_ws


def resolve(url: Column, base: Column) -> Column:
    """Absolute, crawlable form of a link; null for other schemes and static assets.

    One expression whose steps are bound once each, so a filter on the result
    stays as small as the result itself when it is pushed down.
    """
    pieces = lambda u, side: [U.piece(u, i).alias(f"{side}{i}") for i in (1, 2, 3, 4)]
    blank = lambda c: F.length(c) == 0

    def join(p: Column) -> Column:
        has_scheme, has_auth = ~blank(p["u1"]), ~blank(p["u2"])
        absolute = has_scheme | has_auth
        base_dir = F.regexp_replace(F.when(blank(p["b3"]), "/").otherwise(p["b3"]), "[^/]*$", "")
        path = (
            F.when(absolute | p["u3"].startswith("/"), p["u3"])
            .when(blank(p["u3"]), p["b3"])
            .otherwise(F.concat(base_dir, p["u3"]))
        )
        keeps_query = ~absolute & blank(p["u3"]) & ~p["q"]
        return let(
            F.struct(
                F.lower(F.when(has_scheme, p["u1"]).otherwise(p["b1"])).alias("scheme"),
                F.lower(F.when(absolute, p["u2"]).otherwise(p["b2"])).alias("auth"),
                F.regexp_replace(path, "^(?!/)", "/").alias("path"),
                F.when(keeps_query, p["b4"]).otherwise(p["u4"]).alias("query"),
            ),
            clean,
        )

    def clean(j: Column) -> Column:
        port = F.when(j["scheme"] == "http", F.regexp_replace(j["auth"], ":80$", "")).otherwise(
            F.regexp_replace(j["auth"], ":443$", "")
        )
        return let(
            F.struct(
                j["scheme"].alias("scheme"),
                port.alias("host"),
                let(let(j["path"], U.remove_dot_segments), U.encode_path).alias("path"),
                F.when(F.length(j["query"]) > 0, U.clean_query(j["query"])).otherwise("").alias("query"),
            ),
            compose,
        )

    def compose(c: Column) -> Column:
        ok = c["scheme"].isin("http", "https") & ~blank(c["host"]) & ~F.lower(c["path"]).rlike(K.STATIC_ASSET_PATH)
        query = F.when(F.length(c["query"]) > 0, F.concat(F.lit("?"), c["query"])).otherwise("")
        return F.when(ok, F.concat(c["scheme"], F.lit("://"), c["host"], c["path"], query))

    return let(
        strip_ws(url),
        lambda u: let(F.struct(*pieces(u, "u"), *pieces(base, "b"), F.contains(u, F.lit("?")).alias("q")), join),
    )


def normalise_urls(df: DataFrame, url: str = "href", base: str = "url", out: str = "dst") -> DataFrame:
    """Resolve links against their page, drop fragments and tracking parameters."""
    return df.withColumn(out, resolve(F.col(url), F.col(base)))


# Own patterns: a tag ends at the next bracket of either kind, and its first attribute of the name counts.
_HREF = r"""(?<![\w-])href=["']([^"']+)["']"""
_ANCHOR = rf"(?i)<a\s[^<>]*?{_HREF}"
_CANONICAL = rf"""(?i)<link\s(?=[^<>]*?(?<![\w-])rel=["']canonical["'])[^<>]*?{_HREF}"""


def raw_hrefs(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, href) for every anchor that is not mailto, tel or javascript."""
    hrefs = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(_ANCHOR), F.lit(1)), strip_ws
    )
    wanted = F.array_distinct(
        F.filter(hrefs, lambda h: (F.length(h) > 0) & ~h.rlike("^(?:mailto:|tel:|javascript:)"))
    )
    return pages.select(F.col(url).alias("url"), F.explode_outer(wanted).alias("href")).where(F.col("href").isNotNull())


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): distinct normalised links of each page."""
    links = normalise_urls(raw_hrefs(pages, url, html)).where(F.col("dst").isNotNull())
    return links.select(F.col("url").alias("src"), "dst").distinct()


def canonical_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): declared canonical page, where it differs from the page itself."""
    found = pages.select(
        F.col(url).alias("url"), blank_to_null(F.regexp_extract(F.col(html), _CANONICAL, 1)).alias("href")
    ).where(F.col("href").isNotNull())
    return (
        normalise_urls(found)
        .where(F.col("dst").isNotNull() & (F.col("dst") != F.col("url")))
        .select(F.col("url").alias("src"), "dst")
    )


def contact_priority(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.withColumn("priority", U.is_priority(F.col(url)))
