"""Page and text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECT_TITLE = "Direct Text Extraction"


def keep_html(pages: DataFrame) -> DataFrame:
    """Only HTML rows where a content type is known."""
    if "content_type" not in pages.columns:
        return pages
    kind = F.lower("content_type")
    html = F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml"))
    return pages.where(F.col("content_type").isNull() | (F.col("content_type") == "") | html)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawl snapshot: page_id, url, html[, content_type, depth]."""
    return keep_html(spark.read.parquet(path))


def as_snippets(texts: DataFrame, id_col: str, text: str, source: str | None = None, source_name: str = "Manual Input") -> DataFrame:
    """Texts in the shape of pages: page_id, url, html, title."""
    name = F.coalesce(F.col(source), F.lit(source_name)) if source else F.lit(source_name)
    return texts.select(
        F.col(id_col).alias("page_id"), name.alias("url"), F.col(text).alias("html"), F.lit(DIRECT_TITLE).alias("title")
    )


def read_texts(spark: SparkSession, path: str, id_col: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """Raw texts or HTML snippets with a source name."""
    return as_snippets(spark.read.parquet(path), id_col, text, source)


def load_tlds(spark: SparkSession, path: str, limit: int = 20_000) -> list[str]:
    """The published root-zone list, one name per line (# starts a comment).

    The registry has about 1,500 names; a longer file is refused, so the list
    held by the driver stays bounded.
    """
    names = (
        spark.read.text(path)
        .select(F.lower(F.trim("value")).alias("tld"))
        .where((F.length("tld") > 0) & ~F.col("tld").startswith("#"))
        .distinct()
        .limit(limit + 1)
        .collect()
    )
    if len(names) > limit:
        raise ValueError(f"{path} lists more than {limit} top-level domains")
    return sorted(r.tld for r in names)
