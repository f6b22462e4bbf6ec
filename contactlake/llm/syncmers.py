"""Document fingerprints from closed syncmers.

A window of ``k`` words is an anchor if its smallest inner run of ``s`` words, by
hash, is its first or its last: whether a window is chosen depends on its own
words alone, so two texts choose the same windows wherever they agree, whatever
surrounds them.  With k = 5 and s = 2 half of all windows are anchors and no
more than k - s windows lie between two of them.

``anchors`` gives them with positions.  A fingerprint is the bottom-``size``
sketch of the distinct anchor hashes: texts of up to about twice ``size`` words
are held whole, longer ones estimate the Jaccard likeness with a standard error
of at most 0.5 / sqrt(size).  Texts of fewer than k words have one anchor, their
whole word sequence; texts without words have none, and two such texts are alike.

Scale: all anchor work is within the row.  The chain of documents (each with the
next by descending id) is made from ids alone, by ranges; texts are shuffled
once by key, and of a neighbour only the part that is used moves again.

Nulls: a null text is empty, a null id comes last in the chain.  Rows that
repeat both id and text are one document of the chain and get the same result.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions.text import let
from contactlake.llm.common import Guarded, materialise, whole_text, words
from contactlake.operators.ordering import running

K = 5
S = 2
SIZE = 128


def _anchors_of(ws: Column, k: int, s: int) -> Column:
    """Anchors (pos, hash) of a bound word array with k words or more."""
    inner = k - s + 1
    runs = F.transform(
        F.sequence(F.lit(0), F.size(ws) - s), lambda i: F.xxhash64(*[F.get(ws, i + d) for d in range(s)])
    )

    def chosen(h: Column) -> Column:
        def at_edge(i: Column) -> Column:
            edge = F.least(F.get(h, i), F.get(h, i + inner - 1))
            if inner <= 2:
                return F.lit(True)
            middle = [F.get(h, i + d) for d in range(1, inner - 1)]
            return edge <= (F.least(*middle) if len(middle) > 1 else middle[0])

        # The window's words are covered by every s-th run and the last one.
        cover = sorted({*range(0, inner, s), inner - 1})
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.size(ws) - k), at_edge),
            lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(h, i + d) for d in cover]).alias("hash")),
        )

    return let(runs, chosen)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos, hash>>: the anchors of a text by word position."""
    def of(ws: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(ws).alias("hash")))
        return F.when(F.size(ws) == 0, F.slice(whole, 1, 0)).when(F.size(ws) < k, whole).otherwise(_anchors_of(ws, k, s))

    return let(words(text), of)


def sketch(text: Column, k: int = K, s: int = S, size: int = SIZE) -> Column:
    """array<int>: the smallest distinct anchor hashes, 32 bits each, ascending."""
    short = F.transform(anchors(text, k, s), lambda a: F.shiftright(a["hash"], 32).cast("int"))
    return F.slice(F.sort_array(F.array_distinct(short)), 1, size)


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Jaccard likeness of two sketches, 0 to 1; two empty ones are alike."""
    def of(union: Column) -> Column:
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)
        )

    return let(F.slice(F.sort_array(F.array_union(a, b)), 1, size), of)


def printed(a: Column) -> Column:
    """A sketch as text: eight hex digits per hash."""
    return F.array_join(
        F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""
    )


def anchor_rows(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, hash) of every anchor, for positional matching by joins on the hash."""
    held = Guarded(docs)
    rows = held.rows.select(
        held.col(id_col).alias("__id"), F.explode(anchors(whole_text(held.col(text_col)), k, s)).alias("__a")
    )
    return rows.select(F.col("__id").alias(id_col), F.col("__a.pos").alias("pos"), F.col("__a.hash").alias("hash"))


def half_edits(
    docs: DataFrame, k: int = K, s: int = S, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document with its edited form: the second half replaced by the start of the next document.

    Columns: id, n_chars, edited (text), sketch, edited_sketch, next_sketch.
    """
    held = Guarded(docs)
    text = whole_text(held.col(text_col))
    base = held.rows.select(
        held.col(id_col).alias("__id"), F.coalesce(held.col(id_col).cast("string"), F.lit("")).alias("__key"),
        F.xxhash64(text).alias("__th"), text.alias("__text"),
    )
    # Both uses below read the same columns, so Spark shuffles the texts once.
    full = base.select("__key", "__th", "__text", sketch(F.col("__text"), k, s, size).alias("__sketch"))
    ids = base.groupBy("__key", "__th").agg(
        F.max("__id").alias("id"), F.max(F.floor(F.length("__text") / 2)).cast("int").alias("half")
    ).withColumnsRenamed({"__key": "k", "__th": "t"})
    placed = materialise(running(ids, [], [F.col("id").desc_nulls_last(), F.asc("k"), F.asc("t")], row_number="rn"), "chain")
    total = placed.count()
    # Every document learns whose next it is, and how much of it that one takes.
    before = placed.select(F.col("k").alias("pk"), F.col("t").alias("pt"), F.col("id").alias("pid"), F.col("half").alias("take"), "rn")
    chain = placed.select("k", "t", F.when(F.col("rn") == 1, total).otherwise(F.col("rn") - 1).alias("rn")).join(before, "rn")
    sent = full.join(chain, (full["__key"] == chain["k"]) & (full["__th"] == chain["t"])).select(
        "pk", "pt", "pid", F.substring("__text", F.lit(1), F.col("take")).alias("piece"), F.col("__sketch").alias("next_sketch")
    )
    # Repeated rows send the same piece each; a row receives one of them.
    sent = sent.groupBy("pk", "pt").agg(
        F.first("pid").alias("pid"), F.first("piece").alias("piece"), F.first("next_sketch").alias("next_sketch")
    )
    chars = F.length("__text")
    edited = F.concat(F.substring("__text", F.lit(1), chars - F.floor(chars / 2).cast("int")), F.col("piece"))
    return (
        full.join(sent, (full["__key"] == sent["pk"]) & (full["__th"] == sent["pt"]))
        .select(F.col("pid").alias(id_col), chars.cast("long").alias("n_chars"), edited.alias("edited"),
                F.col("__sketch").alias("sketch"), "next_sketch")
        .withColumn("edited_sketch", sketch(F.col("edited"), k, s, size))
    )
