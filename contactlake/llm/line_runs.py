"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n): the 128-bit hash of a line key and the number
of documents of one batch that hold it, bucketed and sorted by the hash.  A new
batch is counted, merge-anti-joined with the runs (keys that a run has already
decided are not stored again) and added as a run of level 0.  When a level has
``fanout`` runs they are merged into one run of the next level, so every key is
rewritten once per level and the number of runs grows with the logarithm of the
batches.

Runs last: a store is a folder of run folders and numbered manifests.  A
manifest names the runs of every level and the batches that they hold; moving
it into place is the commit.  What a lost driver wrote before that is no part
of the store and is removed when it is opened again; a batch whose name the
manifest holds is not added twice, so a failed call is simply repeated.  One
writer at a time.

Scale: runs keep their bucketing, so a batch is joined with old runs without
shuffling them; lines are counted map-side first, so a line of every document
costs one row per task.  Only hashes move; texts are shuffled once, by document.
The number of buckets is a store's own, taken from the rows of its first batch.

Nulls: a null text is one empty line, as an empty text is; a null id is a value
like another.  Every row counts as one document, also repeated rows.  Lines
without a character after stripping are never dropped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.llm.common import Guarded, ascii_lower, ascii_strip, materialise, shared_path, whole_text
from contactlake.operators.stored import Folder

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 6
FANOUT = 4
BUCKET_ROWS = 4_000_000
KEY = ["h1", "h2"]
_MANIFEST, _RUN, _PART = "manifest-", "line_run_", "part-"
# What else lies in a store's folder is left alone.
_OWN = (_MANIFEST, _RUN, _PART)


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Per line, in order, the 128-bit hash of its key; null where the key is too short."""
    def one(line: Column) -> Column:
        key = ascii_strip(line)
        return F.when(
            F.length(key) >= min_chars,
            F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")),
        )

    return F.transform(F.split(ascii_lower(text), "\n"), one)


class LineRuns:
    """A store of runs in ``path``, opened where it exists, else begun there.

    ``min_docs`` and ``buckets`` are fixed by the first manifest of a store: keys decided for one
    threshold are not counted further, so another threshold needs a store of its own.
    """

    def __init__(
        self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None
    ):
        self.spark, self.path, self.min_docs, self.fanout = spark, path.rstrip("/"), min_docs, fanout
        self.buckets = buckets
        self.folder = Folder(spark, self.path)
        self.version, self.levels, self.batches = 0, [], []
        self._open()

    def _open(self) -> None:
        self.folder.make()
        found = self.folder.names()
        manifests = sorted(name for name in found if name.startswith(_MANIFEST))
        if manifests:
            held = json.loads(self.folder.read(manifests[-1]))
            if held["min_docs"] != self.min_docs:
                raise ValueError(f"{self.path} counts up to {held['min_docs']} documents, not {self.min_docs}")
            self.version = int(manifests[-1].removeprefix(_MANIFEST))
            self.levels, self.batches, self.buckets = held["levels"], held["batches"], held["buckets"]
        kept = {*self.names(), *manifests[-1:]}
        for name in found:
            if name not in kept and name.startswith(_OWN):
                self._remove(name)
        for name in self.names():
            self._register(name)

    def _register(self, name: str) -> None:
        location = self.folder.absolute(name).replace("'", "\\'")
        self.spark.sql(
            f"create table if not exists {name} (h1 bigint, h2 bigint, n bigint) using parquet "
            f"clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{location}'"
        )

    def _remove(self, name: str) -> None:
        if name.startswith(_RUN):
            self.spark.sql(f"drop table if exists {name}")
        self.folder.delete(name)

    def _commit(self, levels: list[list[str]], batches: list[str]) -> None:
        """Write the next manifest and move it into place; runs that it no longer names go afterwards."""
        held = {"min_docs": self.min_docs, "buckets": self.buckets, "levels": levels, "batches": batches}
        before, old = set(self.names()), f"{_MANIFEST}{self.version:012d}"
        part, new = f"{_PART}{uuid.uuid4().hex}", f"{_MANIFEST}{self.version + 1:012d}"
        self.folder.write(part, json.dumps(held))
        self.folder.move(part, new)
        self.levels, self.batches, self.version = levels, batches, self.version + 1
        for name in [*(before - set(self.names())), old]:
            self._remove(name)

    def _write(self, counted: DataFrame, level: int) -> str:
        name = f"{_RUN}{level}_{uuid.uuid4().hex}"
        (
            counted.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", self.folder.absolute(name)).saveAsTable(name)
        )
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        # Read by path: a union of bucketed tables claims their partitioning but does not keep it (Spark 4.1),
        # and counts of one key would stay apart.
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        every = self.spark.read.schema("h1 long, h2 long, n long").parquet(*map(self.folder.absolute, names))
        return every.groupBy(*KEY).agg(F.sum("n").alias("n"))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def undecided(self, lines: DataFrame) -> DataFrame:
        """Rows (h1, h2, ...) whose key no run has decided yet."""
        for name in self.names():
            lines = lines.join(self.spark.table(name).where(F.col("n") >= self.min_docs), KEY, "left_anti")
        return lines

    def add(self, lines: DataFrame, batch: str | None = None) -> bool:
        """Add a batch, one row (h1, h2) per document and distinct key; False if one of that name is held."""
        batch = batch or uuid.uuid4().hex
        if batch in self.batches:
            return False
        if self.buckets is None:
            least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.buckets = max(least, -(-lines.count() // BUCKET_ROWS))
        counted = lines.groupBy(*KEY).agg(F.count("*").alias("n"))
        levels = [list(level) for level in self.levels] or [[]]
        levels[0].append(self._write(self.undecided(counted), 0))
        self._commit(levels, [*self.batches, batch])
        self.compact()
        return True

    def compact(self) -> None:
        """Merge every full level into a run of the next one, a commit each."""
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fanout:
                levels = [list(runs) for runs in self.levels] + [[]]
                levels[level + 1].append(self._write(self._merged(full), level + 1))
                levels[level] = []
                while not levels[-1]:
                    levels.pop()
                self._commit(levels, self.batches)
            level += 1

    def decided(self) -> DataFrame:
        """Keys that are found in at least ``min_docs`` documents."""
        return self._merged(self.names()).where(F.col("n") >= self.min_docs).select(*KEY)

    def drop(self) -> None:
        """Remove the store."""
        for name in self.names():
            self._remove(name)
        self.folder.remove()
        self.levels, self.batches = [], []


def drop_common_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    id_col: str = "doc_id",
    text_col: str = "text",
    store: str | None = None,
    batch: str | None = None,
) -> DataFrame:
    """All rows of ``docs`` plus n_lines, n_dropped and kept_text (the other lines, joined by a newline).

    With a ``store`` (a folder that lasts) the documents are added to it under the name ``batch``, and lines
    that it has counted in earlier calls count too.  Documents whose batch is held already are not counted
    again, only cleaned by what the store knows by now.  Without a store the runs go when they have decided.
    """
    if store and not batch:
        raise ValueError("documents that a store counts need the name of their batch")
    spark = docs.sparkSession
    held = Guarded(docs)
    text = whole_text(held.col(text_col))
    # Rows with the same id and text have the same lines, so both together name a document here.
    keyed = held.rows.select("*", held.col(id_col).alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__th"))
    lines = materialise(
        keyed.select(
            "__id", "__th", line_hashes(F.col("__text"), min_chars).alias("__lines"),
            F.pmod(F.xxhash64("__id", "__th"), F.lit(batches)).cast("int").alias("__batch"),
        ),
        "line-hashes", ["__batch"],
    )
    runs = LineRuns(spark, store or shared_path(spark, "line-runs"), min_docs, fanout)
    for part in range(batches):
        mine = lines.where(F.col("__batch") == part)
        runs.add(
            mine.select(F.explode(F.array_distinct("__lines")).alias("__k")).where(F.col("__k").isNotNull()).select("__k.*"),
            f"{batch or 'all'}/{batches}/{part}",
        )
    common = materialise(runs.decided(), "line-common")
    if not store:
        runs.drop()

    at = (
        lines.select("__id", "__th", F.posexplode("__lines").alias("__pos", "__k"))
        .where(F.col("__k").isNotNull())
        .select("__id", "__th", "__pos", "__k.*")
        .join(common, KEY, "left_semi")
        .groupBy("__id", "__th")
        .agg(F.collect_set("__pos").alias("__drop"))
        .select(F.col("__id").alias("__did"), F.col("__th").alias("__dth"), "__drop")
    )
    joined = keyed.join(at, keyed["__id"].eqNullSafe(at["__did"]) & (keyed["__th"] == at["__dth"]), "left")
    parts = joined.withColumn("__parts", F.split("__text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("__parts"), i)), "\n")
    )
    return held.restore(parts, {
        "n_lines": F.size("__parts").cast("long"),
        "n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long"),
        "kept_text": kept,
    })
