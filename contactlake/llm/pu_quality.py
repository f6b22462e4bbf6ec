"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; every other training document is
unlabelled, and bad labels are never used.  A small network on text statistics
minimises the non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

by logistic loss; where the second part would fall below zero, a step goes up
along it instead.  The class prior comes from the same two samples: of the sets
{score >= t} of a first positive-against-unlabelled model, the smallest ratio of
unlabelled to positive mass bounds the share of positives and meets it where a
set is pure.

Scale: statistics are built-in expressions over each text, in one pass.  The
network is trained on the driver from bounded samples (``max_positives``,
``max_unlabelled`` rows, chosen by id hash) of eleven numbers a row; scoring
reads those numbers alone, so texts never leave the JVM and nothing is shuffled
but the ids that meet their labels.

Nulls: a null text is empty and is scored like any text; a null id is not
labelled.  Repeated ids are scored row by row; an id with both labels is not a
trusted positive.  Without any positive every score is 0.5.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlake.functions.text import let
from contactlake.llm.common import Guarded, materialise, whole_text, words

FOLDS = 5


@dataclass(frozen=True)
class Params:
    max_positives: int = 5_000
    max_unlabelled: int = 10_000
    hidden: int = 16
    steps: int = 400
    rate: float = 0.01
    decay: float = 0.02
    seed: int = 5


def statistics(text: Column) -> Column:
    """array<double> of text statistics; per-word and per-line ones are shares."""
    def count(pattern: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)

    def by_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("distinct"),
            F.size(F.filter(ws, lambda w, i: w == F.get(ws, i - 1))).alias("again"),
        )

    def by_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).alias("n"), F.size(F.array_distinct(ls)).alias("distinct"))

    def all_of(w: Column, x: Column) -> Column:
        n = F.greatest(w["n"], F.lit(1)).cast("double")
        m = F.greatest(x["n"], F.lit(1)).cast("double")
        chars = F.greatest(F.length(text), F.lit(1)).cast("double")
        return F.array(
            F.log1p(w["n"].cast("double")), F.log1p(F.length(text) / n), F.log1p(count(r"[#*$%&<>@^~=+_\\]++") / n),
            F.log1p(count(r"\|++") / n), F.log1p(count("!++") / n), count(r"\p{Lu}++") / chars, count("[0-9]++") / chars,
            count("[.,;:?]++") / n, w["distinct"] / n, w["again"] / n, (x["n"] - x["distinct"]) / m,
        )

    return let(let(words(text), by_words), lambda w: let(let(lines, by_lines), lambda x: all_of(w, x)))


def logistic(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


class Network:
    """One hidden layer on standardised inputs; trained by Adam from gradients at its output."""

    def __init__(self, x: np.ndarray, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        d = x.shape[1]
        self.parts = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.first = [np.zeros_like(p) for p in self.parts]
        self.second = [np.zeros_like(p) for p in self.parts]
        self.step = 0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.parts[0] + self.parts[1])
        return h, h @ self.parts[2] + self.parts[3][0]

    def descend(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray, rate: float, decay: float) -> None:
        """One Adam step along d(risk)/d(output) per row."""
        back = np.outer(slope, self.parts[2]) * (1 - h * h)
        grads = [z.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]
        self.step += 1
        for i, g in enumerate(grads):
            g = g + (decay * self.parts[i] if i in (0, 2) else 0)
            self.first[i] = 0.9 * self.first[i] + 0.1 * g
            self.second[i] = 0.999 * self.second[i] + 0.001 * g * g
            self.parts[i] = self.parts[i] - rate * (self.first[i] / (1 - 0.9**self.step)) / (
                np.sqrt(self.second[i] / (1 - 0.999**self.step)) + 1e-8
            )

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.forward(self.standard(x))[1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.3) -> float:
    """Smallest ratio of unlabelled to positive mass over sets {score >= t} that hold ``least`` of the positives."""
    edges = np.quantile(positive, np.linspace(0, 1 - least, 101))
    up = np.sort(unlabelled)
    share_u = 1 - np.searchsorted(up, edges) / len(up)
    share_p = 1 - np.searchsorted(np.sort(positive), edges) / len(positive)
    return float(np.clip((share_u / share_p).min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, params: Params) -> tuple[Network, float]:
    """The network and the class prior that it was trained for."""
    x, np_, nu = np.concatenate([positive, unlabelled]), len(positive), len(unlabelled)
    first = Network(x, params.hidden, params.seed)
    z = first.standard(x)
    weight = np.concatenate([np.full(np_, 1 / np_), np.full(nu, 1 / nu)])
    target = np.concatenate([np.ones(np_), np.zeros(nu)])
    for _ in range(params.steps // 2):
        h, g = first.forward(z)
        first.descend(z, h, weight * (logistic(g) - target), params.rate, params.decay)
    g = first.forward(z)[1]
    prior = estimate_prior(g[:np_], g[np_:])

    net = Network(x, params.hidden, params.seed + 1)
    for _ in range(params.steps):
        h, g = net.forward(z)
        s = logistic(g)
        loss_neg = np.logaddexp(0, g)
        gap = loss_neg[np_:].mean() - prior * loss_neg[:np_].mean()
        slope = np.empty(len(x))
        # Slopes of the logistic losses: s - 1 for +1, s for -1.
        if gap >= 0:
            slope[:np_] = prior * ((s[:np_] - 1) - s[:np_]) / np_
            slope[np_:] = s[np_:] / nu
        else:
            slope[:np_] = prior * s[:np_] / np_
            slope[np_:] = -s[np_:] / nu
        net.descend(z, h, slope, params.rate, params.decay)
    return net, prior


def _score(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column("__x").flatten().to_numpy()
        n = batch.num_rows
        score = np.full(n, 0.5) if net is None else net.score(flat.reshape(n, -1))
        keep = [c for c in batch.schema.names if c != "__x"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score)], [*keep, "__score"])


def score_quality(
    docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """(id, held_out, score) per row; rows whose id's CRC-32 is divisible by five are held out of training."""
    held = Guarded(docs)
    key = F.coalesce(held.col(id_col).cast("string"), F.lit(""))
    rows = materialise(
        held.rows.select(
            held.col(id_col).alias("__id"), (F.crc32(key) % FOLDS == 0).alias("__out"),
            statistics(whole_text(held.col(text_col))).alias("__x"),
        ), "quality-statistics",
    )
    good = (
        labels.select(F.col(id_col).alias("__lid"), F.col(label_col).cast("int").alias("__q"))
        .where(F.col("__q").isNotNull() & F.col("__lid").isNotNull())
        .groupBy("__lid").agg(F.min("__q").alias("__q")).where(F.col("__q") == 1)
    )
    train = rows.where(~F.col("__out"))
    positive = train.join(good, train["__id"] == good["__lid"], "left_semi")

    def sample(df: DataFrame, most: int, salt: int) -> np.ndarray:
        n = df.count()
        part = min(1 << 20, int(1.2 * most / max(n, 1) * (1 << 20)) + 1)
        chosen = df.where(F.pmod(F.xxhash64(F.lit(salt), "__id"), F.lit(1 << 20)) < part).select("__id", "__x")
        found = chosen.orderBy(F.xxhash64(F.lit(salt), "__id"), "__id", "__x").limit(most).collect()
        return np.array([r["__x"] for r in found], np.float64)

    p, u = sample(positive, params.max_positives, 1), sample(train, params.max_unlabelled, 2)
    net = fit(p, u, params)[0] if len(p) and len(u) else None
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__x"]).add("__score", "double")
    scored = rows.mapInArrow(partial(_score, net=net), schema)
    return scored.select(F.col("__id").alias(id_col), F.col("__out").alias("held_out"), F.col("__score").alias("score"))
