"""Quality rules: base rules, then robust multivariate outliers per language and source.

Statistic vectors of each text are transformed towards symmetric scales and
compared within a language and source by their Mahalanobis distance from a
minimum-covariance-determinant estimate: the mean and covariance of the share
``core`` of a group's rows whose covariance has the smallest determinant.  The
search is deterministic: three robust starts per group (plain distances of
standardised values, their tanh covariance, their spatial sign covariance), two
concentration steps each, then the start with the smallest determinant goes on until
no group's determinant falls any more (``max_steps`` at most).  The core's covariance is
scaled to that of a normal law, and distances are cut at a chi-square quantile.

No size decides how a group is treated: with n rows, its mean and covariance weigh n^3 / (n^3 + ``shrink``^3)
against those of its language, a language's likewise against those of all rows (the mean of the
languages), and those against a wide prior around their own mean.  The weight is smooth, and its power keeps
a group of a few rows, half of them bad, from setting its own standard.

Scale: texts are read once; what they give is written, and everything after works on eight
numbers per row.  Medians, quantiles and moments are aggregates with map-side partials, so a group
of any size costs one row per task and step; estimates are one row per group, joined to the rows.

Nulls: a null text has no words; a null language or source is a group of its
own.  Rows that fail the base rules are not used for estimates.  Rows that
repeat an id or a text get the same verdict.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions.text import let
from contactlake.llm.common import BLANKS, Guarded, materialise, whole_text, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Params:
    """core: share of a group in the estimate; shrink: rows that weigh as much as the level above;
    tail: chance that a row of a normal law lies beyond the cut."""

    core: float = 0.75
    shrink: float = 100.0
    max_steps: int = 20
    tail: float = 1e-8


# Transformed statistics and the standard deviation (in their own units) that each keeps at least,
# so that a statistic which is constant in clean text does not reject small deviations.
FEATURES = {"log_words": 0.5, "word_length": 0.4, "symbols": 0.1, "dup_lines": 0.1, "repeats": 0.1}
# Standard deviations that are assumed where there are hardly any rows.
PRIOR = {"log_words": 1.5, "word_length": 1.5, "symbols": 0.5, "dup_lines": 0.5, "repeats": 0.5}
FIRST_STEPS = 2
# A fall of the log determinant that counts.
FALL = 1e-3


def chi_square_tail(x: float, p: int) -> float:
    """Chance that a chi-square variable with p degrees of freedom exceeds x."""
    half = x / 2
    if p % 2:
        tail, term, k = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5), 1.5
    else:
        tail, term, k = 0.0, math.exp(-half), 1.0
    for _ in range(p // 2):
        tail += term
        term *= half / k
        k += 1
    return tail


def chi_square_quantile(tail: float, p: int) -> float:
    """The value that a chi-square variable exceeds with chance ``tail``."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, p) > tail else (low, mid)
    return high


def core_factor(core: float, p: int) -> float:
    """What the covariance of the innermost share of a normal law is multiplied by to give that of the law."""
    return core / (1 - chi_square_tail(chi_square_quantile(1 - core, p), p + 2))


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that the text holds twice or more."""
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(ws) - (window - 1)), lambda i: F.xxhash64(F.slice(ws, i, window))
    )

    def covered(h: Column) -> Column:
        # Sorted by hash, equal windows are neighbours; their positions, sorted, cover words.
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def marks(s: Column) -> Column:
            same = F.filter(
                s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])
            )
            return F.sort_array(F.transform(same, lambda e: e["p"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(window)), F.lit(window)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(placed, lambda s: let(marks(s), total))

    return F.when(F.size(ws) < window + 1, F.lit(0).cast("long")).otherwise(
        let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
        )
    )


def text_statistics(rows: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    counted = F.transform(F.array(words(t)), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).alias("r")))
    return rows.select(
        "*", F.get(counted, F.lit(0)).alias("__w"),
        F.length(F.regexp_replace(t, BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
    ).select("*", F.col("__w.n").alias("n_words"), F.col("__w.r").alias("n_repeat_words")).drop("__w")


def _features(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return rows.select(
        "*", F.log1p(F.col("n_words").cast("double")).alias("log_words"), (F.col("word_chars") / n).alias("word_length"),
        F.log1p(F.lit(4.0) * F.col("n_symbols") / n).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / n).alias("dup_lines"), F.sqrt(F.col("n_repeat_words") / n).alias("repeats"),
    )


def _moments(x: list[Column]) -> list[Column]:
    """Mean vector and upper triangle of the covariance, as aggregates."""
    p = len(x)
    return [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)] + [
        F.covar_pop(x[i], x[j]).alias(f"s{i}{j}") for i in range(p) for j in range(i, p)
    ]


def _cholesky(rows: DataFrame, floor: list[float]) -> DataFrame:
    """Replace s.. by the lower factor l.. of the covariance plus floors, and add its log determinant."""
    p = len(floor)
    for j in range(p):
        for i in range(j, p):
            value = F.col(f"s{j}{i}") + (floor[j] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}")
            rows = rows.withColumn(f"l{i}{j}", value)
    return rows.withColumn("logdet", sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(p)), F.lit(0.0))).drop(
        *[f"s{i}{j}" for i in range(p) for j in range(i, p)]
    )


def _distance(rows: DataFrame, x: list[str], name: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution through l.., from m.."""
    for i, c in enumerate(x):
        y = F.col(c) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"__y{k}")
        rows = rows.withColumn(f"__y{i}", y / F.col(f"l{i}{i}"))
    return rows.withColumn(name, sum((F.col(f"__y{i}") * F.col(f"__y{i}") for i in range(len(x))), F.lit(0.0))).drop(
        *[f"__y{i}" for i in range(len(x))]
    )


def _group_key(lang: Column, source: Column | None) -> Column:
    # Null fields are left out of the text, so null and the text "null" differ; the prefix keeps
    # a language apart from its group without a source.
    level = "source" if source is not None else "lang"
    return F.concat(F.lit(level), F.to_json(F.struct(lang.alias("l"), *([source.alias("s")] if source is not None else []))))


def _names(p: int) -> tuple[list[str], list[str]]:
    return [f"m{i}" for i in range(p)], [f"s{i}{j}" for i in range(p) for j in range(i, p)]


def _limits(measured: DataFrame, keys: list[str], core: float) -> DataFrame:
    # Written down, the small side has a known size and is broadcast: the rows themselves are never shuffled.
    return materialise(measured.groupBy(*keys).agg(F.percentile_approx("__d2", core, 10_000).alias("__h")), "mcd-limit")


def _step(measured: DataFrame, keys: list[str], features: dict[str, float], core: float) -> DataFrame:
    """One concentration step: the estimate of each key's rows within the core's distance."""
    x, floor = list(features), list(features.values())
    inside = measured.join(_limits(measured, keys, core), keys).where(F.col("__d2") <= F.col("__h"))
    moments = inside.groupBy(*keys).agg(*_moments([F.col(c) for c in x]))
    scatter = [F.col(n).alias(f"c{n}") for n in _names(len(x))[1]]
    return materialise(_cholesky(moments.select("*", *scatter), floor), "mcd-step")


def mcd(rows: DataFrame, key: str, features: dict[str, float], params: Params) -> DataFrame:
    """(key, n, m.., s..): mean and covariance of the minimum-covariance-determinant estimate of each key's rows."""
    x, floor = list(features), list(features.values())
    middle = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5).alias(f"c_{c}") for c in x])
    middle = materialise(middle, "mcd-median")
    spread = (
        rows.join(middle, key)
        .groupBy(key)
        .agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"c_{c}")), 0.5).alias(f"d_{c}") for c in x])
    )
    scales = materialise(middle.join(spread, key), "mcd-scale")
    scale = {c: F.greatest(1.4826 * F.col(f"d_{c}"), F.lit(f)) for c, f in features.items()}
    z = [((F.col(c) - F.col(f"c_{c}")) / scale[c]).alias(f"z_{c}") for c in x]
    zs = [f"z_{c}" for c in x]
    standard = rows.join(scales, key).select(key, *x, *z)
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in zs), F.lit(0.0)))
    starts = F.array(
        F.struct(F.lit(0).alias("start"), *[F.col(c).alias(c) for c in zs]),
        F.struct(F.lit(1).alias("start"), *[F.tanh(c).alias(c) for c in zs]),
        F.struct(F.lit(2).alias("start"), *[F.when(norm > 0, F.col(c) / norm).otherwise(0.0).alias(c) for c in zs]),
    )
    tripled = materialise(standard.select(key, *x, F.explode(starts).alias("__t")).select(key, *x, "__t.*"), "mcd-rows")
    # The start's scatter, around the median; start 0 uses plain distances.
    first = tripled.groupBy(key, "start").agg(*_moments([F.col(c) for c in zs]))
    p = len(x)
    for i in range(p):
        first = first.withColumn(f"m{i}", F.lit(0.0))
        for j in range(i, p):
            first = first.withColumn(
                f"s{i}{j}", F.when(F.col("start") == 0, F.lit(1.0 if i == j else 0.0)).otherwise(F.col(f"s{i}{j}"))
            )
    estimate = materialise(_cholesky(first, [0.05] * p), "mcd-start")
    both = [key, "start"]
    measured = _distance(tripled.join(scales, key).select(*both, *x, *z).join(estimate, both), zs, "__d2").select(*both, *x, "__d2")
    estimate = _step(measured, both, features, params.core)
    for _ in range(FIRST_STEPS - 1):
        measured = _distance(tripled.select(*both, *x).join(estimate, both), x, "__d2").select(*both, *x, "__d2")
        estimate = _step(measured, both, features, params.core)
    best = estimate.groupBy(key).agg(
        F.min_by(F.struct(*[c for c in estimate.columns if c not in both]), F.struct("logdet", "start")).alias("__b")
    ).select(key, "__b.*")
    for _ in range(params.max_steps - FIRST_STEPS):
        measured = _distance(rows.select(key, *x).join(best, key), x, "__d2").select(key, *x, "__d2")
        after = _step(measured, [key], features, params.core)
        falls = best.select(key, F.col("logdet").alias("__before")).join(after, key).where(F.col("__before") - F.col("logdet") > FALL)
        best, done = after, falls.isEmpty()
        if done:
            break
    means, scatter = _names(p)
    factor = core_factor(params.core, p)
    return best.join(middle.select(key, "n"), key).select(key, "n", *means, *[(F.col(f"c{c}") * factor).alias(c) for c in scatter])


def _shrunk(own: DataFrame, above: DataFrame, on: str | None, shrink: float, p: int) -> DataFrame:
    """Means and covariances of ``own`` drawn towards those of ``above`` (one row, if ``on`` is None)."""
    names = [c for part in _names(p) for c in part]
    upper = above.select(*([F.col(on).alias("__on")] if on else []), *[F.col(c).alias(f"u_{c}") for c in names])
    joined = own.join(upper, own[on] == upper["__on"]) if on else own.crossJoin(F.broadcast(upper))
    cube = F.pow(F.col("n") / shrink, F.lit(3.0))
    weight = cube / (cube + 1)
    return joined.select(
        *[c for c in own.columns if c not in names], *[(weight * F.col(c) + (1 - weight) * F.col(f"u_{c}")).alias(c) for c in names]
    )


def group_estimates(fitted: DataFrame, features: dict[str, float], prior: dict[str, float], params: Params) -> DataFrame:
    """(__fine, m.., l..) for every group of ``fitted`` (__fine, __coarse and the features)."""
    p = len(features)
    means, scatter = _names(p)
    levelled = fitted.select("__fine", "__coarse", F.explode(F.array("__fine", "__coarse")).alias("__key"), *features)
    estimates = materialise(
        mcd(materialise(levelled.select("__key", *features), "rule-rows"), "__key", features, params), "rule-levels"
    )
    groups = materialise(fitted.select("__fine", "__coarse").distinct(), "rule-groups")
    langs = groups.select(F.col("__coarse").alias("__key")).distinct().join(estimates, "__key")
    every = langs.groupBy().agg(
        F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in [*means, *scatter]]
    )
    wide = every.select(
        *means, *[F.lit(list(prior.values())[int(c[1])] ** 2 if c[1] == c[2] else 0.0).alias(c) for c in scatter]
    )
    every = materialise(_shrunk(every, wide, None, params.shrink, p), "rule-all")
    langs = materialise(_shrunk(langs, every, None, params.shrink, p), "rule-langs")
    own = groups.join(estimates, F.col("__fine") == F.col("__key")).drop("__key").withColumnRenamed("__coarse", "__lang_key")
    drawn = _shrunk(own, langs.withColumnRenamed("__key", "__lang_key").drop("n"), "__lang_key", params.shrink, p)
    return materialise(_cholesky(drawn, list(features.values())).drop("n", "__lang_key", "logdet"), "rule-estimates")


def judge(
    docs: DataFrame, params: Params = Params(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all, if None) of all rows plus the base statistics, base_failed, outlier_distance (null if not judged) and kept.

    Rows are written once with what is kept of them, so a short ``keep`` saves writing the texts.
    """
    held = Guarded(docs)
    kept_columns = held.names if keep is None else keep
    rows = held.rows.select(
        *[held.name(c) for c in kept_columns],
        whole_text(held.col(text_col)).alias("__text"), held.col(lang_col).alias("__lang"), held.col(source_col).alias("__source"),
    )
    measured = _features(text_statistics(rows, "__text"))
    measured = measured.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    ).withColumn("__fine", _group_key(F.col("__lang"), F.col("__source"))).withColumn("__coarse", _group_key(F.col("__lang"), None))
    measured = materialise(measured.drop("__text", "__lang", "__source"), "rule-stats")
    fitted = measured.where(~F.col("base_failed")).select("__fine", "__coarse", *FEATURES)
    estimates = group_estimates(fitted, FEATURES, PRIOR, params).withColumnRenamed("__fine", "__f")
    out = _distance(measured.join(estimates, measured["__fine"] == estimates["__f"], "left"), list(FEATURES), "__d2")
    kept = ~F.col("base_failed") & F.coalesce(F.col("__d2") <= chi_square_quantile(params.tail, len(FEATURES)), F.lit(True))
    added = {
        **{c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")},
        "outlier_distance": F.when(~F.col("base_failed"), F.col("__d2")), "kept": kept,
    }
    return out.select(
        *[held.col(c).alias(c) for c in kept_columns if c not in added], *[c.alias(n) for n, c in added.items()]
    )
