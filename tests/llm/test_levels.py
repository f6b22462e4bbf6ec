"""Quality rules: distances from estimates drawn towards language and whole, against brute force; no size decides."""

import math
import random
from collections import defaultdict

import numpy as np
import test_rules

from contactlake.llm import robust_rules as R

SF = "/root/testdata/sf0.001"


def quantile(values, q):
    ordered = sorted(values)
    return ordered[max(math.ceil(q * len(ordered)) - 1, 0)]


def vector(s):
    n = max(s[0], 1)
    return [math.log1p(s[0]), s[1] / n, math.log1p(4 * s[2] / n), math.sqrt(s[3] / n), math.sqrt(s[4] / n)]


def brute_mcd(x, params):
    """Mean and covariance, scaled to a normal law."""
    floor = np.array(list(R.FEATURES.values()))
    middle = np.array([quantile(c, 0.5) for c in x.T])
    spread = np.array([quantile(np.abs(c - m), 0.5) for c, m in zip(x.T, middle, strict=True)])
    z = (x - middle) / np.maximum(1.4826 * spread, floor)
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    signs = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
    tiny, best = np.eye(x.shape[1]) * 0.05**2, None

    def step(d2):
        inside = x[d2 <= quantile(d2, params.core)]
        mean, cov = inside.mean(axis=0), np.atleast_2d(np.cov(inside.T, bias=True))
        held = cov + np.diag(floor**2)
        return mean, cov, np.linalg.slogdet(held)[1], np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(held), x - mean)

    for start in (np.eye(x.shape[1]), np.cov(np.tanh(z).T, bias=True), np.cov(signs.T, bias=True)):
        d2 = np.einsum("ij,jk,ik->i", z, np.linalg.inv(start + tiny), z)
        for _ in range(R.FIRST_STEPS):
            found = step(d2)
            d2 = found[3]
        if best is None or found[2] < best[2] - 1e-9:
            best = found
    return best


def brute_levels(groups, params):
    """Estimates of all keys: each goes on until no key's determinant falls."""
    models = {k: brute_mcd(x, params) for k, x in groups.items()}
    floor = np.array(list(R.FEATURES.values()))
    for _ in range(params.max_steps - R.FIRST_STEPS):
        fell = False
        for k, x in groups.items():
            d2 = models[k][3]
            inside = x[d2 <= quantile(d2, params.core)]
            mean, cov = inside.mean(axis=0), np.atleast_2d(np.cov(inside.T, bias=True))
            held = cov + np.diag(floor**2)
            size = np.linalg.slogdet(held)[1]
            fell |= models[k][2] - size > R.FALL
            models[k] = (mean, cov, size, np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(held), x - mean))
        if not fell:
            break
    factor = R.core_factor(params.core, len(R.FEATURES))
    return {k: (m[0], m[1] * factor) for k, m in models.items()}


def brute_distances(docs, params):
    """Squared distance per row, None for rows that fail the base rules."""
    stats = [test_rules.brute(d[1]) for d in docs]
    fine, coarse = defaultdict(list), defaultdict(list)
    for d, s in zip(docs, stats, strict=True):
        if not s[5]:
            fine["f", d[2], d[3]].append(vector(s))
            coarse["c", d[2]].append(vector(s))
    groups = {k: np.array(v) for k, v in {**fine, **coarse}.items()}
    models = brute_levels(groups, params)
    total = sum(len(groups[k]) for k in coarse)

    def drawn(own, above, n):
        w = n**3 / (n**3 + params.shrink**3)
        return [w * a + (1 - w) * b for a, b in zip(own, above, strict=True)]

    every = [sum(len(groups[k]) * models[k][i] for k in coarse) / max(total, 1) for i in (0, 1)]
    every = drawn(every, (every[0], np.diag(np.array(list(R.PRIOR.values())) ** 2)), total)
    langs = {k: drawn(models[k], every, len(groups[k])) for k in coarse}
    final = {k: drawn(models[k], langs["c", k[1]], len(groups[k])) for k in fine}
    floor = np.array(list(R.FEATURES.values()))
    out = []
    for d, s in zip(docs, stats, strict=True):
        if s[5]:
            out.append(None)
            continue
        mean, cov = final["f", d[2], d[3]]
        y = np.array(vector(s)) - mean
        out.append(y @ np.linalg.inv(cov + np.diag(floor**2)) @ y)
    return out


def test_every_usable_row_gets_its_distance(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    expected = dict(zip([r[0] for r in rows], brute_distances(rows, R.Params()), strict=True))
    got = {r.doc_id: r for r in R.judge(docs).collect()}
    assert set(got) == set(expected)
    cut = R.chi_square_quantile(R.Params().tail, len(R.FEATURES))
    for key, d2 in expected.items():
        if d2 is None:
            assert got[key].outlier_distance is None and not got[key].kept
        else:
            assert math.isclose(got[key].outlier_distance, d2, rel_tol=1e-6, abs_tol=1e-9)
            assert got[key].kept == (d2 <= cut)


def test_distances_follow_the_size_of_a_group_smoothly(make_docs):
    rng = random.Random(7)
    base = [(i, test_rules.prose(rng, rng.randint(60, 300)), "en", "large") for i in range(300)]
    group = [(1000 + i, test_rules.prose(rng, rng.randint(60, 300)), "en", "b") for i in range(101)]
    probe = (5000, " ".join(w + "#" * (i % 9 == 0) for i, w in enumerate(test_rules.prose(rng, 150).split())), "en", "b")
    distances = []
    for n in (5, 99, 100, 101):
        found = R.judge(make_docs([*base, *group[:n], probe])).where("doc_id = 5000").collect()[0]
        distances.append(found.outlier_distance)
    assert max(distances[1:]) - min(distances[1:]) < 0.15 * distances[1]
    assert 0.3 < distances[0] / distances[1] < 3


def test_chi_square():
    # Known quantiles.
    assert math.isclose(R.chi_square_quantile(0.05, 5), 11.0705, rel_tol=1e-5)
    assert math.isclose(R.chi_square_quantile(0.05, 4), 9.48773, rel_tol=1e-5)
    assert 1.3 < R.core_factor(0.75, 5) < 1.5
