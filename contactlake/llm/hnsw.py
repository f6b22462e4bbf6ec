"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches.

Rows come in random order, so a layer is a prefix of them: layer 0 has all rows, each
layer above it one in ``M``.  A layer starts from the links of the layer above and
takes the other rows in batches; a batch searches the graph so far, sees its own
members too, keeps neighbours that are closer to the row than to each other (then the
nearest others), and is linked back, where the same choice prunes full lists.
All queries of a batch walk in step, so that a hop is a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

M = 12  # links a new row chooses
WIDTH = 2 * M  # links a row may hold
BUILD_BEAM = 40
TOP = 96  # rows of the highest layer at most
_FAR = np.float32(-2)


@dataclass
class Graph:
    """Unit vectors (float32) and the links of each layer, from the highest to the lowest; -1 is no link."""

    vecs: np.ndarray
    layers: list[np.ndarray]


def layer_sizes(n: int) -> list[int]:
    """Rows of each layer, from the highest to the lowest."""
    sizes = [n]
    while sizes[-1] > TOP:
        sizes.append(-(-sizes[-1] // M))
    return sizes[::-1]


def _sims(vecs: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Similarity of each query (one per row of ids) to its ids; -2 where the id is -1."""
    out = np.matmul(vecs[ids], queries[:, :, None])[:, :, 0]
    out[ids < 0] = _FAR
    return out


def _walk(vecs: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, step: int = 4):
    """(ids, similarities), the best first, of a beam search from ``entry`` (ids per query)."""
    n = len(queries)
    seen = np.zeros((n, len(links)), bool)
    ids = np.full((n, max(beam, entry.shape[1])), -1, np.int32)
    ids[:, : entry.shape[1]] = entry
    sims = _sims(vecs, ids, queries)
    todo = ids >= 0
    here, at = np.nonzero(todo)
    seen[here, ids[here, at]] = True
    live = np.arange(n)
    while len(live):
        picked = todo[live] & (np.cumsum(todo[live], axis=1) <= step)
        live, picked = live[picked.any(axis=1)], picked[picked.any(axis=1)]
        if not len(live):
            break
        todo[live] &= ~picked
        first = np.argsort(~picked, axis=1, kind="stable")[:, :step]
        nodes = np.where(np.take_along_axis(picked, first, 1), np.take_along_axis(ids[live], first, 1), -1)
        near = links[nodes]
        near[nodes < 0] = -1
        near = np.sort(near.reshape(len(live), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[live[:, None], near]] = -1
        rows, cols = np.nonzero(near >= 0)
        seen[live[rows], near[rows, cols]] = True
        s = np.full(near.shape, _FAR)
        s[rows, cols] = np.einsum("ij,ij->i", vecs[near[rows, cols]], queries[live[rows]])
        every = np.concatenate([sims[live], s], axis=1)
        best = np.argpartition(-every, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(every, best, 1), axis=1, kind="stable"), 1)
        sims[live] = np.take_along_axis(every, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, 1)
        todo[live] = np.take_along_axis(np.concatenate([todo[live], near >= 0], axis=1), best, 1)
    return ids, sims


def _descend(graph: Graph, upto: int, queries: np.ndarray) -> np.ndarray:
    """A few entry ids per query for layer ``upto``."""
    entry = np.zeros((len(queries), 1), np.int32)
    for links in graph.layers[:upto]:
        entry = _walk(graph.vecs, links, queries, entry, 4)[0]
    return entry


def _choose(vecs: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` ids per row: those closer to the row than to any chosen before, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    held = vecs[ids]
    mutual = np.matmul(held, held.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, bool)
    rows = np.arange(len(ids))
    for j in range(ids.shape[1]):
        rival = np.where(chosen, mutual[rows, :, j], _FAR).max(axis=1)
        chosen[:, j] = (ids[:, j] >= 0) & (rival < sims[:, j]) & (chosen.sum(axis=1) < most)
    first = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, first, 1)


def _link_back(vecs: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    rows, cols = np.nonzero(chosen >= 0)
    to, of = chosen[rows, cols], new[rows]
    sims = np.einsum("ij,ij->i", vecs[to], vecs[of])
    order = np.lexsort((-sims, to))
    to, of = to[order], of[order]
    nodes, start, count = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(start, count)
    few = rank < WIDTH
    added = np.full((len(nodes), WIDTH), -1, np.int32)
    added[np.repeat(np.arange(len(nodes)), count)[few], rank[few]] = of[few]
    added[(added[:, :, None] == links[nodes][:, None, :]).any(axis=2)] = -1
    both = np.concatenate([links[nodes], added], axis=1)
    both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
    full = (both >= 0).sum(axis=1) > WIDTH
    links[nodes[~full]] = both[~full, :WIDTH]
    for at in range(0, int(full.sum()), 2_048):
        here, ids = nodes[full][at : at + 2_048], both[full][at : at + 2_048]
        links[here] = _choose(vecs, ids, _sims(vecs, ids, vecs[here]), WIDTH)


def build(vecs: np.ndarray) -> Graph:
    """The graph over all rows, which should come in random order."""
    graph = Graph(vecs, [])
    for level, n in enumerate(layer_sizes(len(vecs))):
        links = np.full((n, WIDTH), -1, np.int32)
        done = 0
        if level:
            done = len(graph.layers[-1])
            links[:done] = graph.layers[-1]
        while done < n:
            new = np.arange(done, min(n, done + min(max(done, TOP), 1_024)), dtype=np.int32)
            queries = vecs[new]
            own = queries @ queries.T
            np.fill_diagonal(own, _FAR)
            near = np.argsort(-own, axis=1, kind="stable")[:, : 2 * M]
            ids, sims = new[near], np.take_along_axis(own, near, 1)
            ids[sims <= _FAR] = -1
            if done:
                found = _walk(vecs, links, queries, _descend(graph, level, queries), BUILD_BEAM)
                ids, sims = np.concatenate([ids, found[0]], axis=1), np.concatenate([sims, found[1]], axis=1)
            chosen = _choose(vecs, ids, sims, M)
            links[new, : chosen.shape[1]] = chosen
            _link_back(vecs, links, new, chosen)
            done += len(new)
        graph.layers.append(links)
    return graph


def search(graph: Graph, queries: np.ndarray, beam: int):
    """Yield (first query, ids, similarities) of batches of queries."""
    size = int(np.clip(32_000_000 // max(len(graph.vecs), 1), 64, 1_024))
    last = len(graph.layers) - 1
    for at in range(0, len(queries), size):
        part = queries[at : at + size]
        yield at, *_walk(graph.vecs, graph.layers[last], part, _descend(graph, last, part), beam)


def audited_beam(graph: Graph, least: float, beam: int, recall: float, probes: int = 128) -> int:
    """The beam, widened until probes find their neighbours; 0 if no beam does and only a scan will.

    A probe is a row turned to a similarity of exactly ``least``.  Recall counts the rows
    at ``least`` or more that a scan finds, at most a beam of them for each probe.
    """
    n, width = graph.vecs.shape
    if not n or width < 2:
        return 0
    rng = np.random.default_rng(n)
    held = graph.vecs[rng.choice(n, min(n, probes), replace=False)]
    turn = rng.standard_normal(held.shape)
    turn -= np.einsum("ij,ij->i", turn, held)[:, None] * held
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    queries = ((least + 1e-6) * held + np.sqrt(1 - least * least) * turn).astype(np.float32)
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    there = np.concatenate([(queries[at : at + 32] @ graph.vecs.T >= least - 1e-5).sum(axis=1) for at in range(0, len(queries), 32)])
    while beam < 2 * n:
        got = np.concatenate([(s >= least - 1e-5).sum(axis=1) for _, _, s in search(graph, queries, beam)])
        if np.minimum(got, beam).sum() >= recall * np.minimum(there, beam).sum():
            return beam
        beam *= 2
    return 0
