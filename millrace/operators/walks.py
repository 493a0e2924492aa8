"""Walks and pruning over one part's graph, for many queries or nodes at a time. A graph is a row of links for each node, padded with -1.

A batch's arrays have at most BATCH rows and CELLS marks, whatever the part's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Rows of a batch, marks of its queries at its nodes, open nodes that each query visits in one step, and rows that are pruned at a time.
BATCH, CELLS, STEP, PRUNED = 512, 1 << 23, 4, 1024
#: Candidates of one node that pruning looks at, the nearest ones.
MOST = 128
PAD = np.iinfo(np.int64).max


def batches(n: int, nodes: int, start: int = BATCH) -> Iterator[tuple[int, int]]:
    """The ends of batches of n rows over a graph of so many nodes; the first has ``start`` rows, and each at most as many as lie before it."""
    most, at = max(1, min(BATCH, CELLS // max(nodes, 1))), 0
    while at < n:
        to = min(n, at + min(most, max(start, at)))
        yield at, to
        at = to


def exact(x: np.ndarray, q: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """distance(rows of q, places in x), squared."""

    def distance(row: np.ndarray, place: np.ndarray) -> np.ndarray:
        d = x[place] - q[row]
        return np.einsum("ij,ij->i", d, d)

    return distance


def walk(links: np.ndarray, starts: np.ndarray, distance, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the ``size`` nearest nodes that each query's best-first walk meets, nearest first, padded with -1.

    starts: a row of places for each query. distance(queries, places) gives the distances of pairs.
    """
    b, n = starts.shape[0], len(links)
    keys = np.full((b, size), PAD)
    mark, base = np.zeros(b * n, np.int32), 1
    live = np.arange(b)

    def meet(row: np.ndarray, place: np.ndarray) -> None:
        """Put unseen places into their queries' lists; rows ascend."""
        nonlocal base
        cell = row.astype(np.int64) * n + place
        new = np.flatnonzero((place >= 0) & (mark[cell] == 0))
        cell, stamp = cell[new], np.arange(base, base + len(new), dtype=np.int32)
        mark[cell] = stamp
        new = new[mark[cell] == stamp]  # a place that comes twice in one step counts once
        base += len(stamp)
        row, place = row[new], place[new]
        d = np.maximum(distance(row, place), 0).astype(np.float32)
        key = (d.view(np.int32).astype(np.int64) << 32) | (place.astype(np.int64) << 1)
        fits = key < keys[row, -1]
        row, key = row[fits], key[fits]
        if not len(row):
            return
        count = np.bincount(row, minlength=b)
        changed = np.flatnonzero(count)
        slot = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        more = np.full((len(changed), int(count.max())), PAD)
        more[np.searchsorted(changed, row), slot] = key
        keys[changed] = np.sort(np.concatenate([keys[changed], more], 1), axis=1)[:, :size]

    meet(np.repeat(live, starts.shape[1]), starts.ravel())
    while len(live):
        own = keys[live]
        free = (own & 1) == 0
        free &= np.cumsum(free, axis=1) <= STEP
        at, slot = np.nonzero(free)
        row = live[at]
        place = (own[at, slot] & 0xFFFFFFFF) >> 1
        keys[row, slot] |= 1
        live = live[free.any(1)]
        if len(row):
            meet(np.repeat(row, links.shape[1]), links[place].ravel())
    held = keys != PAD
    place = np.where(held, (keys & 0xFFFFFFFF) >> 1, -1)
    return place, np.where(held, (keys >> 32).astype(np.int32).view(np.float32), np.float32(np.inf))


def prune(x: np.ndarray, nodes: np.ndarray, at: np.ndarray, r: int, alpha: float, fill: bool = False) -> np.ndarray:
    """A row of at most r links for each node, from its candidates ``at`` (padded with -1), nearest first, ties by place.

    A candidate goes if alpha times its distance to one kept isn't above that to the node; fill: the nearest of those fill the row up.
    """
    out = np.full((len(nodes), r), -1, np.int32)
    for a in range(0, len(nodes), PRUNED):
        own, near = nodes[a : a + PRUNED], np.sort(at[a : a + PRUNED].astype(np.int64), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[near == own[:, None]] = -1
        v = x[near] - x[own][:, None]  # seen from the node, so that far-off tables lose no digits
        dist = np.where(near >= 0, np.einsum("bcd,bcd->bc", v, v), np.inf)
        order = np.argsort(dist, axis=1, kind="stable")[:, :MOST]
        near, dist, v = (np.take_along_axis(m, order.reshape(order.shape + (1,) * (m.ndim - 2)), 1) for m in (near, dist, v))
        square = np.where(near >= 0, dist, 0)
        pair = (square[:, :, None] + square[:, None]) - 2 * (v @ v.transpose(0, 2, 1))
        alive, row, kept = near >= 0, np.arange(len(own)), np.zeros(len(own), np.int64)
        taken = np.zeros(near.shape, bool)
        for _ in range(r):
            first = alive.argmax(1)
            row = row[alive[row, first[row]]]
            if not len(row):
                break
            first = first[row]
            out[a + row, kept[row]] = near[row, first]
            kept[row] += 1
            taken[row, first] = True
            alive[row] &= alpha * pair[row, first] > dist[row]
            alive[row, first] = False
        if fill:
            rest = (near >= 0) & ~taken
            rest &= np.cumsum(rest, axis=1) <= r - kept[:, None]
            row, slot = np.nonzero(rest)
            place = kept[row] + (np.cumsum(rest, axis=1) - 1)[row, slot]
            out[a + row, place] = near[row, slot]
    return out


def nearest_places(x: np.ndarray, nodes: np.ndarray, at: np.ndarray, r: int) -> np.ndarray:
    """The r nearest of each node's candidates ``at`` (padded with -1, each once), ties by place."""
    near = np.sort(at.astype(np.int64), axis=1)
    v = x[near] - x[nodes][:, None]
    dist = np.where(near >= 0, np.einsum("bcd,bcd->bc", v, v), np.inf)
    return np.take_along_axis(near, np.argsort(dist, axis=1, kind="stable")[:, :r], 1).astype(np.int32)


def link_back(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Add each node to the rows of those that it links to. choose(nodes, candidates) gives the rows that get too long."""
    r = links.shape[1]
    source, target = np.repeat(nodes, r), links[nodes].ravel()
    some = target >= 0
    source, target = source[some], target[some]
    some = ~(links[target] == source[:, None]).any(1)
    source, target = source[some], target[some]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    hit, first, count = np.unique(target, return_index=True, return_counts=True)
    degree = (links[hit] >= 0).sum(1)
    slot = np.arange(len(target)) - np.repeat(first, count)
    wide = np.repeat(degree + count > r, count)
    links[target[~wide], (np.repeat(degree, count) + slot)[~wide]] = source[~wide]
    long = degree + count > r
    if not long.any():
        return
    hit, count = hit[long], count[long]
    source, slot, row = source[wide], slot[wide], np.repeat(np.arange(len(hit)), count)
    # rows of like length go together, so that one with many new links doesn't widen the others
    for least, most in ((0, 8), (8, 64), (64, len(x))):
        own = np.flatnonzero((count > least) & (count <= most))
        if len(own):
            mine = np.isin(row, own)
            at = np.full((len(own), r + int(count[own].max())), -1, np.int64)
            at[:, :r] = links[hit[own]]
            at[np.searchsorted(own, row[mine]), r + slot[mine]] = source[mine]
            for a in range(0, len(own), PRUNED):
                links[hit[own[a : a + PRUNED]]] = choose(hit[own[a : a + PRUNED]], at[a : a + PRUNED])


def distinct(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different rows of x, all ids by their row and themselves, where each row's ids start): equal vectors are one node."""
    nodes, own = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, own.ravel()))
    return nodes, ids[order], np.searchsorted(own.ravel()[order], np.arange(len(nodes) + 1))


def found_rows(qids: np.ndarray, place: np.ndarray, dist: np.ndarray, ids: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, id, dist) of each query's k nearest by (dist, id); a node brings the k smallest of its ids, those from first[i] to first[i + 1]."""
    q, slot = np.nonzero(place >= 0)
    at, d = place[q, slot], dist[q, slot]
    n = np.minimum(first[at + 1] - first[at], k)
    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    q, d, key = np.repeat(q, n), np.repeat(d, n), ids[np.repeat(first[at], n) + each]
    order = np.lexsort((key, d, q))
    q, d, key = q[order], d[order], key[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return qids[q[keep]], key[keep], d[keep]
