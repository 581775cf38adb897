"""Isolation forests of many sources at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Trees of a forest, points of each tree's sub-sample, and depth at which a tree ends.
TREES, SAMPLE, DEPTH = 64, 64, 8
#: Of a short source at most this part goes into one sub-sample, so that most trees haven't seen an odd reading they judge.
PART = 4
#: Groups whose trees are grown together, and rows that walk down them together: they bound what is held at once.
GROUPS, ROWS = 64, 16384


def average_path(n):
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.maximum(np.asarray(n, float), 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def scattered(x: np.ndarray) -> np.ndarray:
    """Evenly scattered 64-bit numbers for whole numbers (a published finaliser of a 64-bit generator)."""
    with np.errstate(over="ignore"):
        z = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform(seed: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that depend on seed and number only."""
    with np.errstate(over="ignore"):
        return (scattered(scattered(seed) + np.asarray(number).astype(np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53


def grown(points: np.ndarray, owner: np.ndarray, seeds: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Trees over points (each of the tree owner, one seed a tree) in the unit box.

    Returns of every node its feature, cut, left child (the right one follows; a leaf is its own left child and has an infinite cut)
    and path length. Roots come first. Cuts fall anywhere in a node's part of the box, so that where a source has no readings there are
    leaves without points, which end the path of what comes to lie there.
    """
    trees, features = len(seeds), points.shape[1]
    ids, of, path = np.arange(trees), np.arange(trees), np.zeros(trees, np.int64)
    low, high = np.zeros((trees, features)), np.ones((trees, features))
    at = owner
    parts = []
    made = trees
    for level in range(depth + 1):
        count = np.bincount(at, minlength=len(ids))
        length = level + average_path(count)
        grows = np.flatnonzero(count > 1) if level < depth else np.zeros(0, np.int64)
        feature, cut, left = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf), ids.copy()
        which = (uniform(seeds[of[grows]], 2 * path[grows]) * features).astype(np.int64)
        a, b = low[grows, which], high[grows, which]
        feature[grows], cut[grows] = which, a + (b - a) * uniform(seeds[of[grows]], 2 * path[grows] + 1)
        left[grows] = made + 2 * np.arange(len(grows))
        parts.append((feature, cut, left, length))
        if not len(grows):
            break
        place = np.full(len(ids), -1)
        place[grows] = 2 * np.arange(len(grows))
        stays = place[at] >= 0
        at, points = at[stays], points[stays]
        at = place[at] + (points[np.arange(len(at)), feature[at]] >= cut[at])
        low, high = np.repeat(low[grows], 2, axis=0), np.repeat(high[grows], 2, axis=0)
        k = 2 * np.arange(len(grows))
        high[k, which], low[k + 1, which] = cut[grows], cut[grows]
        path = np.repeat(2 * path[grows] + 1, 2)
        path[1::2] += 1
        of = np.repeat(of[grows], 2)
        ids = made + np.arange(2 * len(grows))
        made += len(ids)
    return tuple(np.concatenate(x) for x in zip(*parts))


def forest_scores(x: np.ndarray, group: np.ndarray, train: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seeds: np.ndarray | None = None, number: np.ndarray | None = None, depth: int = DEPTH) -> np.ndarray:
    """Isolation score (0 to 1, high is odd) of every row of x by the forest of its own group.

    x: (rows, features), each from 0 to 1; group: ascending group numbers from 0; train: rows from which each tree draws its
    sub-sample of at most `sample` points (the algorithm's own sub-sampling) and of at most a quarter of them; seeds: one whole number per group; number: a whole number
    per row on which its draw depends, its place in the group by default (only the trees * sample training rows of the least draws count). A group's
    scores depend on its rows and seed only, not on what else is in the call. A group with fewer than two training
    rows scores 0.5 throughout.
    """
    rows = len(x)
    if not rows:
        return np.zeros(0)
    groups = int(group[-1]) + 1
    seeds = np.arange(groups) if seeds is None else np.asarray(seeds)
    place = np.arange(rows) - np.searchsorted(group, group) if number is None else number
    pool = np.flatnonzero(train)
    pool = pool[np.lexsort((uniform(seeds[group[pool]], place[pool]), group[pool]))]
    n = np.bincount(group[pool], minlength=groups)
    start = np.cumsum(n) - n
    size = np.minimum(np.minimum(n, sample), np.maximum(2, -(-n // PART)))
    out = np.full(rows, 0.5)
    border = np.searchsorted(group, np.arange(groups + 1))
    for first in range(0, groups, GROUPS):
        some = np.arange(first, min(first + GROUPS, groups))
        of = np.repeat(some, trees)
        tree = np.tile(np.arange(trees), len(some))
        have = np.arange(sample) < size[of][:, None]
        pick = start[of][:, None] + (tree[:, None] * size[of][:, None] + np.arange(sample)) % np.maximum(n[of], 1)[:, None]
        owner = np.broadcast_to(np.arange(len(of))[:, None], have.shape)[have]
        feature, cut, left, length = grown(x[pool[pick[have]]].astype(float), owner, scattered(seeds[of]) ^ scattered(tree + 1), depth)
        for a in range(border[first], border[some[-1] + 1], ROWS):
            b = min(a + ROWS, border[some[-1] + 1])
            flat, at = x[a:b].ravel(), np.arange(b - a) * x.shape[1]
            root = (group[a:b] - first) * trees
            total = np.zeros(b - a)
            for t in range(trees):
                node = root + t
                for _ in range(depth):
                    node = left.take(node) + (flat.take(at + feature.take(node)) >= cut.take(node))
                total += length.take(node)
            norm = average_path(size[group[a:b]])
            out[a:b] = np.where(norm > 0, 2.0 ** (-total / trees / np.maximum(norm, 1e-9)), 0.5)
    return out
