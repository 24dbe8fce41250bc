"""Numpy helpers that run inside tasks: isolation trees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def average_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(pdf: pd.DataFrame, psi: int, seed: int) -> pd.DataFrame:
    """Random splits down to the usual height limit; leaves carry their expected depth."""
    tree = int(pdf["tree"].iloc[0])
    x = np.stack(pdf.sort_values("h")["v"].to_numpy())
    rng = np.random.default_rng([seed, tree])
    limit = max(1, math.ceil(math.log2(max(psi, 2))))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, depth + average_depth(len(rows))])
        if parent is not None:
            nodes[parent][side] = me
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = part[:, f] < cut
        if left.all() or not left.any():
            left = part[:, f] <= lo[f]
            cut = float(np.nextafter(lo[f], hi[f]))
        nodes[me][2], nodes[me][3] = f, cut
        todo.append((rows[left], depth + 1, me, 4))
        todo.append((rows[~left], depth + 1, me, 5))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "depth"])


def tree_depth(x: np.ndarray, tree: tuple) -> np.ndarray:
    feature, cut, low, high, depth = tree
    at = np.zeros(len(x), dtype=np.int64)
    moving = np.flatnonzero(feature[at] >= 0)
    while len(moving):
        node = at[moving]
        left = x[moving, feature[node]] < cut[node]
        at[moving] = np.where(left, low[node], high[node])
        moving = moving[feature[at[moving]] >= 0]
    return depth[at]
