"""Walks through the linked nodes of an isolation forest."""

from __future__ import annotations

import numpy as np
import pandas as pd

from logwarden.operators import iforest


def test_walks_take_as_many_steps_as_the_deepest_tree():
    rng = np.random.default_rng(5)
    data = rng.uniform(size=(64, 3))
    names = ["node", "feature", "threshold", "left", "right", "depth"]
    grown = [iforest.grow_tree(data, limit, np.random.default_rng(limit)) for limit in (1, 4)] + [[(0, -1, 0.0, -1, -1, 2.5)]]
    parts = [pd.DataFrame(tree, columns=names).assign(tree=t) for t, tree in enumerate(grown)]
    nodes = iforest.from_table(pd.concat(parts), 3, 64, 0.0).nodes
    links = iforest.linked(nodes)
    assert links[4] == 4
    expected = []
    for point in data:
        depths = []
        for tree in ({n[0]: n for n in tree} for tree in grown):
            node = tree[0]
            while node[1] >= 0:
                node = tree[node[3] if point[node[1]] <= node[2] else node[4]]
            depths.append(node[5])
        expected.append(np.mean(depths))
    assert iforest.mean_value(links, data).tolist() == expected
