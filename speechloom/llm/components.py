"""Connected components of a link table, at every size in the same way: contracted in each task, then in rounds over all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from speechloom.llm.common import map_columns, written
from speechloom.operators import graph


def components(links: DataFrame) -> DataFrame:
    """links (a, b), both long, to (node, root): every linked node once, root the least node of its component.

    An empty table gives an empty one; repeated links and those of a node to itself change nothing. Each task first joins the
    links it has, and hands on one link a node; rounds over what is left are written, so a lost executor costs one round.
    """
    own = map_columns(links.where("a <> b").select("a", "b"), "a long, b long", contracted)
    return graph.components(written(own, "components-links"))


def contracted(batches):
    """Of all links of one task, each node's link to its root."""
    for b in joined(batches):
        some = [(n, r) for n, r in zip(b["node"], b["root"], strict=True) if n != r]
        yield {"a": [n for n, _ in some], "b": [r for _, r in some]}


def joined(batches):
    """The components of all links of one task: nodes take the least root of their neighbours until nothing changes, and
    roots stand for their nodes."""
    parts = [(b["a"], b["b"]) for b in batches]
    if not parts:
        return
    ends = np.array([[x for p in parts for x in p[side]] for side in (0, 1)], np.int64)
    names, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        # Each end's root, too, points to the lower one, so that whole trees move at once.
        for side in (a, b):
            np.minimum.at(after, root[side], low)
        while (after != (up := after[after])).any():
            after = up
        if (after == root).all():
            break
        root = after
    yield {"node": names.tolist(), "root": names[root].tolist()}
