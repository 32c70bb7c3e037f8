"""Connected components of masks, chunk by chunk.

Defined results: repeated pixels count once; pixels without a place are left out; an
empty mask has no components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def label_pixels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Component numbers of 8-connected pixels, in the order of their first pixels by row and column.

    The input must be sorted by (y, x) without repeats. Each pixel points at a
    neighbour; the smallest label of both ends spreads along the edges, and
    pointers are shortened until nothing changes.
    """
    width = int(x.max()) + 3 if len(x) else 1
    key = y.astype(np.int64) * width + x + 1
    ends = []
    for step in (1, width - 1, width, width + 1):
        at = np.searchsorted(key, key + step)
        hit = np.flatnonzero(at < len(key))
        hit = hit[key[at[hit]] == key[hit] + step]
        ends.append((hit, at[hit]))
    a, b = (np.concatenate(e) for e in zip(*ends))
    root = np.arange(len(key))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not (root[root] == root).all():
            root = root[root]
        if (root == before).all():
            return np.unique(root, return_inverse=True)[1]


def label_spans(classes: np.ndarray) -> dict[str, np.ndarray]:
    """Components of a whole mask (height, width), where -1 is background: class, component, area, x1, y1, x2 and y2 of each; boxes are half open.

    The unit is the span, a run of one class in a row. Spans of neighbouring rows
    that overlap or touch at a corner are joined; the smallest number of both ends
    spreads along these joints. Components are numbered within their class in the
    order of their first pixels by row and column.
    """
    height, width = classes.shape
    edge = np.full((height, 1), -2, np.int64)
    cut = np.diff(np.concatenate([edge, classes.astype(np.int64), edge], axis=1), axis=1) != 0
    row, at = np.nonzero(cut[:, :width])
    end = np.nonzero(cut[:, 1:])[1] + 1
    kind = classes[row, at].astype(np.int64)
    keep = np.flatnonzero(kind >= 0)
    keep = keep[np.lexsort((at[keep], row[keep], kind[keep]))]
    row, at, end, kind = row[keep].astype(np.int64), at[keep].astype(np.int64), end[keep].astype(np.int64), kind[keep]
    line = (kind * (height + 1) + row) * (width + 2)  # a line of its own for each class and row, and a free one between classes
    low = np.searchsorted(line + end, line + width + 2 + at)  # the spans of the next line that end at or behind this one's start ..
    high = np.searchsorted(line + at, line + width + 2 + end, side="right")  # .. and start at or before its end
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    root = np.arange(len(row))
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while not (root[root] == root).all():
            root = root[root]
        if (root == before).all():
            break
    first, number = np.unique(root, return_inverse=True)
    n = len(first)
    found = {"kind": kind[first], "component": np.arange(n) - np.searchsorted(kind[first], kind[first]), "area": np.bincount(number, end - at, n).astype(np.int64)}
    for name, value, pick, start in (("x1", at, np.minimum, width), ("y1", row, np.minimum, height), ("x2", end, np.maximum, 0), ("y2", row + 1, np.maximum, 0)):
        found[name] = np.full(n, start, np.int64)
        pick.at(found[name], number, value)
    return found


def label_components(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by..., component, area, x1, y1, x2, y2) of pixels (by..., y, x); boxes are half open.

    A group is one class of one chunk, at most a padded window of pixels, so a
    task's memory is bounded; groups are independent and shuffled by their keys once.
    """
    fields = [f for f in pixels.schema.fields if f.name in by]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "component int, area int, x1 int, y1 int, x2 int, y2 int"])
    names = [f.name for f in fields]

    def run(table: pa.Table) -> pa.Table:
        pair = np.unique(np.stack([table["y"].to_numpy(), table["x"].to_numpy()], axis=1).astype(np.int64), axis=0)
        y, x = pair[:, 0], pair[:, 1]
        label = label_pixels(y, x)
        n = int(label.max()) + 1
        low, high = np.full((n, 2), 2**31 - 1), np.full((n, 2), -1)
        for k, v in enumerate((x, y)):
            np.minimum.at(low[:, k], label, v)
            np.maximum.at(high[:, k], label, v)
        same = {c: pa.array([table[c][0].as_py()] * n, table.schema.field(c).type) for c in names}
        stats = {"component": np.arange(n), "area": np.bincount(label), "x1": low[:, 0], "y1": low[:, 1], "x2": high[:, 0] + 1, "y2": high[:, 1] + 1}
        return pa.table(same | {k: pa.array(v.astype(np.int32)) for k, v in stats.items()})

    return pixels.select(*by, "y", "x").dropna(subset=["y", "x"]).groupBy(*by).applyInArrow(run, schema)
