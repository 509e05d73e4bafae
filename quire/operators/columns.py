"""Column clusters of a page: the exact least-squares cut of its elements' middles, kept only if the columns are clear."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .frames import streamed

# Fixed values. Gates of a cut into columns, as shares of the page's width or of the lesser height: the least distance of
# neighbouring columns' means, the most that an element's middle may lie off its column's mean, the height that neighbours
# share; and, by the number of columns, the share of the spread that they explain.
APART, ASIDE, BESIDE = 0.16, 0.09, 0.12
EXPLAINED = {2: 0.70, 3: 0.82}
# Spanning elements: at least this share of the page and this many times the median width (headings, others).
WIDE = {True: (0.52, 1.20), False: (0.62, 1.40)}


def best_cuts(middle: np.ndarray, k: int) -> list[int]:
    """Where to cut sorted numbers into ``k`` (two or three) runs so that the squares about the runs' means are least; the first
    of equal cuts."""
    n = len(middle)
    one, two = (np.concatenate([[0.0], np.cumsum(x)]) for x in (middle, middle**2))

    def off(i, j):
        return two[j] - two[i] - (one[j] - one[i]) ** 2 / np.maximum(j - i, 1)

    if k == 2:
        cut = np.arange(1, n)
        return [int(cut[np.argmin(off(0, cut) + off(cut, n))])]
    best = (np.inf, [])
    for a in range(1, n - 1):
        cut = np.arange(a + 1, n)
        cost = off(0, a) + off(a, cut) + off(cut, n)
        c = int(np.argmin(cost))
        if cost[c] < best[0] - 1e-9:
            best = (float(cost[c]), [a, int(cut[c])])
    return best[1]


def lanes(box: np.ndarray, width: float, k: int) -> np.ndarray | None:
    """The column (from 0, left to right) of each box (x0, y0, x1, y1) for a cut into ``k``, if all gates let it pass."""
    if len(box) < 2 * k:
        return None
    middle = (box[:, 0] + box[:, 2]) / 2
    order = np.lexsort((box[:, 1], middle))
    lane = np.empty(len(box), np.int64)
    lane[order] = np.searchsorted(best_cuts(middle[order], k), np.arange(len(box)), "right")
    size = np.bincount(lane, minlength=k)
    if size.min() < 2:
        return None
    mean = np.bincount(lane, middle, k) / size
    top, bottom = (np.array([f(box[lane == c, at]) for c in range(k)]) for f, at in ((np.min, 1), (np.max, 3)))
    shared = np.minimum(bottom[1:], bottom[:-1]) - np.maximum(top[1:], top[:-1])
    least = np.minimum((bottom - top)[1:], (bottom - top)[:-1])
    whole, inner = ((middle - middle.mean()) ** 2).sum(), ((middle - mean[lane]) ** 2).sum()
    clear = [np.diff(mean).min() >= APART * width, np.abs(middle - mean[lane]).max() <= ASIDE * width, (least > 0).all() and (shared >= BESIDE * least).all(), whole == 0 or 1 - inner / whole >= EXPLAINED[k]]
    return lane if all(clear) else None


def columns_of(box: np.ndarray, heading: np.ndarray, width: float) -> np.ndarray:
    """Column number (from 0; -1 for elements that span columns) of each box of a page; three columns are tried before two."""
    size = box[:, 2] - box[:, 0]
    spans = np.zeros(len(box), bool)
    if len(box) >= 5 and (size > 0).any():
        page, usual = np.array([WIDE[bool(h)] for h in heading]).T
        spans = (size >= page * width) & (size >= usual * np.median(size[size > 0]))
    for k in (3, 2):
        lane = lanes(box[~spans], width, k)
        if lane is not None:
            out = np.full(len(box), -1, np.int64)
            out[~spans] = lane
            return out
    return np.zeros(len(box), np.int64)


def page_columns(rows: DataFrame, width: float) -> DataFrame:
    """page_id, element_id and column of rows (page_id, element_id, kind, box); a task holds one page at a time."""
    kinds = dict(rows.dtypes)

    def work(at, page):
        page = sorted(page, key=lambda r: (r[4], r[3], r[1]))
        lane = columns_of(np.array([r[3:7] for r in page], float), np.array([r[2] in ("title", "heading") for r in page]), width)
        return [(at, r[1], int(c)) for r, c in zip(page, lane, strict=True)]

    plain = rows.select("page_id", "element_id", "kind", "x0", "y0", "x1", "y1")
    return streamed(plain, "page_id", work, f"page_id {kinds['page_id']}, element_id {kinds['element_id']}, column int")
