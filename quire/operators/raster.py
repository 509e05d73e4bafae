"""Visual metrics of page rasters: grey pixels as binary columns (row by row), scored in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def box_blur(a: np.ndarray, radius: int) -> np.ndarray:
    """Means over squares, by sums over rows and columns; edges repeat."""
    out = a.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(radius + 1, radius) if x == axis else (0, 0) for x in (0, 1)], mode="edge").cumsum(axis)
        n = out.shape[axis]
        take = lambda s, p=padded, x=axis, n=n: np.take(p, np.arange(s, s + n), x)
        out = (take(2 * radius + 1) - take(0)) / (2 * radius + 1)
    return out


def ink(page: np.ndarray, least: int = 16) -> np.ndarray:
    """Pixels darker than their surroundings by ``least``; a page that is dark all over is ink all over."""
    spread = int(page.max(initial=0)) - int(page.min(initial=255)) if page.size else 0
    if page.size and spread < least:
        return np.full(page.shape, int(page.max()) < 224)
    return box_blur(page, max(5, min(page.shape) // 45)) - page >= least


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    out = mask.copy()
    for axis in (0, 1):
        src = out.copy()
        for s in range(1, radius + 1):
            ahead, behind = [slice(None)] * 2, [slice(None)] * 2
            ahead[axis], behind[axis] = slice(s, None), slice(None, -s)
            out[tuple(ahead)] |= src[tuple(behind)]
            out[tuple(behind)] |= src[tuple(ahead)]
    return out


def f1(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r else 0.0


def tolerant_f1(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[float, np.ndarray, np.ndarray]:
    """F1 of two masks within a distance, and the matched pixels of each; two empty masks are alike."""
    hit_a, hit_b = a & dilate(b, radius), b & dilate(a, radius)
    if not a.any() and not b.any():
        return 1.0, hit_a, hit_b
    if not a.any() or not b.any():
        return 0.0, hit_a, hit_b
    return f1(hit_b.sum() / b.sum(), hit_a.sum() / a.sum()), hit_a, hit_b


def edges(mask: np.ndarray) -> np.ndarray:
    return mask & dilate(~mask, 1)


def regions(a, b, hit_a, hit_b, grid: int = 4) -> float:
    """Mean F1 over the cells of a grid that hold ink on either side."""
    out = []
    h, w = a.shape
    for i in range(grid):
        for j in range(grid):
            s = (slice(h * i // grid, h * (i + 1) // grid), slice(w * j // grid, w * (j + 1) // grid))
            if a[s].any() or b[s].any():
                out.append(f1(hit_b[s].sum() / b[s].sum(), hit_a[s].sum() / a[s].sum()) if a[s].any() and b[s].any() else 0.0)
    return float(np.mean(out)) if out else 1.0


def compare(a: np.ndarray, b: np.ndarray, radius: int = 2) -> dict[str, float]:
    """Dimension similarity, ink F1, edge F1 over radii 1, 2, 4 and 8 (weights 0.5, 0.25, 0.15, 0.1), regional F1, pixel
    similarity and visual_score (0.49, 0.30, 0.20 and 0.01 of these, times dimension similarity). Smaller pages are set
    on white."""
    ratio = lambda x, y: min(x, y) / max(x, y) if max(x, y) else 1.0
    size = (ratio(a.shape[0], b.shape[0]) + ratio(a.shape[1], b.shape[1])) / 2
    shape = tuple(max(x, y) for x, y in zip(a.shape, b.shape, strict=True))
    grow = lambda x: np.pad(x, [(0, s - n) for s, n in zip(shape, x.shape, strict=True)], constant_values=255)
    a, b = grow(a), grow(b)
    ma, mb = ink(a), ink(b)
    mark, hit_a, hit_b = tolerant_f1(ma, mb, radius)
    ea, eb = edges(ma), edges(mb)
    edge = sum(w * tolerant_f1(ea, eb, r)[0] for r, w in ((1, 0.5), (2, 0.25), (4, 0.15), (8, 0.1)))
    part = regions(ma, mb, hit_a, hit_b)
    pixel = 1 - float(np.abs(a.astype(int) - b.astype(int)).mean()) / 255 if a.size else 1.0
    return {"dimensions": size, "ink_f1": mark, "edge": edge, "region": part, "pixel": pixel, "visual_score": size * (0.49 * mark + 0.30 * edge + 0.20 * part + 0.01 * pixel)}


NAMES = ["dimensions", "ink_f1", "edge", "region", "pixel", "visual_score"]


def visual_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """compare() of rows with reference, r_width, candidate and c_width (grey pixels as binary). A missing side scores 0."""
    kinds = dict(pairs.dtypes)

    def page(raw, width):
        return np.frombuffer(raw, np.uint8).reshape(-1, int(width)) if raw is not None and width else None

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = page(r.reference, r.r_width), page(r.candidate, r.c_width)
                rows.append(list(compare(a, b).values()) if a is not None and b is not None else [0.0] * len(NAMES))
            yield pd.concat([pdf[keys], pd.DataFrame(rows, columns=NAMES, index=pdf.index)], axis=1)

    return pairs.select(*keys, "reference", "r_width", "candidate", "c_width").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} double" for n in NAMES)]))


def connected(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Boxes (x0, y0, x1, y1, pixels) of 8-connected components in order of y0, x0: runs of each row are joined with those
    of the row before."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        flips = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        now = []
        for a, b in zip(flips[0::2].tolist(), flips[1::2].tolist(), strict=True):
            k = len(parent)
            parent.append(k)
            boxes.append([a, y, b, y + 1, b - a])
            for c, d, other in before:
                if c <= b and a <= d:
                    p, q = sorted((find(k), find(other)))
                    if p != q:
                        parent[q] = p
                        m, n = boxes[p], boxes[q]
                        boxes[p] = [min(m[0], n[0]), min(m[1], n[1]), max(m[2], n[2]), max(m[3], n[3]), m[4] + n[4]]
            now.append((a, b, k))
        before = now
    return sorted((tuple(boxes[k]) for k in range(len(parent)) if parent[k] == k), key=lambda c: (c[1], c[0]))
