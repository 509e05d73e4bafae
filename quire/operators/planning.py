"""Page plans and bounded searches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


def segment(weights: list[float], pages: int, capacity: list[float] | None = None, fixed: dict[int, int] | None = None, empty: float = 25.0) -> list[int]:
    """The page (from 0) of each block so that blocks stay in order, fixed blocks stand on their page and the squared
    misfit of page weights against their share (by ``capacity``) is least; an empty page costs ``empty`` + 1/pages more. A
    block's weight counts three times the mean at most. Ties go to fewer blocks on earlier pages."""
    n = len(weights)
    if not n or pages <= 0:
        return []
    fixed = fixed or {}
    mean = sum(weights) / n
    held = [min(w, 3 * mean) if mean else 1.0 for w in weights]
    run = [0.0]
    for w in held:
        run.append(run[-1] + w)
    room = capacity or [1.0] * pages
    share = [run[-1] * c / sum(room) for c in room]
    last = [max((p for b, p in fixed.items() if b < i), default=0) for i in range(n + 1)]
    best = [0.0] + [float("inf")] * n
    back: list[list[int]] = []
    for p in range(pages):
        now, frm = [float("inf")] * (n + 1), [-1] * (n + 1)
        for i in range(n + 1):
            if best[i] == float("inf"):
                continue
            for j in range(i, n + 1):
                if any(q != p for b, q in fixed.items() if i <= b < j):
                    break
                load = run[j] - run[i]
                cost = best[i] + ((load - share[p]) / max(share[p], 1e-9)) ** 2 + (empty + 1 / pages if i == j else 0.0)
                if cost < now[j] - 1e-12:
                    now[j], frm[j] = cost, i
        best = now
        back.append(frm)
    if best[n] == float("inf"):
        raise ValueError("fixed blocks are out of order" if last[-1] < pages else "a fixed page is missing")
    out, j = [0] * n, n
    for p in reversed(range(pages)):
        i = back[p][j]
        for b in range(i, j):
            out[b] = p
        j = i
    return out


def plan_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, block_index and page of blocks (doc_id, block_index, weight, page as fixed or null) over documents' pages
    (doc_id, pages)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["doc_id", "block_index", "page"])
        left = left.sort_values("block_index").reset_index(drop=True)
        fixed = {i: int(p) for i, p in enumerate(left["page"]) if pd.notna(p)}
        got = segment(left["weight"].astype(float).tolist(), int(right["pages"].iloc[0]), fixed=fixed)
        return pd.DataFrame({"doc_id": left["doc_id"], "block_index": left["block_index"], "page": got})

    kinds = dict(blocks.dtypes)
    return blocks.groupBy("doc_id").cogroup(pages.groupBy("doc_id")).applyInPandas(run, f"doc_id {kinds['doc_id']}, block_index {kinds['block_index']}, page int")


@dataclass
class Search:
    """What a bounded search did: the best state, its objective, every objective tried, and why it ended."""

    best: object
    objective: tuple
    tried: list[tuple] = field(default_factory=list)
    ended: str = "converged"


def bounded_search(start, objective: Callable, propose: Callable, key: Callable = repr, passes: int = 8, least: float = 0.0, budget: int = 64) -> Search:
    """Hill climbing on the driver over single artefacts: proposals for the best state are tried in order, the first whose
    objective (a tuple, smaller is better) wins by more than ``least`` in its first difference is kept, others are rolled back.
    No state is tried twice. Ends: converged, passes, budget, or visited."""
    found = Search(start, tuple(objective(start)))
    found.tried.append(found.objective)
    seen = {key(start)}
    for _ in range(passes):
        gained, fresh = False, False
        for state in propose(found.best):
            if key(state) in seen:
                continue
            if len(found.tried) >= budget:
                found.ended = "budget"
                return found
            fresh = True
            seen.add(key(state))
            now = tuple(objective(state))
            found.tried.append(now)
            first = next((a - b for a, b in zip(found.objective, now, strict=True) if a != b), 0)
            if first > least:
                found.best, found.objective, gained = state, now, True
                break
        if not gained:
            found.ended = "converged" if fresh else "visited"
            return found
    found.ended = "passes"
    return found
