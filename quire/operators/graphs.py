"""Reading-order graphs: edges, layers and checks. A document's graph is small, and there are many documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .frames import streamed


def vertical_edges(regions: DataFrame, page: str, least: float = 0.2) -> DataFrame:
    """Edges from each region to the regions below it with which it shares ``least`` of the narrower width; confidence is
    that share held within 0.6 and 0.95."""
    right = regions.select(page, *[F.col(c).alias(f"{c}2") for c in ("region_id", "x0", "y0", "x1", "y1")])
    met = regions.join(right, page).where("y1 <= y02 and region_id <> region_id2")
    share = g.horizontal_overlap(g.box(), g.box(suffix="2"))
    return met.where(share >= least).select(page, F.col("region_id").alias("src"), F.col("region_id2").alias("dst"), F.greatest(F.lit(0.6), F.least(F.lit(0.95), share)).alias("confidence"))


def _layers(edges: set) -> dict:
    """Layers of one graph by peeling off what waits for nothing; nodes on or behind a cycle get -1."""
    after: dict = {}
    waits: dict = {}
    for s, d in edges:
        for x in (s, d):
            if x is not None:
                after.setdefault(x, [])
                waits.setdefault(x, 0)
        if s is not None and d is not None:
            after[s].append(d)
            waits[d] += 1
    layer, now, k = dict.fromkeys(waits, -1), [n for n, w in waits.items() if not w], 0
    while now:
        nxt = []
        for n in now:
            layer[n] = k
            for d in after[n]:
                waits[d] -= 1
                if not waits[d]:
                    nxt.append(d)
        now, k = nxt, k + 1
    return layer


def topological_layers(edges: DataFrame, page: str) -> DataFrame:
    """page, node and layer (from 0; -1 on or behind a cycle) of the edges (src, dst); an edge to null adds its node."""
    kinds = dict(edges.dtypes)
    plain = lambda x: None if pd.isna(x) else x
    work = lambda at, rows: [(at, n, k) for n, k in _layers({(plain(s), plain(d)) for _, s, d in rows}).items()]
    return streamed(edges.select(page, "src", "dst"), page, work, f"{page} {kinds[page]}, node {kinds['src']}, layer long")


def acyclic(edges: DataFrame, page: str) -> DataFrame:
    """The edges in order of confidence (then src, dst), without those that would close a cycle."""
    names = edges.columns
    sure, src, dst = (names.index(c) for c in ("confidence", "src", "dst"))

    def work(at, rows):
        after: dict = {}
        keep = []
        for r in sorted(rows, key=lambda r: (-r[sure], r[src], r[dst])):
            seen, todo = set(), [r[dst]]
            while todo and r[src] not in seen:
                n = todo.pop()
                if n not in seen:
                    seen.add(n)
                    todo += after.get(n, ())
            if r[src] not in seen:
                after.setdefault(r[src], set()).add(r[dst])
                keep.append(r)
        return keep

    return streamed(edges, page, work, ", ".join(f"{c} {k}" for c, k in edges.dtypes))


def partition_faults(regions: DataFrame, elements: DataFrame, page: str) -> DataFrame:
    """Pages whose regions (region_id, element_id) are no exact disjoint cover of their elements: how many elements are
    missing, unknown or in several regions."""
    held = regions.groupBy(page, "element_id").agg(F.count(F.lit(1)).alias("n"))
    both = elements.select(page, "element_id", F.lit(1).alias("there")).distinct().join(held, [page, "element_id"], "full")
    out = both.groupBy(page).agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("there").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.where("missing + unknown + repeated > 0")


def leaf_engines(provenance: DataFrame) -> DataFrame:
    """owner and engine of the leaves of provenance edges (owner, id, parent, engine): an ensemble stands for its contributors,
    however deep they lie. What leads back to itself is named ``cycle:`` and its engine. A task holds one owner's tree."""
    kinds = dict(provenance.dtypes)

    def work(at, rows):
        below: dict = {}
        for r in rows:
            below.setdefault(None if pd.isna(r[2]) else r[2], []).append(r)
        found, todo = set(), [(r, frozenset()) for r in below.get(None, ())]
        while todo:
            (_, i, _, engine), above = todo.pop()
            kids = below.get(i, ()) if not pd.isna(i) else ()
            if engine.lower() != "ensemble" or not kids:
                found.add(engine.lower())
            elif i in above:
                found.add(f"cycle:{engine.lower()}")
            else:
                todo += [(r, above | {i}) for r in kids]
        return [(at, e) for e in sorted(found)]

    return streamed(provenance.select("owner", "id", "parent", "engine"), "owner", work, f"owner {kinds['owner']}, engine string")
