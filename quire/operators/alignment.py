"""Alignment of a reviewed text's blocks with the positioned units of a source.

Candidates are runs of units (built by a window) that resemble a block. In a document of up to
400 units of a source all runs are scored, in a longer one those that share a word with the block or whose first unit begins
like it. The monotone choice of candidates is a weighted-interval dynamic
program over one document and source, streamed by task.
"""

from __future__ import annotations

from bisect import bisect_right
from difflib import SequenceMatcher
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from . import sequences


def threshold(kind: Column, key: Column) -> Column:
    """How alike a block of a kind must be to its candidate."""
    return F.when(kind == "equation", 0.56).when(kind == "table", 0.66).when(F.length(key) <= 3, 0.82).otherwise(0.62)


#: The element types that a block of a kind expects.
EXPECTED = {
    "heading": ["heading", "title", "header"],
    "paragraph": ["paragraph", "text"],
    "option": ["list_item", "text"],
    "list_item": ["list_item", "text"],
    "table": ["table"],
    "equation": ["formula"],
    "code": ["text"],
}


def type_score(kind: Column, types: Column) -> Column:
    """1 if one of the types is expected, 0.62 for plain text, else 0.25."""
    wanted = F.coalesce(F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[kind], F.array(F.lit("text")))
    return F.when(F.arrays_overlap(types, wanted), 1.0).when(F.arrays_overlap(types, F.array(F.lit("text"), F.lit("paragraph"))), 0.62).otherwise(0.25)


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    whole = SequenceMatcher(None, a, b, autojunk=False).ratio()
    x, y = a.split(), b.split()
    both = sum(min(x.count(w), y.count(w)) for w in set(x))
    tokens = 2 * both / (len(x) + len(y)) if x or y else 0.0
    short, long = sorted((a, b), key=len)
    held = len(short) / len(long) if short and short in long else 0.0
    return max(whole, 0.68 * whole + 0.32 * tokens, held)


@F.pandas_udf(T.DoubleType())
def likeness(left: pd.Series, right: pd.Series) -> pd.Series:
    """The greatest of the matching-block ratio, that ratio mixed with the words' F1, and containment."""
    return pd.Series([_alike(a, b) for a, b in zip(left, right, strict=True)])


def _alike_from(a: str, b: str, least: float) -> float | None:
    """_alike() where it is ``least`` at least; the bounds on the ratio leave the others out early."""
    if a != b and not (min(len(a), len(b)) and (a in b or b in a)):
        x, y = a.split(), b.split()
        both = sum(min(x.count(w), y.count(w)) for w in set(x))
        tokens = 2 * both / (len(x) + len(y)) if x or y else 0.0
        need = min(least, (least - 0.32 * tokens) / 0.68) - 1e-9
        m = SequenceMatcher(None, a, b, autojunk=False)
        if m.real_quick_ratio() < need or m.quick_ratio() < need:
            return None
    like = _alike(a, b)
    return like if like >= least else None


@F.pandas_udf(T.DoubleType())
def likeness_from(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
    """likeness() where it is ``least`` at least, else null."""
    return pd.Series([_alike_from(a, b, x) for a, b, x in zip(left, right, least, strict=True)], dtype="float64")


#: Units of a document and source up to which all runs are scored; beginnings that admit a run beyond that.
FEW, PREFIX, PREFIX_LEAST, PREFIX_LIKE = 400, 12, 3, 0.55


def candidates(blocks: DataFrame, units: DataFrame, longest: int = 8, best: int = 256) -> DataFrame:
    """Candidates (doc_id, source, block_index, first, end, score) of blocks (doc_id, block_index, kind, text) among the
    units (doc_id, source, page, position, kind, text, confidence): runs of up to ``longest`` units of a page whose score
    0.82 likeness + 0.13 type + 0.05 confidence is 0.62 at least and whose likeness reaches the kind's threshold; at most
    ``best`` a block."""
    w = Window.partitionBy("doc_id", "source", "page").orderBy("position").rowsBetween(0, longest - 1)
    ahead = units.select("doc_id", "source", "page", F.col("position").alias("first"), F.collect_list(F.struct("text", "kind", F.coalesce("confidence", F.lit(0.5)).alias("c"))).over(w).alias("u"))
    runs = ahead.select("doc_id", "source", "first", F.explode(F.sequence(F.lit(1), F.size("u"))).alias("size"), "u")
    runs = runs.withColumn("u", F.slice("u", 1, F.col("size"))).select("doc_id", "source", "first", (F.col("first") + F.col("size")).alias("end"), t.normalized(F.array_join(F.transform("u", lambda x: x["text"]), " ")).alias("key"), F.transform("u", lambda x: x["kind"]).alias("types"), (F.aggregate("u", F.lit(0.0), lambda a, x: a + x["c"]) / F.col("size")).alias("c"))
    keyed = blocks.select("doc_id", "block_index", F.col("kind").alias("block_kind"), t.normalized(F.col("text")).alias("target")).where("target <> ''")
    few = units.groupBy("doc_id", "source").agg((F.count(F.lit(1)) <= FEW).alias("few"))
    runs = runs.join(few, ["doc_id", "source"])
    whole = runs.where("few").join(keyed.select("doc_id", "block_index", "target"), "doc_id")
    # A run much longer or shorter than the block cannot be alike enough: of 0.56 the words give 0.32 at most.
    near = lambda d: d.where(2 * F.least(F.length("key"), F.length("target")) >= 0.35 * (F.length("key") + F.length("target")))
    place = ["doc_id", "block_index", "source", "first", "end"]
    many = runs.where("not few")
    words = lambda d, c, cols: d.select(*cols, F.explode(F.array_distinct(F.split(c, " "))).alias("word"))
    met = words(keyed, "target", ["doc_id", "block_index"]).join(words(many, "key", ["doc_id", "source", "first", "end"]), ["doc_id", "word"]).select(*place)
    # Beginnings that agree: of each distinct pair of beginnings once.
    starts = many.where("end = first + 1").select("doc_id", "source", "first", F.substring("key", 1, PREFIX).alias("begin"))
    tops = keyed.select("doc_id", "block_index", F.substring("target", 1, PREFIX).alias("top"))
    pairs = starts.select("doc_id", "begin").distinct().join(tops.select("doc_id", "top").distinct(), "doc_id")
    n = F.least(F.length("begin"), F.length("top"))
    pairs = pairs.where(n >= PREFIX_LEAST).where(likeness_from(F.substring("begin", F.lit(1), n), F.substring("top", F.lit(1), n), F.lit(PREFIX_LIKE)).isNotNull())
    begun = starts.join(pairs, ["doc_id", "begin"]).join(tops, ["doc_id", "top"]).join(many.select("doc_id", "source", "first", "end"), ["doc_id", "source", "first"]).select(*place)
    met = near(whole).select(*place).union(met).union(begun).distinct()
    rows = near(met.join(keyed, ["doc_id", "block_index"]).join(runs.drop("few"), ["doc_id", "source", "first", "end"]))
    rows = rows.withColumn("like", likeness_from("target", "key", threshold(F.col("block_kind"), F.col("target")))).where("like is not null")
    rows = rows.withColumn("score", F.least(F.lit(1.0), 0.82 * F.col("like") + 0.13 * type_score(F.col("block_kind"), F.col("types")) + 0.05 * F.col("c"))).where("score >= 0.62")
    order = Window.partitionBy("doc_id", "source", "block_index").orderBy(F.col("score").desc(), "first", "end")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= best).select("doc_id", "source", "block_index", "first", "end", "score")


class _Best:
    """The best chain that ends at or before a place: a tree of maxima over places, each of which covers a run of them."""

    def __init__(self, size: int, none):
        self.tree = [none] * (size + 1)

    def until(self, place: int):
        out = self.tree[0]
        while place > 0:
            out = max(out, self.tree[place], key=lambda s: s[0])
            place &= place - 1
        return out

    def offer(self, place: int, state) -> None:
        while place < len(self.tree):
            if state[0] > self.tree[place][0]:
                self.tree[place] = state
            place += place & -place


def _choose(rows: list) -> list:
    """The chain of candidates, ascending in block and place, with the greatest sum; ties: more blocks, then the earlier
    end. A block's candidates are all judged before any of them is offered to later blocks."""
    ends = sorted({r.end for r in rows})
    best = _Best(len(ends), ((0.0, 0, 0), None))
    for _, own in groupby(sorted(rows, key=lambda r: (r.block_index, r.first, r.end)), key=lambda r: r.block_index):
        fresh = []
        for r in own:
            (total, n, _), chain = best.until(bisect_right(ends, r.first))
            fresh.append(((round(total + r.score, 12), n + 1, -r.end), (r, chain)))
        for state in fresh:
            best.offer(bisect_right(ends, state[1][0].end), state)
    out, chain = [], best.until(len(ends))[1]
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def align(found: DataFrame) -> DataFrame:
    """Of candidates() at most one a block, in the blocks' order, so that the sum of scores is greatest."""
    columns = ["doc_id", "source", "block_index", "first", "end", "score"]

    def run(frames):
        held: list = []
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if held and (held[0].doc_id, held[0].source) != (r.doc_id, r.source):
                    out += _choose(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(_choose(held), columns=columns)

    rows = found.select(*columns)
    return rows.repartition("doc_id", "source").sortWithinPartitions("doc_id", "source", "block_index", "first", "end").mapInPandas(run, rows.schema)


def consensus_boxes(matches: DataFrame, units: DataFrame) -> DataFrame:
    """Per block the lower weighted median of the corners of its matched units over all sources (weight: the match's score),
    the page that most sources agree on, and how many do."""
    met = matches.join(units.drop("kind", "text", "confidence"), ["doc_id", "source"]).where("position >= first and position < end")
    boxes = met.groupBy("doc_id", "block_index", "source", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("score").alias("confidence"))
    # The boxes of a block are as few as its sources and their pages, so one list of them gives the page and the medians.
    one = F.struct("page", "source", "x0", "y0", "x1", "y1", "confidence")
    rows = boxes.groupBy("doc_id", "block_index").agg(F.sort_array(F.collect_list(one)).alias("_b")).where("doc_id is not null and block_index is not null")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def vote(page: Column) -> Column:
        own = F.filter("_b", lambda x: x["page"].eqNullSafe(page))
        known = F.filter(F.transform(own, lambda x: x["confidence"]), lambda c: c.isNotNull())
        sources = F.size(F.array_distinct(F.filter(F.transform(own, lambda x: x["source"]), lambda x: x.isNotNull()))).cast("long")
        return F.struct(sources.alias("sources"), F.when(F.size(known) > 0, F.round(total(known), 9)).alias("s"), (-page).alias("p"), page.alias("page"))

    rows = rows.withColumn("_v", F.array_max(F.transform(F.array_distinct(F.transform("_b", lambda x: x["page"])), vote)))
    rows = rows.select("doc_id", "block_index", F.col("_v.page").alias("page"), F.col("_v.sources").alias("sources"), F.filter("_b", lambda x: x["page"] == F.col("_v.page")).alias("_k")).where("page is not null")
    weight = lambda some: F.round(total(F.transform(some, lambda x: F.coalesce(x["confidence"], F.lit(0.5)))), 9)

    def median(c: str) -> Column:
        upto = lambda v: weight(F.filter("_k", lambda x: x[c].isNull() | (x[c] <= v)))
        values = F.filter(F.array_distinct(F.transform("_k", lambda x: x[c])), lambda v: v.isNotNull())
        return F.array_min(F.filter(values, lambda v: upto(v) * 2 >= weight(F.col("_k"))))

    return rows.select("doc_id", "block_index", "page", "sources", *[median(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def rejected(blocks: DataFrame, found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Blocks without a match and why: no candidate, or candidates that the order left no place for."""
    have = found.select("doc_id", "block_index").distinct().withColumn("had", F.lit(True))
    rows = blocks.select("doc_id", "block_index").join(chosen.select("doc_id", "block_index").distinct(), ["doc_id", "block_index"], "left_anti").join(have, ["doc_id", "block_index"], "left")
    return rows.select("doc_id", "block_index", F.when(F.col("had"), "out of order").otherwise("no candidate").alias("reason"))


def exact_anchors(blocks: DataFrame, units: DataFrame, longest: int = 8) -> DataFrame:
    """Blocks whose text is that of one run only, and of no other block of the document: an equi-join on the text."""
    runs = sequences.spans(units, ["doc_id", "source", "page"], "position", "text", longest).select("doc_id", "source", "first", t.normalized(F.col("span_text")).alias("key"))
    one_run = runs.groupBy("doc_id", "source", "key").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where("n = 1").drop("n")
    one_block = blocks.select("doc_id", "block_index", t.normalized(F.col("text")).alias("key")).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("block_index").alias("block_index")).where("n = 1 and key <> ''").drop("n")
    return one_block.join(one_run, ["doc_id", "key"]).select("doc_id", "source", "block_index", "first")
