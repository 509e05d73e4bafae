"""Frames and canonical order of the sources of a page, and the reducers that follow that order.

Sources report in their own units, so boxes are brought into one frame before they are correlated; and every choice ends in
an order that does not depend on how rows came in.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Known sources of readings, in the order of their rank.
PROVIDERS = "paddleocr mineru olmocr mistral_ocr azure_document_intelligence mathpix google_document_ai aws_textract tesseract_local native_pdf json".split()
TOLERANCE = 1e-3


def provider_rank(engine: Column) -> Column:
    """A known source's place; all others come after, by name."""
    ranks = F.create_map(*[x for k, name in enumerate(PROVIDERS) for x in (F.lit(name), F.lit(k))])
    return F.coalesce(ranks[F.lower(engine)], F.lit(len(PROVIDERS)))


def reference_frames(rows: DataFrame, page: str) -> DataFrame:
    """The frame of each page: that of a native source, else of the source with the greatest sum of confidences, then by
    name. Rows: page, source, source_type, width, height, confidence. Result: page, frame_source, frame_width, frame_height."""
    sources = rows.groupBy(page, "source").agg(
        F.min("source_type").alias("source_type"), F.min("width").alias("width"), F.min("height").alias("height"), F.round(F.sum(F.coalesce("confidence", F.lit(0.0))), 9).alias("sure")
    )
    order = F.struct((F.col("source_type") != "native").alias("n"), (-F.col("sure")).alias("s"), F.col("source"))
    best = sources.groupBy(page).agg(F.min_by(F.struct("source", "width", "height"), order).alias("b"))
    return best.select(page, F.col("b.source").alias("frame_source"), F.col("b.width").alias("frame_width"), F.col("b.height").alias("frame_height"))


def rescaled(rows: DataFrame, page: str, sizes: tuple[str, ...] = ()) -> DataFrame:
    """Boxes, and columns in ``sizes`` (as a font's size) in the frame of their page; adds rescaled. Frames that agree to a
    thousandth, and rows without a size, stay as they are."""
    met = rows.join(reference_frames(rows, page), page)
    across, down = F.col("frame_width") / F.col("width"), F.col("frame_height") / F.col("height")
    whole = (F.col("width") > 0) & (F.col("height") > 0)
    moves = F.coalesce(whole & ~((F.abs(across - 1) <= TOLERANCE) & (F.abs(down - 1) <= TOLERANCE)), F.lit(False))
    met = met.withColumns({"rescaled": moves, "_x": F.when(moves, across).otherwise(1.0), "_y": F.when(moves, down).otherwise(1.0)})
    scaled = {c: F.col(c) * F.col("_x" if c[0] == "x" else "_y") for c in ("x0", "y0", "x1", "y1")} | {c: F.col(c) * F.col("_x") for c in sizes}
    out = met.withColumns(scaled).withColumns({"width": F.when(moves, F.col("frame_width")).otherwise(F.col("width")), "height": F.when(moves, F.col("frame_height")).otherwise(F.col("height"))})
    return out.drop("_x", "_y", "frame_width", "frame_height", "frame_source")


def canonical_key(extra: tuple[str, ...] = ()) -> list[Column]:
    """The total order of observations (engine, source, reading_order, box, kind, text, element_id): ranks of sources, then
    hints with unknown ones last, then place, kind, text key, id and any further columns as text."""
    order = [provider_rank(F.col("engine")), F.lower("engine"), F.col("source"), F.col("reading_order").asc_nulls_last(), *[F.col(c) for c in ("y0", "x0", "y1", "x1", "kind")]]
    return [*order, t.normalized(F.coalesce("text", F.lit(""))), F.col("element_id"), *[F.col(c).cast("string").asc_nulls_first() for c in extra]]


def canonical_order(rows: DataFrame, page: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Add canonical (from 0 in each page)."""
    return rows.withColumn("canonical", F.row_number().over(Window.partitionBy(page).orderBy(*canonical_key(extra))) - 1)


def preferred(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Add preference (from 0): the surest first (``weight``, else confidence, else 0.5), then canonical order."""
    sure = F.coalesce(*[c for c in (weight, F.col("confidence")) if c is not None], F.lit(0.5))
    return rows.withColumn("preference", F.row_number().over(Window.partitionBy(*keys).orderBy(-sure, *canonical_key())) - 1)


def first_by_preference(ranked: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each column its first known value in the order of preference."""
    return ranked.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("preference"))).alias(c) for c in columns])


def merged_lists(ranked: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each array column the distinct values of all rows, in the order of preference and place."""
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("preference", F.coalesce(c, F.array()).alias("v")))), lambda x: x["v"]))
    return ranked.groupBy(*keys).agg(*[F.array_distinct(ordered(c)).alias(c) for c in columns])


def choose_z(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The z_index with the most confidence; ties go to the lower one."""
    votes = rows.groupBy(*keys, "z_index").agg(F.round(F.sum(F.coalesce("confidence", F.lit(0.5))), 9).alias("w"))
    return votes.groupBy(*keys).agg(F.min_by("z_index", F.struct((-F.col("w")).alias("w"), F.col("z_index"))).alias("z_index"))


def contributors(rows: DataFrame, keys: list[str], record: Column) -> DataFrame:
    """Distinct provenance records (as text) of a cluster, in their own order."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(record)).alias("contributors"))


def identities(rows: DataFrame, keys: list[str], record: Column, prefix: str = "page-source:") -> DataFrame:
    """A digest of all records of a page that does not depend on their order. A page's records are held at once."""
    return rows.groupBy(*keys).agg(F.concat(F.lit(prefix), F.sha2(F.array_join(F.array_sort(F.collect_list(record)), ","), 256)).alias("identity"))


def grid_resolution(clusters: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Cells across and down for a page: about four a cluster and 64 at least, in the page's proportions, from 4 to 4096
    each way."""
    cells = F.greatest(F.lit(64), clusters * 4)
    shape = F.greatest(F.lit(0.0001), F.least(F.lit(10_000.0), width / height))
    held = lambda c: F.greatest(F.lit(4), F.least(F.lit(4096), F.ceil(F.sqrt(c)))).cast("long")
    return held(cells * shape), held(cells / shape)


def streamed(rows: DataFrame, page: str, work, schema: str) -> DataFrame:
    """Apply ``work`` (rows of one page as tuples, to tuples) to page after page: pages are dealt out and sorted by Spark, and
    a task holds one page at a time. Rows without a page go."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        held: list = []
        for pdf in frames:
            out: list = []
            pages = pdf[page].to_numpy()
            for at, r in zip(pages, pdf.itertuples(index=False, name=None), strict=True):
                if held and held[0][0] != at:
                    out += work(held[0][0], [x for _, x in held])
                    held = []
                held.append((at, r))
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(work(held[0][0], [x for _, x in held]), columns=names)

    return rows.where(F.col(page).isNotNull()).repartition(page).sortWithinPartitions(page).mapInPandas(run, schema)


def page_components(pairs: DataFrame, page: str) -> DataFrame:
    """page, node and component (the least node that pairs (a, b) lead to) of each page's pairs."""
    kinds = dict(pairs.dtypes)

    def work(at, rows):
        above: dict = {}

        def top(x):
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for _, a, b in rows:
            low, high = sorted((top(a), top(b)))
            above[high] = low
        return [(at, x, top(x)) for x in list(above)]

    return streamed(pairs.select(page, "a", "b"), page, work, f"{page} {kinds[page]}, node {kinds['a']}, component {kinds['a']}")
