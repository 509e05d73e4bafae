"""Best-fit packing of token sequences (bulk-synchronous).

Documents are encoded once; what is packed are rows of a few numbers. Each round range-sorts the pieces
still to place together with the gaps of the open sequences, largest first. A sweep through each range
gives every piece the smallest gap in the range that holds it (its successor), and puts what is left of the
gap back. Pieces that found no gap in their range and the gaps that found no piece are counted by size
(no more than ``capacity`` sizes and one more per range), the counts are matched across ranges from the
largest size down, and the k-th piece of a size takes the k-th place in the gaps of the matched size:
conflicts are resolved by rank. Gaps are updated, the largest pieces without any gap open new
sequences, and the next round begins. Only counts by size reach the driver. The result is the union of what each
round placed, so the rounds' tables stay until it is read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .pieces import encoder
from .shared import Workspace, giving_back

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ROWS = "kind int, size int, seq long, doc_id long, piece int, start long, length long, ids_crc32 long, offset long, place long"
#: kind: 0 a gap (seq, size), 1 a piece still to place, 2 a placed piece.


def _encoding(vocabulary: str, capacity: int, end_id: int):
    """Rows of PIECES of batches of doc_id and text."""

    def run(batches):
        enc = encoder(vocabulary, True)
        for batch in batches:
            buf, offsets = kernel.strings(batch.column(1))
            ids_in = batch.column(0).to_pylist()
            for i, j in kernel.slices(offsets):
                ids, counts = enc.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, rows = 0, []
                for d, n in zip(ids_in[i:j], counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    lead = len(own) % capacity or capacity
                    begin, piece = 0, 0
                    while begin < len(own):
                        stop = lead if piece == 0 else begin + capacity
                        rows.append((d, piece, begin, stop - begin, zlib.crc32(own[begin:stop].tobytes())))
                        begin, piece = stop, piece + 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Encode ``text`` (null: empty), append ``end_id``, cut documents longer than ``capacity`` into pieces of
    ``capacity`` ids, the first of which may be shorter. Returns doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(giving_back(_encoding(vocabulary, capacity, end_id)), PIECES)


def _sweep(capacity: int):
    """Best fit within one range, largest first; yields the rows with what the sweep did to them, and for
    each row left over its place among those of its kind and size in this range."""

    def run(frames):
        part = TaskContext.get().partitionId()
        gaps: dict[int, list] = defaultdict(list)
        mask = 0
        left: dict[tuple[int, int], int] = defaultdict(int)
        for pdf in frames:
            cols = {c: pdf[c].to_numpy(copy=True) for c in ("kind", "size", "seq", "offset", "place")}
            keep = np.ones(len(pdf), bool)
            for i, (kind, size, seq) in enumerate(zip(cols["kind"].tolist(), cols["size"].tolist(), cols["seq"].tolist(), strict=True)):
                if kind == 0:
                    gaps[size].append(seq)
                    mask |= 1 << size
                    keep[i] = False
                    continue
                fit = mask >> size
                if fit:
                    free = size + (fit & -fit).bit_length() - 1
                    own = gaps[free]
                    seq = own.pop()
                    if not own:
                        mask ^= 1 << free
                    rest = free - size
                    if rest:
                        gaps[rest].append(seq)
                        mask |= 1 << rest
                    cols["kind"][i], cols["seq"][i], cols["offset"][i] = 2, seq, capacity - free
                else:
                    cols["place"][i] = left[1, size]
                    left[1, size] += 1
            out = pdf.assign(**cols, part=np.int32(part))
            yield out[keep]
        import pandas as pd

        for free, seqs in gaps.items():
            for i in range(0, len(seqs), 100_000):
                some = seqs[i : i + 100_000]
                out = pd.DataFrame({"kind": np.zeros(len(some), np.int32), "size": np.int32(free), "seq": np.array(some, np.int64)})
                for c in ("doc_id", "piece", "start", "length", "ids_crc32", "offset"):
                    out[c] = np.zeros(len(some), np.int32 if c == "piece" else np.int64)
                out["place"] = np.arange(i, i + len(some), dtype=np.int64)
                out["part"] = np.int32(part)
                yield out

    return run


def _plan(total: dict, capacity: int) -> list:
    """Match sizes of pieces, largest first, with the smallest size of gap that still has unused gaps.

    ``total``: numbers of rows by (kind, size). Returns the matches (size, first rank, end rank, gap size, first gap
    rank, pieces a gap) with gap size 0 for a new sequence.
    """
    gaps = {s: n for (k, s), n in total.items() if k == 0}
    used: dict[int, int] = defaultdict(int)
    matches, lost = [], []
    for size in sorted((s for k, s in total if k == 1), reverse=True):
        rank, n = 0, total[1, size]
        for free in sorted(g for g in gaps if g >= size):
            room = gaps[free] - used[free]
            if room <= 0 or rank == n:
                continue
            each = free // size
            take = min(room, -(-(n - rank) // each))
            end = min(n, rank + take * each)
            matches.append((size, rank, end, free, used[free], each))
            used[free] += take
            rank = end
        if rank < n:
            lost.append((size, rank, n))
    # Pieces of more than half the capacity never share a sequence, so each opens one. Smaller ones wait until
    # no gap takes any of them; then the largest open as many as the rest need at least.
    large = [(s, r, n) for s, r, n in lost if 2 * s > capacity]
    if large or not matches:
        opened, more = 0, sum(n - r for _, r, n in large) or -(-sum(s * (n - r) for s, r, n in lost) // capacity)
        for size, rank, n in large or lost:
            take = min(n - rank, more - opened)
            if take > 0:
                matches.append((size, rank, rank + take, 0, opened, 1))
                opened += take
    return matches


def _matched(pdf, matches: list):
    """Gap size (0: a new sequence, -1: none), place among these gaps and offset in the gap of pieces with their ranks."""
    size, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
    gap, slot, where = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    table = np.array(sorted(matches), np.int64).reshape(-1, 6)
    # Matches of one size hold consecutive ranks: the last that begins at or before a rank is the only candidate.
    for s in np.unique(size).tolist():
        own, rows = table[table[:, 0] == s], np.flatnonzero(size == s)
        at = np.searchsorted(own[:, 1], rank[rows], "right") - 1
        ok = (at >= 0) & (rank[rows] < own[np.maximum(at, 0), 2]) if len(own) else np.zeros(len(rows), bool)
        rows, m = rows[ok], own[at[ok]]
        past = rank[rows] - m[:, 1]
        gap[rows], slot[rows], where[rows] = m[:, 3], m[:, 4] + past // m[:, 5], past % m[:, 5] * s
    return gap, slot, where


def pack(pieces: DataFrame, capacity: int = 2048, ranges: int | None = None, keep: Workspace | None = None) -> DataFrame:
    """Pack pieces (doc_id, piece, start, length, ids_crc32) into sequences of at most ``capacity`` ids.

    Adds sequence_id and offset (gapless from 0 within a sequence). Repeated rows are packed each for itself;
    ties in size go by doc_id, piece and start; an empty table gives an empty one. Pieces of length 0 or more
    than ``capacity`` are an error. Hot sizes cost nothing, as the range sort goes on by id within a size.
    """
    spark = pieces.sparkSession
    keep = keep or Workspace(spark)
    zero = F.lit(0).cast("long")
    source = keep.save(pieces, "pieces")
    bad = source.where((F.col("length") <= 0) | (F.col("length") > capacity)).limit(1).count()
    if bad:
        raise ValueError(f"pieces must hold from 1 to {capacity} ids")
    names = [c.split()[0] for c in _ROWS.split(", ")]
    state = source.select(F.lit(1).alias("kind"), F.col("length").cast("int").alias("size"), zero.alias("seq"), "doc_id", "piece", "start", "length", "ids_crc32", zero.alias("offset"), zero.alias("place"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    done, serial, smallest = [], 0, 1
    while True:
        order = [F.col("size").desc(), F.col("kind"), F.col("seq"), F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
        swept = keep.save(state.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(giving_back(_sweep(capacity)), _ROWS + ", part int"), "swept")
        done.append(swept.where("kind = 2").select("doc_id", "piece", "start", "length", "ids_crc32", "seq", "offset"))
        counts = keep.save(swept.where("kind < 2").groupBy("kind", "size", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
        # At most two rows a size reach the driver.
        total = defaultdict(int, {(r.kind, r["size"]): r.n for r in counts.groupBy("kind", "size").agg(F.sum("n").alias("n")).collect()})
        if not any(k == 1 for k, _ in total):
            break
        smallest = min(s for k, s in total if k == 1)
        matches = _plan(total, capacity)
        # A row's rank among all of its kind and size: its place in its range, after those of the ranges before.
        before = Window.partitionBy("kind", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        firsts = counts.select("kind", "size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        firsts = F.broadcast(firsts) if counts.count() <= 200_000 else firsts
        left = swept.where(f"kind = 1 or kind = 0 and size >= {smallest}").join(firsts, ["kind", "size", "part"]).withColumn("rank", F.col("place") + F.col("first")).select(*names, "rank")

        def to_gaps(frames, matches=matches, serial=serial):
            """Pieces get the gap (size, rank) they were matched with; new sequences get their number."""
            for pdf in frames:
                gap, slot, where = _matched(pdf, matches)
                kind = np.where(gap < 0, 1, np.where(gap == 0, 2, 3)).astype(np.int32)
                yield pdf.assign(kind=kind, seq=np.where(kind == 2, serial + slot, 0), offset=np.where(kind == 2, 0, where), gap=gap, slot=slot)[[*names, "gap", "slot"]]

        serial += sum(hi - lo for _, lo, hi, free, _, _ in matches if free == 0)
        items = left.where("kind = 1").mapInPandas(to_gaps, _ROWS + ", gap long, slot long")
        gaps = left.where("kind = 0").select(F.col("size").cast("long").alias("gap"), F.col("rank").alias("slot"), F.col("seq").alias("into"))
        met = items.join(gaps, ["gap", "slot"], "left")
        met = met.select(*[c for c in names if c not in ("seq", "offset")], F.coalesce("into", "seq").alias("seq"), F.when(F.col("kind") == 3, capacity - F.col("gap") + F.col("offset")).otherwise(F.col("offset")).alias("offset"))
        met = keep.save(met.withColumn("kind", F.least(F.col("kind"), F.lit(2))), "met")
        keep.drop(counts)
        placed = met.where("kind = 2")
        done.append(placed.select("doc_id", "piece", "start", "length", "ids_crc32", "seq", "offset"))
        filled = placed.groupBy("seq").agg(F.max(F.col("offset") + F.col("length")).alias("used"))
        old = swept.where(f"kind = 0 and size >= {smallest}").select("seq", (F.lit(capacity) - F.col("size")).cast("long").alias("used"))
        open_ = filled.union(old).groupBy("seq").agg(F.max("used").alias("used")).where(F.col("used") <= capacity - smallest)
        gap_rows = open_.select(F.lit(0).alias("kind"), (F.lit(capacity) - F.col("used")).cast("int").alias("size"), "seq", *[F.lit(0).cast("int" if c == "piece" else "long").alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "offset", "place")])
        rest = met.where("kind = 1").select(*names).withColumn("seq", zero).withColumn("offset", zero).withColumn("place", zero)
        state = rest.unionByName(gap_rows)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


def best_fit_pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Encode and pack whole documents (doc_id, text). A null text is empty and packs its end id alone; a null
    doc_id is kept; repeated rows are packed each; other columns are ignored; an empty table gives no rows; a word
    may be as long as a text."""
    keep = Workspace(docs.sparkSession)
    return pack(token_pieces(docs, vocabulary, capacity, end_id), capacity, keep=keep)
