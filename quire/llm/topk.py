"""Exact top-k inner products by norm buckets.

Vectors are put into buckets of like length, longest first, and packed as matrices in files of the shared folder.
Each task owns some queries and reads the buckets from the longest on, keeping each query's best k so far: its k-th
score bounds what can still count. With it a bucket has a local cosine threshold for each query: over 1, the bucket
is left out; else either the vectors that are too short for the query are cut off (length pruning), or, where the
threshold is high, those whose coordinates along the query's largest components lie outside their feasible ranges
(coordinate pruning). All that is left is verified with exact products. Neither queries nor buckets are copied by a
shuffle or a broadcast to meet each other.
"""

from __future__ import annotations

from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, listed, mapped, writing

SCALE = 64.0


def _integers(batches, scale: float):
    for batch in batches:
        ids, values = batch.column(0), batch.column(1)
        keep, rows, norms = [], [], []
        for i, v in zip(ids.to_pylist(), values, strict=True):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            x = np.floor(scale * x)
            keep.append(i)
            rows.append(x.astype("<f8").tobytes())
            norms.append(float(np.sqrt((x * x).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(norms, pa.float64()), pa.array(rows, pa.binary())], names=["vec_id", "norm", "vector"])


WHO = ("vec_id", "variant", "copies")
"""What names a distinct row in a block: its id, a hash of its vector, and how many equal rows there are."""


def _pack(size: int, folder: str):
    """Write the rows, which come by dimension and length, in buckets of up to ``size``: a file for each dimension of a task."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ("dim", *WHO, "vector")
        each = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True))
        for dim, rows in groupby(each, itemgetter(0)):
            n = 0
            with writing(f"{folder}/{dim}/{part:08d}") as f:
                while some := list(islice(rows, size)):
                    f.write(_framed(np.array([r[1:-1] for r in some], "<i8"), np.frombuffer(b"".join(r[-1] for r in some), "<f8")))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64())], names=["dim", "buckets"])

    return run


def _framed(ids: np.ndarray, values: np.ndarray) -> bytes:
    """A bucket as bytes: rows, width of a value, ids, values in the narrowest type that holds them exactly."""
    most = np.abs(values).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return np.array([len(ids), np.dtype(kind).itemsize], "<i8").tobytes() + ids.tobytes() + values.astype(kind).tobytes()


def _buckets(folder: str, dim: int, first: int, step: int):
    """The buckets of a dimension with numbers ``first``, ``first + step`` and so on, longest first."""
    number = 0
    for name in listed(f"{folder}/{dim}"):
        data, at = mapped(f"{folder}/{dim}/{name}"), 0
        while at < len(data):
            n, width = np.frombuffer(data, "<i8", 2, at).tolist()
            at += 16
            if number % step == first:
                ids = np.frombuffer(data, "<i8", n * len(WHO), at).reshape(n, len(WHO))
                values = np.frombuffer(data, {2: "<i2", 4: "<i4", 8: "<f8"}[width], n * dim, at + ids.nbytes)
                yield Bucket(ids, values.astype(np.float64).reshape(n, dim))
            at += n * (8 * len(WHO) + width * dim)
            number += 1


def _exact(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products as integers; beyond 2**53 they are taken exactly and held within 64 bits."""
    dim = q.shape[1]
    most = (np.abs(q).max(initial=0)) * (np.abs(p).max(initial=0)) * max(dim, 1)
    if most < 2**53:
        return (q @ p.T).astype(np.int64)
    a = [[int(x) for x in r] for r in q]
    b = [[int(x) for x in r] for r in p]
    return np.array([[min(max(sum(x * y for x, y in zip(r, s, strict=True)), -(2**63)), 2**63 - 1) for s in b] for r in a], np.int64).reshape(len(q), len(p))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], ~scores[some]))[:k]]
    return np.lexsort((ids, ~scores))[:k]


class Fold:
    """The best k candidates of each query that a task has met; what would grow beyond ``most`` rows goes on at once."""

    def __init__(self, k: int, most: int = 500_000):
        self.k, self.most, self.parts, self.size = k, most, [], 0

    def add(self, rows: np.ndarray) -> pa.RecordBatch | None:
        self.parts.append(rows)
        self.size += len(rows)
        if self.size <= 2 * self.most:
            return None
        self.settle()
        return self.out() if self.size > self.most else None

    def settle(self) -> None:
        rows = np.concatenate(self.parts) if self.parts else np.empty((0, len(_FOUND)), np.int64)
        # A query whose id has several vectors meets a candidate several times: its best score counts.
        rows = rows[np.lexsort((~rows[:, 4], rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
        rows = rows[first]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], ~rows[:, 4], rows[:, 0]))]
        heads = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.empty(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(heads, np.diff([*heads.tolist(), len(rows)]))
        self.parts = [rows[place < self.k]]
        self.size = len(self.parts[0])

    def out(self) -> pa.RecordBatch:
        every, self.parts, self.size = np.concatenate(self.parts), [], 0
        return pa.RecordBatch.from_arrays([pa.array(every[:, c]) for c in range(len(_FOUND))], names=[c for c, _ in _FOUND])


class Bucket:
    """A packed bucket and, when first needed, its unit vectors and sorted coordinates."""

    def __init__(self, ids: np.ndarray, p: np.ndarray):
        self.norm = np.sqrt((p * p).sum(1))
        order = np.argsort(-self.norm, kind="stable")
        self.ids, self.p, self.norm = ids[order], p[order], self.norm[order]
        self.unit: np.ndarray | None = None
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if self.unit is None:
            self.unit = self.p / np.maximum(self.norm, 1e-300)[:, None]
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f])
            self.sorted[f] = (order, self.unit[order, f])
        return self.sorted[f]

    def split(self, norms: np.ndarray, bounds: np.ndarray, steep: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query the local cosine threshold (over 1: the bucket is left out), how many vectors are long enough, and
        whether the threshold is so high that coordinates are looked at."""
        with np.errstate(all="ignore"):
            reach = norms * self.norm[0]
            cosine = np.where(reach > 0, bounds / reach - 1e-9, np.inf)
            long = np.searchsorted(-self.norm, -(bounds / norms) * (1 - 1e-9), "right")
        free = (bounds <= 0) | (norms == 0)
        cosine[free], long[free] = -np.inf, len(self.norm)
        return cosine, long, cosine >= steep

    def near(self, cosine: np.ndarray, u: np.ndarray, focus: np.ndarray):
        """For each query (its threshold, its largest coordinates as a unit vector and which they are) the vectors within all
        feasible ranges of these coordinates, or None where no range is shorter than half of the bucket."""
        # A unit vector within the angle has each coordinate in a range about the query's.
        c = cosine[:, None]
        middle, spread = u * c, np.sqrt(np.maximum(0.0, (1 - u**2) * (1 - c**2)))
        lo, hi = np.where(u <= -c, -1.1, middle - spread - 1e-9), np.where(u >= c, 1.1, middle + spread + 1e-9)
        a, b = np.empty(u.shape, np.int64), np.empty(u.shape, np.int64)
        for f in np.unique(focus).tolist():
            at, values = focus == f, self.coordinate(f)[1]
            a[at], b[at] = np.searchsorted(values, lo[at], "left"), np.searchsorted(values, hi[at], "right")
        least = (b - a).argmin(1)
        for j, i in enumerate(least.tolist()):
            if 2 * (b[j, i] - a[j, i]) > len(self.ids):
                yield None
                continue
            some = self.coordinate(int(focus[j, i]))[0][a[j, i] : b[j, i]]
            for n in range(focus.shape[1]):
                if n != i and len(some):
                    x = self.unit[some, focus[j, n]]
                    some = some[(x >= lo[j, n]) & (x <= hi[j, n])]
            yield some


class Best:
    """The best k candidates so far of each of some queries."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k, self.size = own, k, np.zeros(len(own), np.int64)
        self.scores, self.who = np.zeros((len(own), k), np.int64), np.zeros((len(own), k, len(WHO)), np.int64)
        # What is under ``low``, or equals it with an id over ``last``, is not among the best.
        self.low, self.last = np.full(len(own), -(2**63), np.int64), np.full(len(own), 2**63 - 1, np.int64)

    def add(self, j: int, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero(scores >= self.low[j])
        some = some[((scores[some] > self.low[j]) | (ids[some, 0] <= self.last[j])) & (ids[some, 0] != self.own[j])]
        if not len(some):
            return
        n = self.size[j]
        scores, ids = np.concatenate([self.scores[j, :n], scores[some]]), np.concatenate([self.who[j, :n], ids[some]])
        best = _best(scores, ids[:, 0], self.k)
        n = self.size[j] = len(best)
        self.scores[j, :n], self.who[j, :n] = scores[best], ids[best]
        if n == self.k:
            self.low[j], self.last[j] = scores[best[-1]], ids[best[-1], 0]

    def rows(self) -> np.ndarray:
        j, place = np.nonzero(np.arange(self.k) < self.size[:, None])
        return np.column_stack([self.own[j], self.who[j, place], self.scores[j, place]])


_FOUND = [(c, pa.int64()) for c in ("query_id", *WHO, "score")]


def _search(k: int, steep: float, focus: int, block: int, folder: str, slices: int):
    """Queries against every ``slices``-th bucket of their dimension, from the longest on: each query's best k."""

    def meet(dim: int, slice_: int, ids: list[int], rows: list[bytes]) -> np.ndarray:
        q = np.frombuffer(b"".join(rows), "<f8").reshape(len(ids), dim)
        norms, best = np.sqrt((q * q).sum(1)), Best(np.array(ids, np.int64), k)
        unit = q / np.maximum(norms, 1e-300)[:, None]
        largest = np.argsort(-np.abs(unit), 1)[:, :focus]
        unit = np.take_along_axis(unit, largest, 1)
        for bucket in _buckets(folder, dim, slice_, slices):
            cosine, long, high = bucket.split(norms, best.low, steep)
            if (cosine > 1).all():
                break  # what follows is no longer
            whole = (cosine <= 1) & (long == len(bucket.ids)) & ~high
            for j in np.flatnonzero((cosine <= 1) & ~whole & ~high & (long > 0)).tolist():
                best.add(j, _exact(q[j : j + 1], bucket.p[: long[j]])[0], bucket.ids[: long[j]])
            steeper = np.flatnonzero((cosine <= 1) & high)
            pruned = bucket.near(cosine[steeper], unit[steeper], largest[steeper]) if len(steeper) else ()
            for j, some in zip(steeper.tolist(), pruned, strict=True):
                if some is None:
                    whole[j] = True
                elif len(some):
                    best.add(j, _exact(q[j : j + 1], bucket.p[some])[0], bucket.ids[some])
            plain = np.flatnonzero(whole)
            for a in range(0, len(plain), 64):
                rows_ = plain[a : a + 64]
                scores = _exact(q[rows_], bucket.p)
                for i in np.flatnonzero(scores.max(1) >= best.low[rows_]).tolist():
                    best.add(rows_[i], scores[i], bucket.ids)
        return best.rows()

    def run(batches):
        fold, held, n = Fold(k), {}, 0

        def swept():
            for (dim, slice_), (ids, rows) in held.items():
                if full := fold.add(meet(dim, slice_, ids, rows)):
                    yield full
            held.clear()

        for batch in batches:
            for dim, slice_, i, row in zip(*[batch.column(c).to_pylist() for c in ("dim", "slice", "vec_id", "vector")], strict=True):
                ids, rows = held.setdefault((dim, slice_), ([], []))
                ids.append(i)
                rows.append(row)
                n += 1
                if n % (16 * block) == 0:
                    yield from swept()
        yield from swept()
        fold.settle()
        yield fold.out()

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = SCALE, bucket: int = 2048, block: int = 512, steep: float = 0.6, focus: int = 3) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k highest integer inner products of each query.

    ``vectors`` (vec_id, embedding): each component x counts as floor(scale * x). Queries are the rows whose vec_id
    is divisible by ``every``, candidates all rows with another vec_id and the query's dimension. Ties go to the
    smaller vec_id. Rows with a null vec_id, a null vector or null or non-finite components take no part. Rows that
    share a vec_id are one query, for which a candidate counts with its best score, and no candidates of it; of any
    other query each of them is a candidate, equal ones too. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    keep = Workspace(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(lambda b: _integers(b, scale), "vec_id long, norm double, vector binary")
    rows = rows.groupBy("vec_id", "vector").agg(F.first("norm").alias("norm"), F.count(F.lit(1)).alias("copies"))
    rows = keep.save(rows.withColumn("variant", F.xxhash64("vector")).withColumn("dim", (F.octet_length("vector") / 8).cast("int")), "integers")
    order = ["dim", F.col("norm").desc(), "vec_id", "variant"]
    folder = keep.path("buckets")
    keep.save(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pack(bucket, folder), "dim int, buckets long"), "packed")
    # A task has about a block of queries at least, and all buckets; where that would leave tasks idle, a slice of the buckets.
    asked = rows.where(F.col("vec_id") % every == 0)
    groups = max(1, min(parts, -(-asked.count() // block)))
    slices = max(1, parts // groups)
    asked = asked.select("dim", "vec_id", "variant", "vector", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    task = (F.pmod(F.xxhash64("vec_id", "variant"), F.lit(groups)) * slices + F.col("slice")).cast("int")
    asked = asked.repartitionById(groups * slices, task)
    columns = ", ".join(f"{c} long" for c, _ in _FOUND)
    found = keep.save(asked.mapInArrow(_search(k, steep, focus, block, folder, slices), columns), "found")
    keep.drop(rows)
    keep.delete(folder)

    best = found.groupBy("query_id", "vec_id", "variant").agg(F.max("copies").alias("copies"), F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "variant")
    # Equal rows are told apart only as far as ranks need them.
    first = best.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    before = F.coalesce(F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("_before", before).where(F.col("_before") < k)
    each = first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k) - F.col("_before")))))
    each = each.withColumn("rank", (F.col("_before") + F.col("copy")).cast("int")).where(F.col("rank") <= k)
    return each.select("query_id", "rank", "vec_id", "score")
