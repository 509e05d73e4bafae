"""Near-duplicate documents by a grouped prefix join over word shingles.

Documents with equal shingle sets are one class. In a common order of shingles (those known as frequent last,
else by hash) a class's prefix is so long that two classes that link share a prefix shingle. Classes with
the same prefix and size are one group; only group leaders are expanded into prefix shingles, and pairs of
groups are kept where sizes, places in the order and the number of shared prefix shingles allow a link. Kept pairs are expanded to their classes
and verified on the whole sets.

No list of a shingle is ever expanded into all its pairs at once. First each group in a list is paired
with the list's pivot, and each class with its group's leader; links found so give components. Large
lists that still hold several components pair their members with a few hubs. Only then are pairs made in the lists (and
groups) that hold several components even now, and only between these, so a large group of near copies costs
a few pairs a copy, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel, shared
from .components import components
from .shared import Workspace


def _sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = kernel.words_of(buf, offsets)
    at = first.tolist()
    return [np.unique(kernel.shingle_hashes(words[a:b], k)) for a, b in zip(at[:-1], at[1:], strict=True)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


LOOK_BACK = 6
"""How many shingles before its own a row of a list carries."""
LARGE = 64
"""From what size on a list is given hubs."""
HUBS = 16
"""With how many members of a list all its members are paired before lists are joined with themselves."""


def frequent_shingles(docs: DataFrame, k: int, most: int = 1 << 17, within: int = 3) -> np.ndarray:
    """Up to ``most`` shingles that several documents share within some batch of a task, rarest first. Only the
    order of shingles depends on this list, never the result."""

    def run(batches):
        for batch in batches:
            buf, offsets = kernel.strings(batch.column(1))
            for i, j in kernel.slices(offsets, 4 << 20):
                every, n = np.unique(np.concatenate(_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)), return_counts=True)
                top = np.flatnonzero(n >= within)
                if len(top) > most // 16:
                    top = np.sort(top[np.argsort(-n[top], kind="stable")[: most // 16]])
                yield pa.RecordBatch.from_arrays([pa.array(every[top].view(np.int64)), pa.array(n[top])], names=["h", "n"])

    rows = _texts(docs).mapInArrow(shared.giving_back(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "h").limit(most)
    with shared.small_batches(docs.sparkSession):
        got = rows.toArrow()
    return got.column("h").to_numpy().view(np.uint64)[::-1].copy()


def describe(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per document: n (set size), cls (fingerprint of the set), grp (of prefix and size), prefix and sketch (the set's
    bits in a table of two to four bits a shingle)."""
    order = np.argsort(frequent)
    held, rank = frequent[order], order.astype(np.int64) + 1

    def run(batches):
        for batch in batches:
            buf, offsets = kernel.strings(batch.column(1))
            for i, j in kernel.slices(offsets, 2 << 20):
                n, cls, grp, prefix, sketch = [], [], [], [], []
                for s in _sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    n.append(len(s))
                    if not len(s):
                        cls.append(None)
                        grp.append(None)
                        sketch.append(None)
                        prefix.append([])
                        continue
                    take = len(s) - -(-percent * len(s) // 100) + 1
                    if len(held):
                        at = np.minimum(np.searchsorted(held, s), len(held) - 1)
                        late = np.where(held[at] == s, rank[at], 0)
                        first = s[late == 0][:take]
                        if len(first) < take:
                            rest = np.flatnonzero(late)
                            first = np.concatenate([first, s[rest[np.argsort(late[rest], kind="stable")][: take - len(first)]]])
                    else:
                        first = s[:take]
                    cls.append(_print(s))
                    grp.append(_print(np.append(first, np.uint64(len(s)))))
                    prefix.append(first.view(np.int64))
                    sketch.append(_sketch(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(grp, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n", "cls", "grp", "prefix", "sketch"]
                )

    return _texts(docs).mapInArrow(shared.giving_back(run), "doc_id long, n long, cls long, grp long, prefix array<long>, sketch binary")


def _sketch(s: np.ndarray) -> bytes:
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    table = np.zeros(bits, bool)
    table[(s % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(table).tobytes()


def _sift(pairs: DataFrame, classes: DataFrame, percent: int, keep: Workspace) -> DataFrame:
    """The pairs (a, b) that their sketches leave possible: a bit of one set that the other lacks is a shingle that it lacks,
    so the intersection is at most each set's size less its bits of its own. Larger sketches are folded to the smaller's
    size."""

    def run(batches):
        for batch in batches:
            ok = []
            for n, x, n2, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                x, y = (np.bitwise_or.reduce(v.reshape(-1, size), 0) for v in (x, y))
                both = min(n - int(np.bitwise_count(x & ~y).sum()), n2 - int(np.bitwise_count(y & ~x).sum()))
                ok.append((100 + percent) * both >= percent * (n + n2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    few = F.broadcast(pairs) if pairs.count() <= 200_000 else pairs
    one = classes.select(F.col("cls").alias("a"), "n", "sketch").join(few, "a")
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2")).join(few, "b")
    met = one.join(two, ["a", "b"]).select("a", "b", "n", "sketch", "n2", "sketch2")
    return keep.save(met.mapInArrow(shared.giving_back(run), "a long, b long"), "sifted")


def _print(values: np.ndarray) -> int:
    """A 64-bit fingerprint of a sequence of hashes."""
    place = np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(kernel.mix(np.array([kernel.mix(values + place).sum(dtype=np.uint64)]))[0].view(np.int64))


def _bloom(keys: DataFrame, keep: Workspace, bits: int) -> str:
    """A bit table of the ids, written to the shared folder by one task from compact parts."""
    at = keep.path("bloom")

    def part(batches):
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for h in _bloom_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                np.bitwise_or.at(table, h >> 3, (1 << (h & 7)).astype(np.uint8))
        import zstandard

        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(table.tobytes())], pa.binary())], names=["part"])

    def merge(batches):
        import zstandard

        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                table |= np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
        shared.put(at, table.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], names=["done"])

    keys.coalesce(16).mapInArrow(part, "part binary").coalesce(1).mapInArrow(merge, "done int").collect()
    return at


def _bloom_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = kernel.mix(ids.view(np.uint64))
    return [((h >> np.uint64(20 * r)) % np.uint64(bits)).astype(np.int64) for r in range(3)]


def _load_sets(docs: DataFrame, needed: DataFrame, k: int, keep: Workspace) -> DataFrame:
    """cls, n and the packed set of the needed documents (doc_id, one for each class). A bit table tells most
    others apart before their shingles are made; the joins that follow leave out the rest."""
    count = needed.count()
    bits = 1 << min(26, max(13, int(12 * count).bit_length()))
    at = _bloom(needed.select("doc_id"), keep, bits)

    def run(batches):
        table = shared.mapped(at)
        for batch in batches:
            ids = batch.column(0)
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = ids.is_valid().to_numpy(zero_copy_only=False)
            for h in _bloom_places(keys, bits):
                hit = hit & ((table[h >> 3] >> (h & 7).astype(np.uint8)) & 1).astype(bool)
            some = batch.filter(pa.array(hit))
            buf, offsets = kernel.strings(some.column(1))
            for i, j in kernel.slices(offsets, 2 << 20):
                sets = _sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                yield pa.RecordBatch.from_arrays([some.column(0).slice(i, j - i), pa.array([_print(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "cls", "shingles"])

    rows = _texts(docs).mapInArrow(shared.giving_back(run), "doc_id long, cls long, shingles binary")
    return keep.save(rows.join(F.broadcast(needed) if count <= 100_000 else needed, ["doc_id", "cls"], "left_semi").select("cls", "shingles"), "sets")


def _verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, first: DataFrame, k: int, percent: int, keep: Workspace) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link; sketches leave most others out first."""
    pairs = _sift(pairs, classes, percent, keep)
    needed = keep.save(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(first, "cls").select("cls", "doc_id"), "needed")
    sets = _load_sets(docs, needed, k, keep)

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    met = pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    links = keep.save(met.select("a", "b", "x", "y").mapInArrow(shared.giving_back(run), "a long, b long"), "links")
    keep.drop(needed, sets)
    return links


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of distinct k-word shingles (A-Z
    in lower case; a text with fewer words is one shingle). component_id is the least doc_id reachable by links. A
    null or empty text, or one without words, has an empty set and links with nothing. A row with a null doc_id
    takes part in no links and has a null component_id. Rows that share a doc_id are judged each by its text.
    """
    spark = docs.sparkSession
    keep = Workspace(spark)
    frequent = frequent_shingles(docs, k)
    described = keep.save(describe(docs, k, percent, frequent), "described")
    rows = described.where("n > 0 and doc_id is not null")
    first = keep.save(rows.groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "first")
    classes = keep.save(rows.select("cls", "n", "grp", "prefix", "sketch").dropDuplicates(["cls"]), "classes")
    every = keep.save(described.select("doc_id", "n", "cls"), "rows")
    keep.drop(described)
    groups = keep.save(classes.groupBy("grp").agg(F.min("cls").alias("leader"), F.count(F.lit(1)).alias("members")), "groups")
    leaders = keep.save(classes.join(groups.select(F.col("leader").alias("cls")), "cls").select("grp", "n", "cls", "prefix"), "leaders")
    lists = leaders.select("grp", "n", F.posexplode("prefix").alias("pos", "shingle"))
    pivots = keep.save(lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("pos", "grp", "n")).alias("p")).where("size > 1"), "pivots")
    keep.tidy()
    met = keep.save(lists.join(pivots.select("shingle", "p"), "shingle"), "lists")
    large = keep.save(pivots.where(F.col("size") >= LARGE).select("shingle"), "large")
    keep.drop(pivots)
    keep.tidy()
    # Each row knows the few shingles before it: a pair that has one of them in common was made in that list.
    before = F.slice("prefix", F.greatest(F.lit(1), F.col("pos") - (LOOK_BACK - 1)), F.least(F.col("pos"), F.lit(LOOK_BACK)))
    rows = keep.save(met.select("shingle", "grp", "n", "pos").join(leaders.select("grp", "prefix"), "grp").select("shingle", "grp", "n", "pos", before.alias("before")), "list-rows")

    def possible(n1, i, n2, j):
        """A first common shingle at these places leaves room for a link; so no two sizes too far apart pass."""
        room = 1 + F.least(F.col(n1) - 1 - F.col(i), F.col(n2) - 1 - F.col(j))
        return (100 + percent) * room >= percent * (F.col(n1) + F.col(n2))

    def lacking(n1, n2, shared):
        """How many more prefix shingles than ``shared`` two sets need in common: what follows the prefix that ends
        first can add no more than its own size."""
        after = F.ceil(percent * F.greatest(n1, n2) / 100) - 1
        return F.ceil(percent * (F.col(n1) + F.col(n2)) / (100 + percent)) - after - F.col(shared)

    def ordered(a, b):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    # Pivots only save work, so pairs that share little through one pivot are left to the later passes.
    stars = met.where("grp <> p.grp").where(possible("n", "pos", "p.n", "p.pos")).groupBy("grp", "n", "p.grp", "p.n").agg(F.count(F.lit(1)).alias("shared"))
    stars = stars.toDF("grp", "n1", "grp2", "n2", "shared").where(lacking("n1", "n2", "shared") <= F.col("shared")).select("grp", "grp2")
    names = leaders.select("grp", F.col("cls").alias("c1"))
    stars = stars.join(names, "grp").join(names.toDF("grp2", "c2"), "grp2").select(*ordered("c1", "c2"))
    inside = classes.join(groups.where("members > 1"), "grp").where("cls <> leader").select(*ordered("cls", "leader"))
    tried = keep.save(stars.union(inside).distinct(), "stars")
    keep.drop(met)
    links = _verify(docs, tried, classes, first, k, percent, keep)
    found = keep.save(components(links, keep), "components")
    keep.tidy()

    prefixes = leaders.select("grp", "n", "prefix")

    def open_rows(found, rows):
        """What is left open: classes with their components, groups with their least and greatest, and the rows of the
        lists that hold several components."""
        of = classes.select("cls", "n", "grp").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        of = keep.save(of, "classes-of")
        spans = keep.save(of.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high")), "spans")
        spread = rows.join(spans, "grp")
        mixed = keep.save(spread.groupBy("shingle").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("shingle"), "mixed")
        left = keep.save(spread.select("shingle", "grp", "n", "pos", "low", "high", "before").join(mixed, "shingle", "left_semi"), "open")
        keep.drop(mixed)
        return of, spans, left

    def other(rows):
        return rows.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("grp", "n", "pos", "low", "high", "before")])

    def meet(left, right, which):
        """Pairs of groups of one list. Places and sizes tell most apart; the rest must share enough of their prefixes."""
        pairs = left.join(right, "shingle").where(which).where("not (low = high and low2 = high2 and low = low2)")
        pairs = pairs.where(possible("n", "pos", "n2", "pos2")).where(~F.arrays_overlap("before", "before2")).select("grp", "grp2").distinct()
        pairs = keep.save(pairs, "pairs")
        # Up to 200,000 pairs of ids are broadcast, so that prefixes stay where they are; more are shuffled.
        few = F.broadcast(pairs) if pairs.count() <= 200_000 else pairs
        one, two = prefixes.join(few, "grp"), prefixes.toDF("grp2", "n2", "prefix2").join(few, "grp2")
        both = one.join(two, ["grp", "grp2"]).withColumn("shared", F.size(F.array_intersect("prefix", "prefix2")))
        return both.where(lacking("n", "n2", "shared") <= 0).select("grp", "grp2")

    def expanded(pairs, of, tried):
        """Pairs of classes of different components, for pairs of groups, that were not verified yet."""
        one = of.select("grp", F.col("cls").alias("c1"), F.col("component").alias("k1"))
        two = of.select(F.col("grp").alias("grp2"), F.col("cls").alias("c2"), F.col("component").alias("k2"))
        return pairs.join(one, "grp").join(two, "grp2").where("k1 <> k2").select(*ordered("c1", "c2")).distinct().join(tried, ["a", "b"], "left_anti")

    # A large group of near copies of which only some pairs link: each meets up to HUBS members of its lists, those
    # with the fewest rare shingles before the shared one, which stand nearest to the original.
    few = F.broadcast(large) if large.count() <= 200_000 else large
    of, spans, left = open_rows(found, keep.save(rows.join(few, "shingle", "left_semi"), "large-rows"))
    hubs = left.withColumn("_n", F.row_number().over(Window.partitionBy("shingle").orderBy("pos", F.xxhash64("grp"), "grp"))).where(F.col("_n") <= HUBS).drop("_n")
    second = keep.save(expanded(meet(left, other(hubs), "grp <> grp2"), of, tried), "hubs")
    links = keep.save(links.union(_verify(docs, second, classes, first, k, percent, keep)), "links")
    tried = keep.save(tried.union(second), "tried")
    keep.drop(of, spans, left, found, second)
    found = keep.save(components(links, keep), "components")
    keep.tidy()

    # Whatever is still open: all pairs of different components in one list or group. Of two sizes the smaller
    # needs the shorter prefix.
    of, spans, left = open_rows(found, rows)
    short = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))
    across = meet(left, other(left.where(F.col("pos") <= short)), "(n > n2 or n = n2 and grp < grp2)")
    within = spans.where("low < high").select("grp", F.col("grp").alias("grp2"))
    more = keep.save(expanded(across.union(within), of, tried), "rest")
    if more.limit(1).count():
        links = links.union(_verify(docs, more, classes, first, k, percent, keep))
        found = keep.save(components(links, keep), "components")

    of = first.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = keep.save(of.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    table = keep.save(of.join(least, "component").select("cls", "component_id"), "table")
    out = every.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")).join(table, "cls", "left")
    keep.drop(classes, groups, leaders, rows, left, spans)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those with its least doc_id. Rows with a null doc_id
    stay; of rows that share a doc_id all stay if one of them does."""
    found = near_duplicates(docs.select("doc_id", "text"), k, percent)
    gone = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
