"""Interpolated modified Kneser-Ney language model of any order from two on, counted in Spark.

A gram of k tokens is a pair of grams of k - 1 tokens: the one that it begins with and the one that it ends with. Ids of
grams are their places in the sorted arrays of a level, so a pair of ids is an exact key of the level above; before a text
stands a beginning, which on each level has the id past all others. A bijection on pairs of ids (a few Feistel rounds) spreads
keys evenly over the shards and within them, so that no frequent word is a hot key. Where two ids have more than 64 bits
together the key has two columns.

Each level is counted in one pass over the texts and one shuffle of packed counts. Then from the highest level down, each
level tells the one below how many grams end with a gram (its continuation count) and how many follow it, seen once, twice
and more often. The model is a folder of sorted arrays that workers map into memory.

With c the counts of a level (of the highest, occurrences; of the others, continuations) and D its discounts:

    p(w|v u) = max(c(v u w) - D(c(v u w)), 0) / c(v u .) + g(v u) p(w|u)       (p(w|u) alone for an unseen context)
    p(w)     = max(c(w) - D(c(w)), 0) / c(.) + g / (V + 1)

so that the probabilities of the V words and of one unknown word add up to 1.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, shared
from .bpe import _shard
from .shared import Workspace

END = np.uint64(0x5851F42D4C957F2D)
"""Stands for the end of a text among word hashes."""


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of equal length, by byte planes, compressed: small numbers cost few bytes."""
    n, head, parts = len(columns[0]), [], []
    for c in columns:
        raw = np.ascontiguousarray(c, "<u8")
        used = -(-int(raw.max()).bit_length() // 8) if n else 0
        head.append(used)
        parts += [raw.view(np.uint8)[k::8].tobytes() for k in range(used)]
    return zstandard.ZstdCompressor(level=1).compress(np.array([n, len(columns), *head], "<u4").tobytes() + b"".join(parts))


def _columns(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, k = np.frombuffer(raw, "<u4", 2).tolist()
    head, at, out = np.frombuffer(raw, "<u4", k, 8).tolist(), 8 + 4 * k, []
    for used in head:
        column = np.zeros(n, "<u8")
        planes = column.view(np.uint8)
        for plane in range(used):
            planes[plane::8] = np.frombuffer(raw, np.uint8, n, at)
            at += n
        out.append(column)
    return out


def pack_keys(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys, as differences, with their other columns."""
    return _planes(np.diff(keys, prepend=np.uint64(0)), *columns)


def unpack_keys(block: bytes) -> list[np.ndarray]:
    keys, *columns = _columns(block)
    return [np.cumsum(keys, dtype=np.uint64), *columns]


class Sums:
    """Sums by a key of one or more 64-bit columns; waiting parts are merged in when they outweigh what is there."""

    def __init__(self, width: int = 1, key: int = 1):
        self.keys, self.sums = [np.empty(0, np.uint64)] * key, [np.empty(0, np.int64) for _ in range(width)]
        self.parts, self.waiting = [], 0

    def __len__(self) -> int:
        return len(self.keys[0])

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.waiting += len(columns[0])
        if self.waiting > max(1 << 20, len(self)):
            self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        key = len(self.keys)
        keys = [np.concatenate([own, *[p[k] for p in self.parts]]) for k, own in enumerate(self.keys)]
        order = np.argsort(keys[0]) if key == 1 else np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        heads = np.flatnonzero(_heads(keys))
        for k in range(len(self.sums)):
            every = np.concatenate([self.sums[k], *[np.asarray(p[key + k], np.int64) for p in self.parts]])[order]
            self.sums[k] = np.add.reduceat(every, heads) if len(heads) else every
        self.keys, self.parts, self.waiting = [k[heads] for k in keys], [], 0


def _heads(keys: list[np.ndarray]) -> np.ndarray:
    """Where sorted keys differ from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def distinct(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct keys, how often each stands there, and where each row's key is."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = _heads(keys)
    heads = np.flatnonzero(first)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(first) - 1
    return [k[heads] for k in keys], np.diff(np.append(heads, len(order))), back


def tokens_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and where each text's tokens begin."""
    words, first = kernel.words_of(buf, offsets)
    n = len(offsets) - 1
    at = first + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = words
    out[~inside] = END
    return out, at


_ROUNDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Pairing:
    """Keys of pairs of ids from 0 to ``most``, and back."""

    def __init__(self, most: int):
        self.half = max(1, int(most).bit_length())
        self.wide = 2 * self.half > 64
        self.bits = self.half if self.wide else 2 * self.half
        self.width = 2 if self.wide else 1

    def _f(self, x: np.ndarray, c: np.uint64) -> np.ndarray:
        y = (x + np.uint64(1)) * c
        return ((y ^ (y >> np.uint64(29))) * _ROUNDS[0]) >> np.uint64(64 - self.half)

    def key(self, before: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
        a, b = before.astype(np.uint64), after.astype(np.uint64)
        for c in _ROUNDS:
            a, b = b, a ^ self._f(b, c)
        return [a, b] if self.wide else [a << np.uint64(self.half) | b]

    def ids(self, key: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if self.wide:
            a, b = key
        else:
            a, b = key[0] >> np.uint64(self.half), key[0] & np.uint64(2**self.half - 1)
        for c in reversed(_ROUNDS):
            a, b = b ^ self._f(a, c), a
        return a.astype(np.int64), b.astype(np.int64)

    def shard(self, key: list[np.ndarray], shards: int) -> np.ndarray:
        """Shard numbers; they grow with the key."""
        top = min(self.bits, 32)
        return ((key[0] >> np.uint64(self.bits - top)) * np.uint64(shards) >> np.uint64(top)).astype(np.int64)


class Keys:
    """Sorted keys of a shard, packed: a table over their highest bits, and what is left of each in few bytes."""

    def __init__(self, raw: np.ndarray):
        n, low, shift, buckets, wide = raw[:40].view("<i8").tolist()
        at = 40
        self.n, self.low, self.shift = n, np.uint64(low), np.uint64(shift)

        def take(count, kind):
            nonlocal at
            out = raw[at : at + count * np.dtype(kind).itemsize].view(kind)
            at += count * np.dtype(kind).itemsize
            return out

        self.index, self.rest = take(buckets + 1, "<u4" if n < 2**32 else "<u8"), []
        for k, kind in self._kinds(shift):
            self.rest.append((np.uint64(k), take(n, kind)))
        self.other = take(n, "<u8") if wide else None
        self.size = at

    @staticmethod
    def _kinds(shift: int) -> list[tuple[int, str]]:
        """First bits and types of the columns that hold so many bits."""
        return [] if not shift else [(0, "<u2")] if shift <= 16 else [(0, "<u4")] if shift <= 32 else [(0, "<u4"), (32, "<u2")] if shift <= 48 else [(0, "<u8")]

    @staticmethod
    def pack(keys: list[np.ndarray]) -> bytes:
        n, h = len(keys[0]), keys[0]
        low = int(h[0]) if n else 0
        span = (int(h[-1]) - low).bit_length() if n else 0
        shift = max(0, span - max(0, (n // 4).bit_length()))
        past = h - np.uint64(low)
        bucket = (past >> np.uint64(shift)).astype(np.int64)
        buckets = int(bucket[-1]) + 1 if n else 0
        parts = [np.array([n, 0, shift, buckets, len(keys) > 1], "<i8"), np.searchsorted(bucket, np.arange(buckets + 1)).astype("<u4" if n < 2**32 else "<u8")]
        parts[0].view("<u8")[1] = low
        rest = past & np.uint64(2**shift - 1)
        parts += [(rest >> np.uint64(k)).astype(kind) for k, kind in Keys._kinds(shift)]
        parts += [k.astype("<u8") for k in keys[1:]]
        return b"".join(p.tobytes() for p in parts)

    def _rest(self, rows) -> np.ndarray:
        if not self.rest:
            return np.zeros(self.n if isinstance(rows, slice) else len(rows), np.uint64)
        out = self.rest[0][1][rows].astype(np.uint64)
        for k, x in self.rest[1:]:
            out |= x[rows].astype(np.uint64) << k
        return out

    def all(self) -> list[np.ndarray]:
        bucket = np.repeat(np.arange(len(self.index) - 1, dtype=np.uint64), np.diff(self.index.astype(np.int64)))
        out = [(bucket << self.shift | self._rest(slice(None))) + self.low]
        return out if self.other is None else [*out, self.other]

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """Rows of the keys, -1 where they are not there."""
        if not self.n:
            return np.full(len(keys[0]), -1, np.int64)
        past = keys[0] - self.low
        bucket = past >> self.shift
        ok = (keys[0] >= self.low) & (bucket < np.uint64(len(self.index) - 1))
        bucket = np.where(ok, bucket, np.uint64(0)).astype(np.int64)
        rest = past & np.uint64((1 << int(self.shift)) - 1)
        lo, end = self.index[bucket].astype(np.int64), self.index[bucket + 1].astype(np.int64)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            held = self._rest(mid)
            less = held < rest[open_]
            if self.other is not None:
                less |= (held == rest[open_]) & (self.other[mid] < keys[1][open_])
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        row = np.minimum(lo, self.n - 1)
        ok &= (lo < end) & (self._rest(row) == rest)
        if self.other is not None:
            ok &= self.other[row] == keys[1]
        return np.where(ok, row, -1)


class Codes:
    """Rows of small numbers: a byte each that names one of the commonest rows; the others are listed."""

    def __init__(self, raw: np.ndarray):
        n, width, common, rare = raw[:32].view("<i8").tolist()
        at = 32
        self.table = raw[at : at + 8 * width * common].view("<i8").reshape(-1, width)
        at += 8 * width * common
        self.where = raw[at : at + 8 * rare].view("<i8")
        at += 8 * rare
        self.other = raw[at : at + 8 * width * rare].view("<i8").reshape(-1, width)
        at += 8 * width * rare
        self.codes = raw[at : at + n]

    @staticmethod
    def pack(columns: list[np.ndarray]) -> bytes:
        n, width = len(columns[0]), len(columns)
        bits = 60 // width
        # A row of small numbers is one number; rows with a larger one are listed.
        key, small = np.zeros(n, np.uint64), np.ones(n, bool)
        for k, c in enumerate(columns):
            small &= c < 1 << bits
            key |= c.astype(np.uint64) << np.uint64(bits * k)
        every, back, times = np.unique(key[small], return_inverse=True, return_counts=True)
        common = np.argsort(-times, kind="stable")[:255]
        code = np.full(len(every), 255, np.uint8)
        code[common] = np.arange(len(common))
        codes = np.full(n, 255, np.uint8)
        codes[small] = code[back]
        where = np.flatnonzero(codes == 255)
        table = np.column_stack([every[common] >> np.uint64(bits * k) & np.uint64(2**bits - 1) for k in range(width)]).astype("<i8")
        parts = [np.array([n, width, len(common), len(where)], "<i8"), table, where.astype("<i8"), np.column_stack([c[where] for c in columns]).astype("<i8"), codes]
        return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    def rows(self, at: np.ndarray) -> np.ndarray:
        codes = self.codes[at]
        out = self.table[np.minimum(codes, max(len(self.table) - 1, 0))] if len(self.table) else np.zeros((len(at), self.table.shape[1]), np.int64)
        rare = np.flatnonzero(codes == 255)
        if len(rare):
            out[rare] = self.other[np.searchsorted(self.where, at[rare])]
        return out


def _deal(columns: list[np.ndarray], shard: np.ndarray) -> pa.RecordBatch:
    """Blocks by shard of rows whose shards ascend."""
    used, cuts = np.unique(shard, return_index=True)
    cuts = [*cuts.tolist(), len(shard)]
    blocks = [pack_keys(*[c[a:b] for c in columns]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(used.tolist(), pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "block"])


def _by_shard(batches, width: int, key: int = 1):
    """(shard, its sums) of blocks whose shards come one after another."""
    number, sums = None, None
    for batch in batches:
        for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != number:
                if sums is not None:
                    sums.settle()
                    yield number, sums
                number, sums = k, Sums(width, key)
            sums.add(*unpack_keys(block))
    if sums is not None:
        sums.settle()
        yield number, sums


class Model:
    """The written levels, their shards memory-mapped when first needed."""

    def __init__(self, folder: str):
        self.folder, self.meta, self.open = folder, json.loads(shared.get(f"{folder}/model.json")), {}
        self.shards, self.tokens = self.meta["shards"], self.meta["tokens"]
        self.base = [None, *[np.concatenate([[0], np.cumsum(np.array(x, np.int64))]) for x in self.meta["sizes"]]]
        self.size = [0, *[int(b[-1]) for b in self.base[1:]]]
        self.pairing = [None, None, *[Pairing(n) for n in self.size[1:]]]

    def file(self, kind: str, level: int, shard: int):
        at = kind, level, shard
        if at not in self.open:
            raw = shared.mapped(f"{self.folder}/{kind}-{level}-{shard:06d}")
            if kind == "words":
                n = len(raw) // 16
                self.open[at] = raw[: 8 * n].view("<u8"), raw[8 * n :].view("<i8")
            else:
                self.open[at] = (Keys if kind == "keys" else Codes)(raw)
        return self.open[at]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for k, a, b in self._parts(_shard(hashes, self.shards), 1):
            held, n = self.file("words", 1, k)
            row = np.minimum(np.searchsorted(held, hashes[a:b]), len(held) - 1)
            ok = held[row] == hashes[a:b]
            ids[a:b] = np.where(ok, row + self.base[1][k], -1)
            counts[a:b] = np.where(ok, n[row], 0)
        return ids, counts

    def _parts(self, shard: np.ndarray, level: int):
        used, cuts = np.unique(shard, return_index=True)
        ends = np.append(cuts[1:], len(shard))[: len(used)]
        for k, a, b in zip(used.tolist(), cuts.tolist(), ends.tolist(), strict=True):
            if self.base[level][k + 1] > self.base[level][k]:
                yield k, a, b

    def grams(self, level: int, keys: list[np.ndarray]) -> np.ndarray:
        """Ids (-1: unknown) of sorted distinct keys of a level."""
        ids = np.full(len(keys[0]), -1, np.int64)
        for k, a, b in self._parts(self.pairing[level].shard(keys, self.shards), level):
            row = self.file("keys", level, k).find([x[a:b] for x in keys])
            ids[a:b] = np.where(row >= 0, row + self.base[level][k], -1)
        return ids

    def rows(self, kind: str, level: int, ids: np.ndarray, width: int) -> np.ndarray:
        """What is written of the ids of a level, 0 where they are unknown."""
        out = np.zeros((len(ids), width), np.int64)
        known = np.flatnonzero(ids >= 0)
        if (np.diff(ids[known]) < 0).any():
            known = known[np.argsort(ids[known], kind="stable")]
        for k, a, b in self._parts(np.searchsorted(self.base[level], ids[known], "right") - 1, level):
            some = known[a:b]
            out[some] = self.file(kind, level, k).rows(ids[some] - self.base[level][k])
        return out

    def walk(self, tokens: np.ndarray, at: np.ndarray, upto: int):
        """Level by level: distinct grams' ids, how often each stands there, where each token's gram is, and the ids of
        what each token's gram begins with (the size of the level below for a beginning). Grams with an unknown part
        share an entry with id -1."""
        hashes, n, back = distinct([tokens])
        ids, counts = self.words(hashes[0])
        yield 1, ids, n, back, None, counts
        own = ids[back]
        for level in range(2, upto + 1):
            before = np.empty(len(own), np.int64)
            before[1:] = own[:-1]
            before[at[:-1]] = self.size[level - 1]
            known = (before >= 0) & (own >= 0)
            keys, n, part = distinct(self.pairing[level].key(before[known], own[known]))
            ids = np.append(self.grams(level, keys), -1)
            back = np.full(len(own), len(ids) - 1, np.int64)
            back[known] = part
            yield level, ids, np.append(n, 0), back, before, keys
            own = ids[back]


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts for counts 0, 1, 2 and 3 or more from counts of counts; where these are too few to tell,
    half, one and one and a half."""
    if not (n1 and n2):
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0, *[min(max(x, 0.05), k - 0.05) for k, x in enumerate(d[1:], 1)]]


def _levels(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, and 3 or more."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)
    return [*n[1:5].tolist(), int(n[3:].sum())]


def fit(train: DataFrame, keep: Workspace, order: int = 3, shards: int | None = None) -> str:
    """Count the model over all rows of ``train`` (text; null: empty) and write it; returns its folder. A task holds
    one shard's counts at a time; the number of shards grows with the input."""
    if order < 2:
        raise ValueError("the order is two at least")
    spark = train.sparkSession
    shards = shards or shared.shards(train)
    folder = keep.path("model")
    texts = train.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    meta = {"order": order, "shards": shards, "tokens": 0, "sizes": []}

    def publish():
        shared.put(f"{folder}/model.json", json.dumps(meta).encode())

    def counted(level: int):
        """Counts of a level's grams over batches of texts, in blocks by shard."""

        def run(batches):
            model = _model(folder, level) if level > 1 else None
            wide = model.pairing[level].width if model else 1
            sums = Sums(key=wide)

            def out():
                sums.settle()
                return _deal([*sums.keys, *sums.sums], model.pairing[level].shard(sums.keys, shards) if model else _shard(sums.keys[0], shards))

            for batch in batches:
                buf, offsets = kernel.strings(batch.column(0))
                for i, j in kernel.slices(offsets, 4 << 20):
                    tokens, at = tokens_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    if model is None:
                        keys, n, _ = distinct([tokens])
                    else:
                        own = None
                        for _, ids, _, back, _, _ in model.walk(tokens, at, level - 1):
                            own = ids[back]
                        before = np.empty(len(own), np.int64)
                        before[1:] = own[:-1]
                        before[at[:-1]] = model.size[level - 1]
                        keys, n, _ = distinct(model.pairing[level].key(before, own))
                    sums.add(*keys, n)
                    if len(sums) > 1 << 22:
                        yield out()
                        sums = Sums(key=wide)
            yield out()

        return run

    def written(level: int):
        """Writes a level's shards; says how many grams, tokens and counts of each size there are."""

        def run(batches):
            wide = _model(folder, level).pairing[level].width if level > 1 else 1
            for number, sums in _by_shard(batches, 1, wide):
                counts = sums.sums[0]
                if level == 1:
                    shared.put(f"{folder}/words-1-{number:06d}", sums.keys[0].astype("<u8").tobytes() + counts.astype("<i8").tobytes())
                else:
                    shared.put(f"{folder}/keys-{level}-{number:06d}", Keys.pack(sums.keys))
                    if level == order:
                        shared.put(f"{folder}/counts-{level}-{number:06d}", Codes.pack([counts]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(sums)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([_levels(counts)], pa.list_(pa.int64()))], names=["shard", "n", "tokens", "levels"])

        return run

    for level in range(1, order + 1):
        blocks = texts.mapInArrow(counted(level), "shard int, block binary")
        made = shared.deal(blocks, shards).mapInArrow(written(level), "shard int, n long, tokens long, levels array<long>").collect()  # a row a shard
        sizes = [0] * shards
        for r in made:
            sizes[r.shard] = r.n
        meta["sizes"].append(sizes)
        meta["tokens"] = sum(r.tokens for r in made)
        top = [sum(x) for x in zip(*[r.levels for r in made], strict=True)] or [0] * 5
        publish()
        keep.tidy()

    def told(level: int):
        """What the grams of a level, shard by shard, say of those of the level below: (id, continuations, sum of the counts of
        grams that begin with it, and how many of these have a count of 1, 2 and more)."""

        def run(batches):
            model = _model(folder, (level, "told"))
            below = model.base[level - 1]
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    n = int(model.base[level][k + 1] - model.base[level][k])
                    if not n:
                        continue
                    before, after = model.pairing[level].ids(model.file("keys", level, k).all())
                    counts = model.file("counts" if level == order else "stats", level, k).rows(np.arange(n))[:, 0]
                    none = np.zeros(n, np.int64)
                    out = Sums(5)
                    for a in range(0, n, 1 << 20):
                        s = slice(a, a + (1 << 20))
                        out.add(after[s].astype(np.uint64), none[s] + 1, none[s], none[s], none[s], none[s])
                        out.add(before[s].astype(np.uint64), none[s], counts[s], counts[s] == 1, counts[s] == 2, counts[s] >= 3)
                    out.settle()
                    # The beginning's id is past all others; it goes to the last shard.
                    shard = np.minimum(np.searchsorted(below, out.keys[0].astype(np.int64), "right") - 1, shards - 1)
                    yield _deal([*out.keys, *out.sums], shard)

        return run

    def noted(level: int):
        """Writes what is said of the grams of a level; says the counts of counts and what follows a beginning."""

        def run(batches):
            model = _model(folder, (level, "noted"))
            for number, sums in _by_shard(batches, 5):
                base, n = int(model.base[level][number]), int(model.base[level][number + 1] - model.base[level][number])
                past = sums.keys[0] >= np.uint64(model.size[level])
                rows = sums.keys[0][~past].astype(np.int64) - base
                table = np.zeros((5, n), np.int64)
                for c in range(5):
                    table[c, rows] = sums.sums[c][~past]
                shared.put(f"{folder}/stats-{level}-{number:06d}", Codes.pack(list(table)))
                begin = [int(x[past].sum()) for x in sums.sums[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([_levels(table[0])], pa.list_(pa.int64())), pa.array([int(table[0].sum())]), pa.array([begin], pa.list_(pa.int64()))], names=["levels", "total", "begin"])

        return run

    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    meta["discounts"], meta["begin"] = [discounts(*top[:4])], []
    for level in range(order, 1, -1):
        numbers = spark.range(0, shards, 1, parts).select(F.col("id").cast("int").alias("shard"))
        blocks = numbers.mapInArrow(told(level), "shard int, block binary")
        said = shared.deal(blocks, shards).mapInArrow(noted(level - 1), "levels array<long>, total long, begin array<long>").collect()  # a row a shard
        levels = [sum(x) for x in zip(*[r.levels for r in said], strict=True)] or [0] * 5
        meta["discounts"].insert(0, discounts(*levels[:4]))
        meta["begin"].insert(0, [sum(x) for x in zip(*[r.begin for r in said], strict=True)] or [0] * 4)
        meta["low"] = {"levels": [levels[0], levels[1], levels[4]], "total": sum(r.total for r in said)}
        keep.tidy()
    publish()
    return folder


_models: dict[tuple, Model] = {}


def _model(folder: str, stage=None) -> Model:
    """The model of a folder; ``stage`` tells apart states of one that is being written."""
    if (folder, stage) not in _models:
        _models.clear()
        _models[folder, stage] = Model(folder)
    return _models[folder, stage]


def log_probabilities(model: Model, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p of each token of the texts that begin at ``at``, and its count in training."""
    m, order = model.meta, model.meta["order"]
    p = seen = total = rest = None
    for level, ids, _, back, before, extra in model.walk(tokens, at, order):
        d = np.array(m["discounts"][level - 1])
        stats = model.rows("counts", level, ids, 1) if level == order else model.rows("stats", level, ids, 5)
        less = np.maximum(stats[:, 0] - d[np.minimum(stats[:, 0], 3)], 0)
        if level == 1:
            seen, all_ = extra[back], m["low"]["total"]
            share = sum(x * n for x, n in zip(d[1:], m["low"]["levels"], strict=True)) / all_ if all_ else 1.0
            p = ((less / all_ if all_ else less * 0.0) + share / (model.size[1] + 1))[back]
        else:
            begins = before == model.size[level - 1]
            first = m["begin"][level - 2]
            total[begins], rest[begins] = first[0], np.array(first[1:]) @ d[1:]
            known = total > 0
            whole = np.where(known, total, 1.0)
            p = np.where(known, less[back] / whole + rest / whole * p, p)
        if level < order:
            # The context of the next level's grams stands at the token before.
            up = np.array(m["discounts"][level])
            total, rest = np.zeros(len(back)), np.zeros(len(back))
            total[1:], rest[1:] = stats[:, 1][back[:-1]], (stats[:, 2:] @ up[1:])[back[:-1]]
    return np.log10(p), seen


_SCORES = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())]


def score(docs: DataFrame, folder: str) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text, held_out) with a written model: n_tokens, n_known (seen in
    training), train_tokens, base_score (add-one unigrams), score (log10 probability) and perplexity per token.
    A null text is empty: its end alone is scored. Null and repeated doc_ids are kept."""

    def run(batches):
        model = _model(folder)
        n, v = model.tokens, model.size[1]
        for batch in batches:
            buf, offsets = kernel.strings(batch.column(2))
            for i, j in kernel.slices(offsets, 4 << 20):
                tokens, at = tokens_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                logs, counts = log_probabilities(model, tokens, at)
                base = np.log10((counts + 1) / (n + v + 1))
                size, total = np.diff(at), np.add.reduceat(logs, at[:-1])
                own = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)]
                cols = [size, np.add.reduceat((counts > 0).astype(np.int64), at[:-1]), np.full(j - i, n), np.add.reduceat(base, at[:-1]), total, 10 ** (-total / size)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, (_, t) in zip(cols, _SCORES[2:], strict=True)]], names=[c for c, _ in _SCORES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out").cast("boolean").alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(docs: DataFrame, fold: int = 2, folds: int = 7) -> DataFrame:
    """Mark the rows whose crc32 of the doc_id as text has remainder ``fold``; a null doc_id counts as an empty text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", "text", (F.crc32(name.cast("binary")) % folds == fold).alias("held_out"))


def perplexity(docs: DataFrame, fold: int = 2, folds: int = 7, order: int = 3) -> DataFrame:
    """Learn a model of the order from all rows outside the fold, score all rows. A null text is empty and has its end alone;
    repeated rows are learned and scored each; null doc_ids are kept; without training rows every token has the
    probability of an unknown word; an empty table gives no rows; a word may be as long as a text."""
    marked = held_out(docs, fold, folds)
    return score(marked, fit(marked.where(~F.col("held_out")), Workspace(docs.sparkSession), order))
