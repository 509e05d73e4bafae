"""Byte-pair encoding and decoding by a table of distinct words.

Spark tasks split the texts into the pieces between which the tokenizer always cuts; every task keeps each
distinct piece once, pieces are dealt by hash into shards, and each shard encodes its distinct pieces once
and is written as sorted hash arrays. Encoding maps these arrays into memory and joins ids back by position (a
join on the map side: hashes find rows, a second hash confirms them). Decoding joins ids with a table of pieces (its
size is the vocabulary's) and puts the bytes together.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, shared
from .pieces import Batch, Pieces, bounds, encode_pieces, encode_whole, gather, rows_in, tokenizer
from .shared import Workspace


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard numbers; they grow with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _bytes_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = np.empty(2 * len(starts), np.int64)
    at[0::2], at[1::2] = starts, ends
    return gather(buf, at, np.arange(0, 2 * len(starts), 2))[0]


def _blocks(vocabulary: str, shards: int, most: int = 1_000_000):
    """Distinct pieces of a task's texts, packed by shard: lengths, then bytes, compressed."""

    def run(batches):
        seen = np.empty(0, np.uint64)
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            buf, offsets = kernel.strings(batch.column(0))
            for i, j in kernel.slices(offsets, 2 << 20):
                own, ends_at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, _ = bounds(vocabulary, own, ends_at)
                distinct, where = np.unique(kernel.span_hashes(own, starts, ends), return_index=True)
                if len(seen):
                    row = np.minimum(np.searchsorted(seen, distinct), len(seen) - 1)
                    new = seen[row] != distinct
                    distinct, where = distinct[new], where[new]
                if not len(distinct):
                    continue
                seen = distinct if len(seen) > most else np.sort(np.concatenate([seen, distinct]), kind="stable")
                used, cuts = np.unique(_shard(distinct, shards), return_index=True)
                rows = list(zip(used.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(distinct)], strict=True))
                data = []
                for _, a, b in rows:
                    w = where[a:b]
                    raw = np.uint32(b - a).tobytes() + (ends[w] - starts[w]).astype("<u4").tobytes() + _bytes_of(own, starts[w], ends[w]).tobytes()
                    data.append(squeeze.compress(raw))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.int32()), pa.array(data, pa.binary())], names=["shard", "block"])

    return run


def build_word_table(docs: DataFrame, keep: Workspace, vocabulary: str = "byte_bpe_50k.json", shards: int | None = None) -> str:
    """Write the table of all distinct pieces of ``docs.text``; returns its folder. A task holds one shard at a time,
    and the number of shards grows with the input."""
    shards = shards or shared.shards(docs)
    folder = keep.path("words")

    def settled(loose):
        """One of each piece: bytes, starts, ends, hashes."""
        own, lens = np.concatenate([x for x, _ in loose]), np.concatenate([n for _, n in loose])
        e = np.cumsum(lens)
        s = e - lens
        hashes, where = np.unique(kernel.span_hashes(own, s, e), return_index=True)
        body, lens = _bytes_of(own, s[where], e[where]), lens[where]
        return body, np.cumsum(lens) - lens, np.cumsum(lens), hashes

    def write(number, loose):
        body, starts, ends, hashes = settled(loose)
        raw = body.tobytes()
        ids, lens = encode_pieces(vocabulary, [raw[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        at = np.concatenate([[0], np.cumsum(lens)])
        columns = [np.array([len(hashes)], "<i8"), hashes.astype("<u8"), kernel.span_checks(body, starts, ends).astype("<u8"), at.astype("<i8"), ids.astype("<u4")]
        shared.put(f"{folder}/shard-{number:06d}", b"".join(c.tobytes() for c in columns))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(hashes)], pa.int64())], names=["shard", "n"])

    def merge(batches):
        expand = zstandard.ZstdDecompressor()
        held, loose, waiting, kept = None, [], 0, 0
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != held and loose:
                    yield write(held, loose)
                    loose, waiting, kept = [], 0, 0
                held = number
                raw = expand.decompress(block)
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                loose.append((np.frombuffer(raw, np.uint8, offset=4 + 4 * n), np.frombuffer(raw, "<u4", n, 4).astype(np.int64)))
                waiting += len(raw)
                if waiting > max(16 << 20, kept):
                    body, starts, ends, _ = settled(loose)
                    loose, waiting, kept = [(body, ends - starts)], 0, len(body)
        if loose:
            yield write(held, loose)

    blocks = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_blocks(vocabulary, shards), "shard int, block binary")
    made = shared.deal(blocks, shards).mapInArrow(merge, "shard int, n long").collect()  # a row a shard
    shared.put(f"{folder}/manifest.json", json.dumps({"vocabulary": vocabulary, "shards": shards, "words": {int(r.shard): r.n for r in made}}).encode())
    return folder


class WordTable:
    """A written table, its shards memory-mapped when first needed."""

    def __init__(self, folder: str):
        self.folder, self.meta, self.open = folder, json.loads(shared.get(f"{folder}/manifest.json")), {}
        self.has = {int(k) for k in self.meta["words"]}

    def shard(self, k: int) -> Pieces | None:
        if k not in self.open:
            if k not in self.has:
                self.open[k] = None
            else:
                raw = shared.mapped(f"{self.folder}/shard-{k:06d}")
                n = int(raw[:8].view("<i8")[0])
                p = Pieces.__new__(Pieces)
                p.hashes, p.checks, p.at, p.ids = raw[8 : 8 + 8 * n].view("<u8"), raw[8 + 8 * n : 8 + 16 * n].view("<u8"), raw[8 + 16 * n : 16 + 24 * n].view("<i8"), raw[16 + 24 * n :].view("<u4")
                self.open[k] = p
        return self.open[k]

    def find(self, batch: Batch) -> Pieces:
        """Ids of the batch's distinct pieces; those that are not in the table are encoded here."""
        shards = self.meta["shards"]
        shard = _shard(batch.hashes, shards)
        used, cuts = np.unique(shard, return_index=True)
        cuts = [*cuts.tolist(), len(shard)]
        ids, lens = [], np.zeros(len(batch.hashes), np.int64)
        for i, k in enumerate(used.tolist()):
            a, b = cuts[i], cuts[i + 1]
            p = self.shard(k)
            row, ok, _ = rows_in(p.hashes, p.checks, batch.hashes[a:b], batch.checks[a:b]) if p is not None else (np.zeros(b - a, np.int64), np.zeros(b - a, bool), None)
            if ok.all():
                got, n = p.gather(row)
            else:
                lost = np.flatnonzero(~ok)
                extra, n_extra = encode_pieces(self.meta["vocabulary"], batch.texts(lost + a))
                known, n_known = p.gather(row[ok]) if p is not None else (np.empty(0, np.uint32), np.empty(0, np.int64))
                where = np.concatenate([np.flatnonzero(ok), lost])
                n = np.concatenate([n_known, n_extra])
                got, n = gather(np.concatenate([known, extra]), np.concatenate([[0], np.cumsum(n)]), np.argsort(where))
            ids.append(got)
            lens[a:b] = n
        return Pieces(batch.hashes, batch.checks, np.concatenate(ids) if ids else np.empty(0, np.uint32), lens)


_tables: dict[str, WordTable] = {}


def _table(folder: str) -> WordTable:
    if folder not in _tables:
        _tables.clear()
        _tables[folder] = WordTable(folder)
    return _tables[folder]


def _encoding(folder: str):
    """Batches (doc_id, text) to batches (doc_id, ids)."""

    def run(batches):
        table = _table(folder)
        name = table.meta["vocabulary"]
        for batch in batches:
            buf, offsets = kernel.strings(batch.column(1))
            for i, j in kernel.slices(offsets):
                own, ends_at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                pieces = Batch(name, own, ends_at, True)
                ids, counts = pieces.joined(table.find(pieces))
                ids, counts = encode_whole(name, own, ends_at, ids, counts, pieces.strays)
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "ids"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row, by a written word table. A null text is
    empty and has no ids; null and repeated doc_ids are kept; other columns are left out."""
    return _rows(docs).mapInArrow(_encoding(folder), "doc_id long, ids binary")


def _byte_chars() -> dict[str, int]:
    """The characters for which byte-level vocabularies write bytes: visible Latin-1 stands for itself, the
    others for the next characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def piece_table(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids and where each id's bytes begin."""
    t, chars = tokenizer(vocabulary), _byte_chars()
    pieces = []
    for k in range(t.get_vocab_size()):
        token = t.id_to_token(k) or ""
        pieces.append(bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode())
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])


def _decoding(vocabulary: str, names: list[str]):
    """Batches with ids to batches with ids and text."""

    def run(batches):
        body, at = piece_table(vocabulary)
        for batch in batches:
            column = batch.column(names.index("ids"))
            raw, offsets = kernel.strings(column)
            nulls = column.is_null().to_pylist()
            for i, j in kernel.slices(offsets):
                ids = raw[offsets[i] : offsets[j]].copy().view("<u4").astype(np.int64)
                text, lens = gather(body, at, ids)
                stops = np.concatenate([[0], np.cumsum(lens)])[(offsets[i : j + 1] - offsets[i]) // 4].tolist()
                data = text.tobytes()
                out = [None if z else data[a:b].decode("utf-8", "replace") for a, b, z in zip(stops[:-1], stops[1:], nulls[i:j], strict=True)]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns], pa.array(out, pa.string())], names=[*names, "text"])

    return run


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Add ``text``: the pieces of ``ids`` joined; bytes that are no UTF-8 become U+FFFD. Null ids give null."""
    return encoded.mapInArrow(_decoding(vocabulary, encoded.columns), encoded.select("*", F.lit("").alias("text")).schema)


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids and the decoded text of every row of ``docs`` (doc_id, text): encode() and decode() in one pass
    through Python. A null or empty text has no ids and decodes to an empty one; null and repeated doc_ids are kept;
    other columns are left out; an empty table gives no rows; a word may be as long as a text."""
    folder = build_word_table(docs, Workspace(docs.sparkSession), vocabulary)
    there, back = _encoding(folder), _decoding(vocabulary, ["doc_id", "ids"])
    return _rows(docs).mapInArrow(lambda batches: back(there(batches)), "doc_id long, ids binary, text string")
