"""Token ids in binary files that are read by the document.

A set is a folder of files in ascending doc_id order and a manifest. A file is a row of independent
zstandard frames (a frame: document count, doc_ids, id counts, then ids, all little-endian), a skippable
frame with the index (first doc_id and first id of each frame), and at the end the seek table of the public
zstandard seekable format: per frame its compressed size, its size and the low 32 bits of its XXH64. A
reader takes the last bytes, finds the frames that it needs and decompresses no other.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, shared
from .pieces import encoder

# Fixed values of the zstandard seekable format.
SKIPPABLE, INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
NONE = -(2**63)
"""Stands for a null doc_id, which sorts first."""


class Writer:
    """Collects documents, and writes a frame to ``out`` whenever ``frame_ids`` ids are together."""

    def __init__(self, out, frame_ids: int = 1 << 18, level: int = 3):
        self.out, self.frame_ids, self.pack = out, frame_ids, zstandard.ZstdCompressor(level=level)
        self.seek, self.index = [], []
        self.docs, self.ids, self.held, self.total = [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NONE if doc_id is None else doc_id)
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_ids:
            self.frame()

    def frame(self) -> None:
        if not self.docs:
            return
        counts = np.array([len(x) for x in self.ids], "<i8")
        raw = struct.pack("<I", len(self.docs)) + np.array(self.docs, "<i8").tobytes() + counts.tobytes() + np.concatenate(self.ids).astype("<u4").tobytes()
        packed = self.pack.compress(raw)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((self.docs[0], self.docs[-1], self.total))
        self.out.write(packed)
        self.total += self.held
        self.docs, self.ids, self.held = [], [], 0

    def close(self) -> None:
        """Write the last frame, the index and the seek table."""
        self.frame()
        index = b"".join(struct.pack("<qqq", *x) for x in self.index)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 1 << 7, SEEKABLE)
        self.out.write(struct.pack("<II", INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Reads one file; only the frames asked for are fetched and decompressed."""

    def __init__(self, uri: str):
        self.uri, size = uri, shared.length(uri)
        n, flags, magic = struct.unpack("<IBI", shared.get(uri, size - 9, 9))
        if magic != SEEKABLE or not flags & 1 << 7:
            raise ValueError(f"{uri} has no seek table with checksums")
        tail = shared.get(uri, size - 9 - 12 * n - 8 - 24 * n, 24 * n + 8 + 12 * n)
        self.index = [struct.unpack_from("<qqq", tail, 24 * k) for k in range(n)]
        self.seek = [struct.unpack_from("<III", tail, 24 * n + 8 + 12 * k) for k in range(n)]
        self.at = np.concatenate([[0], np.cumsum([x[0] for x in self.seek], dtype=np.int64)])

    def frame(self, k: int) -> list[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, ids) of the documents in a frame; a wrong checksum is an error."""
        packed, size, check = self.seek[k]
        raw = zstandard.ZstdDecompressor().decompress(shared.get(self.uri, int(self.at[k]), packed), max_output_size=size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"{self.uri}: frame {k} has a wrong checksum")
        (n,) = struct.unpack_from("<I", raw)
        docs, counts = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "<i8", n, 4 + 8 * n)
        ids = np.frombuffer(raw, "<u4", offset=4 + 16 * n)
        begins = np.concatenate([[0], np.cumsum(counts)])
        return [(None if d == NONE else d, self.index[k][2] + b, ids[b:e]) for d, b, e in zip(docs.tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True)]

    def find(self, doc_ids: set[int]) -> list[tuple[int | None, int, np.ndarray]]:
        frames = [k for k, (lo, hi, _) in enumerate(self.index) if any(lo <= d <= hi for d in doc_ids)]
        return [x for k in frames for x in self.frame(k) if x[0] in doc_ids]


def write(docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, frame_ids: int = 1 << 18, files: int | None = None) -> str:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each and write the set into ``folder`` in ascending
    doc_id order, frame by frame. Returns the folder. A null text is empty; null doc_ids come first; repeated doc_ids stand
    side by side in order of their texts; an empty table gives a manifest without files."""
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        enc, n_docs, first = encoder(vocabulary, False), 0, None
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.ids.zst"
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        first = batch.column(0)[0].as_py()
        with shared.writing(f"{folder}/{name}") as stream:
            out = Writer(stream, frame_ids)
            while batch is not None:
                buf, offsets = kernel.strings(batch.column(1))
                ids_in = batch.column(0).to_pylist()
                n_docs += len(ids_in)
                for i, j in kernel.slices(offsets):
                    ids, counts = enc.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    at = 0
                    for d, c in zip(ids_in[i:j], counts.tolist(), strict=True):
                        out.add(d, np.append(ids[at : at + c], np.uint32(end_id)))
                        at += c
                batch = next(batches, None)
            out.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "first": first, "docs": n_docs, "ids": out.total}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("first", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    made = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).mapInArrow(run, "part int, file string, first long, docs long, ids long").collect()
    start, listed = 0, []
    for r in sorted(made, key=lambda r: r.part):  # a row a file
        listed.append({"file": r.file, "first": r["first"], "docs": r.docs, "ids": r.ids, "start": start})
        start += r.ids
    shared.put(f"{folder}/manifest.json", json.dumps({"vocabulary": vocabulary, "end_id": end_id, "ids": start, "files": listed}).encode())
    return folder


def manifest(folder: str) -> dict:
    return json.loads(shared.get(f"{folder}/manifest.json"))


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """All documents of a set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked
    for, ids (binary, little-endian unsigned 32-bit)."""
    files = [(f["file"], f["start"]) for f in manifest(folder)["files"]]
    types = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * ids]

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(f"{folder}/{name}")
                for k in range(len(file.seek)):
                    docs = file.frame(k)
                    raw = [x.tobytes() for _, _, x in docs]
                    cols = [[d for d, _, _ in docs], [start + b for _, b, _ in docs], [len(x) for _, _, x in docs], [zlib.crc32(x) for x in raw], *[raw] * ids]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[c for c, _ in types])

    table = spark.createDataFrame(files, "file string, start long")
    return table.repartition(max(1, len(files))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def lookup(folder: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of single documents, fetching only the frames that hold them."""
    wanted, out = set(doc_ids), {}
    files = manifest(folder)["files"]
    for k, f in enumerate(files):
        after = files[k + 1]["first"] if k + 1 < len(files) else None
        mine = {d for d in wanted if (f["first"] is None or f["first"] <= d) and (after is None or d <= after)}
        if mine:
            for d, _, ids in Reader(f"{folder}/{f['file']}").find(mine):
                out.setdefault(d, ids)
    return out
