"""Bit-packed token files (operator 4).

A file holds the ids of many documents, each id in the fewest bits that hold the
vocabulary.  Layout: magic; blocks of ``BLOCK`` ids, each starting on a byte and
packed little-endian; then a footer with the block offsets and, per document,
its id and the place of its first token; then the footer's length and the magic
again.  A reader finds any token by its block's offset and unpacks whole blocks
with numpy.

A file's name is new for each attempt; the manifest, a Spark table with one row
per file, names the files that count.  A task that is run again after a lost
executor leaves an unnamed file at worst.  Files are opened by URI through
``pyarrow.fs``, so the folder may be any file system it knows.

Defined results: a null text is empty and has only the end id; equal ``doc_id``s
stand in the order of their texts, a null ``doc_id`` stands first; an empty table gives
no file and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import spark_partition_id

from ..session import scratch_path
from .common import on_workers, partitions, plain, saved
from .tokenizing import encoder

MAGIC = b"TOKBITS1"
BLOCK = 1 << 16
END_ID = 2


def bits_needed(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0..vocabulary-1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, :bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, count=bits, bitorder="little"), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    """``n`` ids: for each, the bytes that hold it are gathered and shifted."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    first = np.arange(n, dtype=np.int64) * bits
    byte, out = first >> 3, np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (first & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


class TokenWriter:
    """Appends documents to one file; holds one unfinished block and the footer."""

    def __init__(self, uri: str, bits: int) -> None:
        system, path = _open(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.bits, self.n, self.waiting, self.n_waiting = bits, 0, [], 0
        self.offsets, self.ids, self.starts = [len(MAGIC)], [], []
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            ids = np.concatenate(self.waiting)
            full = len(ids) // BLOCK * BLOCK
            for at in range(0, full, BLOCK):
                self._block(ids[at:at + BLOCK])
            self.waiting, self.n_waiting = [ids[full:]], len(ids) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        head = json.dumps({"bits": self.bits, "block": BLOCK, "ids": self.n, "documents": len(self.ids)}).encode()
        null = np.array([i is None for i in self.ids], np.uint8)
        body = b"".join([np.array(self.offsets, "<i8").tobytes(), np.array(self.starts, "<i8").tobytes(),
                         np.array([i or 0 for i in self.ids], "<i8").tobytes(), null.tobytes()])
        self.out.write(struct.pack("<I", len(head)) + head + body)
        self.out.write(struct.pack("<Q", 4 + len(head) + len(body)) + MAGIC)
        self.out.close()


class TokenReader:
    """Random access to a file: ``read(begin, end)`` gives ids by place."""

    def __init__(self, uri: str) -> None:
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a complete token file")
        n, = struct.unpack("<Q", tail[:8])
        footer = self.file.read_at(n, size - 8 - len(MAGIC) - n)
        k, = struct.unpack_from("<I", footer)
        head = json.loads(footer[4:4 + k])
        self.bits, self.block, self.n, docs = head["bits"], head["block"], head["ids"], head["documents"]
        blocks, at = -(-self.n // self.block), 4 + k
        self.offsets = np.frombuffer(footer, "<i8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.starts = np.append(np.frombuffer(footer, "<i8", docs, at), self.n)
        values = np.frombuffer(footer, "<i8", docs, at + 8 * docs).tolist()
        null = np.frombuffer(footer, np.uint8, docs, at + 16 * docs)
        self.doc_ids = [None if x else v for v, x in zip(values, null)]

    def read(self, begin: int, end: int) -> np.ndarray:
        if begin >= end:
            return np.empty(0, "<u4")
        first, last = begin // self.block, (end - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts, at = [], 0
        for b in range(first, last + 1):
            size = int(self.offsets[b + 1] - self.offsets[b])
            parts.append(unpack_bits(data[at:at + size], min(self.block, self.n - b * self.block), self.bits))
            at += size
        ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return ids[begin - first * self.block:end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document with its place, reading about ``at_once`` ids a time."""
        i = 0
        while i < len(self.doc_ids):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + at_once, side="right")) - 1)
            j = min(j, len(self.doc_ids))
            ids = self.read(int(self.starts[i]), int(self.starts[j]))
            base = int(self.starts[i])
            for k in range(i, j):
                yield self.doc_ids[k], int(self.starts[k]), ids[self.starts[k] - base:self.starts[k + 1] - base]
            i = j


def write_token_files(docs: DataFrame, folder: str, path: str, kind: str, end_id: int = END_ID) -> DataFrame:
    """Encode, sort by ``doc_id`` over all files, write one file per range.
    Returns the manifest: ``number, uri, documents, ids`` and ``start``, the ids
    of all files before; sorted by ``number`` the files are in order."""
    on_workers(docs.sparkSession)
    ordered = (plain(docs).repartitionByRange(F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
               .select("doc_id", "text", spark_partition_id().cast("long").alias("number")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        bits = bits_needed(max(enc.vocabulary, end_id + 1))
        end, writer, number, uri = np.array([end_id], "<u4").tobytes(), None, None, None
        for b in batches:
            for doc_id, text, number in zip(*(b.column(i).to_pylist() for i in range(3))):
                if writer is None:
                    uri = f"{folder}/{number:08d}-{uuid.uuid4().hex}.tokens"
                    writer = TokenWriter(uri, bits)
                writer.add(doc_id, np.frombuffer(enc.encode(text) + end, "<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"number": [number], "uri": [uri], "documents": [len(writer.ids)],
                                              "ids": [writer.n]})

    manifest = saved(ordered.mapInArrow(run, "number long, uri string, documents long, ids long"), "token-manifest")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    on_workers(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: list[tuple] = []
                for doc_id, at, ids in TokenReader(uri).documents():
                    out.append((doc_id, start + at, len(ids), zlib.crc32(ids.tobytes())))
                    if len(out) >= 8192:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    # rows are tiny and stand for whole files: a fixed number, so that they are not put together
    spread = manifest.select("uri", "start").repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                      ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_folder(spark) -> str:
    """A new folder for token files below the shared checkpoint folder."""
    return scratch_path(spark, "tokens")
