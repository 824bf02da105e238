"""Packing along a space-filling curve (operator 2).

Each document becomes token ids (with an end id) and a hashed bag-of-tokens
vector, projected to ``DIMENSIONS`` coordinates.  Their Hilbert index orders the
documents so that neighbours on the curve are alike; a range sort by
``(index, doc_id)`` deals the curve out in ranges of about equal numbers of tokens
(long documents lie together on the curve, so ranges of equal numbers of rows would
not do), and every range lays its stretch of the curve end to end into sequences
of ``length`` tokens, cutting documents where a sequence is full.  What is left at the end of a stretch fills sequences
whose lengths are the binary digits of the rest: powers of two need no padding,
so no sequence is padded at all.

The range sort has ``doc_id`` as its second key, so a group of equal documents,
however large, is split over partitions.  Ids travel in the smallest unsigned
type that holds the vocabulary.

Defined results: null is read as empty (its only id is the end id); repeated
rows are packed each; a document longer than a sequence spans several.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, on_workers, partitions, plain, saved
from .tokenizing import encoder

LENGTH = 1024
END_ID = 0
#: Buckets of the hashed vector, coordinates it is projected to, bits of each.
BUCKETS, DIMENSIONS, BITS = 512, 4, 12
_SEED = 20240229
#: Tokens of a range of the curve, and the most ranges; beyond, ranges grow.
RANGE_TOKENS, MAX_RANGES = 1 << 22, 1 << 15
#: Documents drawn per range to find the cuts.
SAMPLES = 100


def _projection() -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((BUCKETS, DIMENSIONS))


def coordinates(ids: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Cell numbers of a document's projected vector: damped counts of hashed
    ids, scaled to length 1; each coordinate goes through a logistic curve, which
    spreads a normal variable about evenly over the cells."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=BUCKETS)
    v = np.sqrt(counts)
    norm = np.sqrt(counts.sum())
    x = (v / norm if norm else v) @ projection
    return np.minimum((1 << BITS) - 1, (1 << BITS) / (1 + np.exp(-1.702 * x))).astype(np.uint64)


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of cells (rows: points, columns: coordinates) on the Hilbert
    curve, all points at once: the coordinates are rotated bit plane by bit plane
    into transposed form, Gray-decoded and interleaved."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for plane in range(bits - 1, 0, -1):
        q, low = 1 << plane, (1 << plane) - 1
        for i in range(n):
            has = (x[i] & q) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] >> plane) & 1, t ^ ((1 << plane) - 1), t)
    x ^= t
    key = np.zeros_like(t)
    for plane in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> plane) & 1)
    return key


def tokenized(docs: DataFrame, path: str, kind: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, curve, ids, width, n``: ids with the end id, packed to 16 or 32
    bits, and their number."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, projection = encoder(path, kind), _projection()
        width = "<u2" if max(enc.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids = [np.frombuffer(enc.encode(t) + end, "<u4") for t in part.column(1).to_pylist()]
                cells = np.array([coordinates(i, projection) for i in ids])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(hilbert_index(cells), pa.int64()),
                     pa.array([i.astype(width).tobytes() for i in ids], pa.binary()),
                     pa.array([width] * len(ids), pa.string()),
                     pa.array([len(i) for i in ids], pa.int64())], ["doc_id", "curve", "ids", "width", "n"])

    return plain(docs).mapInArrow(run, "doc_id long, curve long, ids binary, width string, n long")


def range_cuts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys ``(curve, doc_id)`` that cut ``rows`` into ranges of about equal numbers
    of tokens, and the number of ranges.

    A document is drawn with a chance in proportion to its tokens, by a hash of its
    key; one longer than the step between draws is always drawn, with its own
    weight.  So about ``SAMPLES`` keys per range, repeated rows once, come to the
    driver, at most 80 MB of them; the ids are not read for it."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = min(MAX_RANGES, max(1, -(-total // RANGE_TOKENS), min(partitions(rows.sparkSession), total >> 16)))
    step = max(1.0, total / (SAMPLES * ranges))
    chance = F.pmod(F.xxhash64("doc_id", "curve"), F.lit(1 << 40)) / float(1 << 40)
    drawn = (rows.select("curve", id_key().alias("id"), "n", chance.alias("u")).filter(F.col("u") * step < F.col("n"))
             .groupBy("curve", "id").agg(F.sum(F.greatest(F.col("n"), F.lit(step))).alias("weight")).toArrow())
    curve, ids, weight = (drawn.column(c).to_numpy() for c in ("curve", "id", "weight"))
    order = np.lexsort((ids, curve))
    before = np.cumsum(weight[order])
    if not len(order):
        return curve, ids, 1
    at = order[np.searchsorted(before, before[-1] * np.arange(1, ranges) / ranges)]
    return curve[at], ids[at], ranges


def range_of(curve: np.ndarray, ids: np.ndarray, cut_curve: np.ndarray, cut_ids: np.ndarray) -> np.ndarray:
    """How many cuts, which are sorted, are below each key."""
    low, high = np.searchsorted(cut_curve, curve, "left"), np.searchsorted(cut_curve, curve, "right")
    out = low.astype(np.int32)
    for a, b in set(zip(low[low < high].tolist(), high[low < high].tolist())):
        same = (low == a) & (high == b)
        out[same] += np.searchsorted(cut_ids[a:b], ids[same], "left").astype(np.int32)
    return out


def by_range(rows: DataFrame) -> DataFrame:
    """``rows`` in partitions that are ranges of the curve, sorted, with ``part``."""
    cut_curve, cut_ids, ranges = range_cuts(rows)

    def run(curve: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series(range_of(curve.to_numpy(), ids.to_numpy(), cut_curve, cut_ids))

    part = F.pandas_udf(run, "int")("curve", id_key())
    return (rows.withColumn("part", part).repartitionById(ranges, F.col("part"))
            .sortWithinPartitions("curve", "doc_id").withColumn("part", F.col("part").cast("long")))


def tail_lengths(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(docs: DataFrame, path: str, kind: str, length: int = LENGTH, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, curve`` (and ``ids``, the piece's ids as 32-bit
    integers, where asked for).  Sequence ids are unique, not consecutive."""
    rows = by_range(saved(tokenized(docs, path, kind, end_id), "packing"))
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
             ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("curve", pa.int64())]
    if with_ids:
        kinds.append(("ids", pa.binary()))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []      # pieces of the sequence that is not full yet
        fill, seq = 0, None

        def row(doc_id, curve, total, start, ids, sequence, offset):
            data = ids.astype("<u4").tobytes()
            return (doc_id, start, len(ids), zlib.crc32(data), total, sequence, offset, curve,
                    *([data] if with_ids else []))

        for b in batches:
            part = b.schema.get_field_index("part")
            if seq is None and b.num_rows:
                seq = b.column(part)[0].as_py() << 32
            for doc_id, curve, data, width in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(data, width)
                at = 0
                while at < len(ids):
                    take = min(length - fill, len(ids) - at)
                    held.append((doc_id, curve, len(ids), at, ids[at:at + take]))
                    at, fill = at + take, fill + take
                    if fill == length:
                        offset = 0
                        for p in held:
                            out.append(row(*p, seq, offset))
                            offset += len(p[4])
                        held, fill, seq = [], 0, seq + 1
                        if len(out) >= 4096:
                            yield batch(out)
                            out = []
        sizes, offset = tail_lengths(fill), 0
        for doc_id, curve, total, start, ids in held:
            while len(ids):
                take = min(sizes[0] - offset, len(ids))
                out.append(row(doc_id, curve, total, start, ids[:take], seq, offset))
                ids, start, offset = ids[take:], start + take, offset + take
                if offset == sizes[0]:
                    sizes, offset, seq = sizes[1:], 0, seq + 1
        if out:
            yield batch(out)

    names = {"int64": "long", "binary": "binary"}
    return rows.select("doc_id", "curve", "ids", "width", "part").mapInArrow(
        run, ", ".join(f"{n} {names[str(k)]}" for n, k in kinds))
