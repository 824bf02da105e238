"""Best-fit packing by a grouping genetic algorithm on islands (operator 12).

Every document becomes token ids with an end id.  One longer than a sequence is
cut into pieces of exactly ``length`` tokens, the first of which takes the rest;
full pieces are sequences of their own.  The other pieces are dealt by a hash of
their row number to shards of about ``SHARD`` pieces.  Every shard is packed on
``ISLANDS`` islands that start from different seeds (:mod:`grouping`): children
take whole well-filled bins of one parent, bins of the other parent that share a
piece with these go, and displaced pieces are put back by best fit.  After every
epoch but the last the best packings of each island migrate to the next one of
the shard; at the end the shard's best packing counts.

Bins under ``LOOSE`` of a sequence are taken apart again and their pieces, now
few, packed in another round over fewer shards, until one shard holds them.

A shard's state is its pieces' row numbers and sizes and a few packings: under a
megabyte, whatever the table's size.  Lengths alone are packed; ids do not move.

Defined results: null is read as empty (its only id is the end id); repeated rows
and ids are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouping
from .common import on_workers, plain, saved
from .tokenizing import encoder

LENGTH, END_ID = 1024, 2
SHARD, ISLANDS, EPOCHS = 4096, 2, 2
POPULATION, GENERATIONS, ELITES = 6, 30, 2
#: Bins filled less than this share are packed again with those of other shards.
LOOSE = 0.875

_STATE = "shard long, island int, rows binary, sizes binary, bins int, squares long, packings array<binary>"
_PLACES = "row long, length long, shard long, bin int, offset long, fill long"


def pieces(docs: DataFrame, path: str, kind: str, length: int = LENGTH, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as 32-bit integers)."""
    on_workers(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def cut(doc_id, data: bytes) -> Iterator[tuple]:
        n = len(data) // 4
        ends = range(n % length or length, n + 1, length)
        for piece, end in enumerate(ends):
            start = ends[piece - 1] if piece else 0
            part = data[4 * start:4 * end]
            yield doc_id, piece, start, end - start, zlib.crc32(part), *[part] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, kind), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                ids, texts = (b.slice(at, 1024).column(i).to_pylist() for i in (0, 1))
                out = [row for i, t in zip(ids, texts) for row in cut(i, enc.encode(t) + end)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), fields)],
                                                 [n for n, _ in fields])

    return plain(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"
                                  + ", ids binary" * with_ids)


def _settled(items: DataFrame, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """``row, length, shard`` -> the place of every row in the best packing of its
    shard.  A task holds one island of one shard at a time."""

    def state(shard: int, island: int, epoch: int, rows: np.ndarray, sizes: np.ndarray, met: list[bytes]) -> pa.Table:
        immigrants = []
        for data in met:
            bin_of = np.frombuffer(data, np.int32)
            immigrants.append((bin_of, np.bincount(bin_of, weights=sizes).astype(np.int64)))
        best = grouping.evolve(sizes, capacity, [shard, island, epoch], immigrants, POPULATION, generations, ELITES)
        bins, squares = grouping.fitness(best[0])
        return pa.table({
            "shard": pa.array([shard], pa.int64()), "island": pa.array([island], pa.int32()),
            "rows": pa.array([rows.tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()),
            "bins": pa.array([-bins], pa.int32()), "squares": pa.array([squares], pa.int64()),
            "packings": pa.array([[p[0].astype(np.int32).tobytes() for p in best]], pa.list_(pa.binary()))})

    def settle(table: pa.Table) -> pa.Table:
        rows, sizes = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "length"))
        order = np.lexsort((rows, -sizes))      # the same on every island of the shard
        return state(table.column("shard")[0].as_py(), table.column("island")[0].as_py(), 0, rows[order], sizes[order], [])

    def migrate(epoch: int):
        def run(table: pa.Table) -> pa.Table:
            home, *others = table.sort_by("foreign").to_pylist()     # the shuffle's order must not matter
            rows, sizes = (np.frombuffer(home[c], np.int64) for c in ("rows", "sizes"))
            return state(home["shard"], home["island"], epoch, rows, sizes,
                         [p for s in (home, *others) for p in s["packings"]])
        return run

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                rows, sizes = (np.frombuffer(s[c], np.int64) for c in ("rows", "sizes"))
                bin_of = np.frombuffer(s["packing"], np.int32)
                order = np.argsort(bin_of, kind="stable")
                rows, sizes, bin_of = rows[order], sizes[order], bin_of[order]
                before = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(sizes), pa.array(np.full(len(rows), s["shard"], np.int64)), pa.array(bin_of),
                     pa.array(before - before[np.searchsorted(bin_of, bin_of)]),
                     pa.array(np.bincount(bin_of, weights=sizes).astype(np.int64)[bin_of])],
                    ["row", "length", "shard", "bin", "offset", "fill"])

    on_all = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    now = saved(on_all.groupBy("shard", "island").applyInArrow(settle, _STATE), "islands")
    for epoch in range(1, epochs):
        none = F.lit(None).cast("binary")
        migrants = now.withColumns({"island": F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"),
                                    "rows": none, "sizes": none, "foreign": F.lit(1)})
        met = now.withColumn("foreign", F.lit(0)).unionByName(migrants)
        now = saved(met.groupBy("shard", "island").applyInArrow(migrate(epoch), _STATE), "islands")
    best = now.groupBy("shard").agg(F.min_by(
        F.struct("shard", "rows", "sizes", F.col("packings")[0].alias("packing")),
        F.struct("bins", -F.col("squares"), "island")).alias("s"))
    return best.select("s").mapInArrow(places, _PLACES)


def pack(docs: DataFrame, path: str, kind: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False,
         shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset`` (and ``ids`` where asked for).  Sequence ids are unique, not
    consecutive; those of full pieces are negative."""
    cut = saved(pieces(docs, path, kind, length, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    left = cut.filter(F.col("length") < length).select("row", "length")
    n, settled = left.count(), []
    while n:
        shards, turn = -(-n // shard), len(settled)
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)))
        placed = saved(_settled(dealt, length, islands, epochs, generations), "places")
        loose = F.col("fill") < LOOSE * length
        many = placed.filter(loose).count() if shards > 1 else 0
        if many > n // 4:     # bins this size can't be filled better by others of the kind
            many = 0
        number = F.lit(turn << 58) + F.shiftleft("shard", 20) + F.col("bin")
        settled.append((placed.filter(~loose) if many else placed).select("row", number.alias("sequence_id"), "offset"))
        left, n = placed.filter(loose).select("row", "length"), many
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    full = cut.filter(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    if not settled:
        return full.select(*columns)
    places = reduce(DataFrame.unionByName, settled)
    return cut.filter(F.col("length") < length).join(places, "row").select(*columns).unionByName(full.select(*columns))
