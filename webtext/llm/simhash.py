"""SimHash near-dedup by multi-index hashing (operator 10).

Fingerprint: 64 bits; a bit is 1 if it is set in over half the XXH64 hashes
(seed 42) of the text's word shingles, repeats counted.

Links: fingerprints that differ in at most ``max_bits`` bits.  The 64 bits are
cut into ``segments``; two linked fingerprints differ in some segment by at most
``max_bits // segments`` bits.  Each distinct fingerprint is entered in one table
per segment under its segment's value, and looks into the tables at every value
of a small Hamming ball around its own; each match is verified on all 64 bits.
Of two values that differ, only the one that has the zero looks up the other, so
a ball of radius 1 costs half of its values.

Equal fingerprints are one row before any matching, so copies cost nothing.  Of
the matches in a table's bucket only a spanning forest is kept (union by numpy
blocks inside the task), never all pairs.  A bucket with more than ``HOT``
entries is cut into cells: its rows are dealt into k parts, each pair of parts
meets in one cell of its own, and no cell is larger than 2 * ``HOT`` rows.

Defined results: null and empty texts have fingerprint zero and link like any
other; a text shorter than a shingle hashes its whole word sequence; the
component of rows without any ``doc_id`` is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import on_workers, plain, saved
from .components import connected_components

SHINGLE, MAX_BITS, SEGMENTS, SEED = 4, 4, 3, 42
#: Entries of a bucket above which it is cut into cells.
HOT = 8192
_BLOCK = 1 << 22      # pairs compared at once


def simhash(text: str, k: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer; ``bytes.lower`` changes A-Z only."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())),
                         np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def row_key() -> Column:
    """128 bits of a row's id and text; a null id is none of the others, a null text is empty."""
    parts = [F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("\n"),
             F.coalesce(F.col("text"), F.lit(""))]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def fingerprints(docs: DataFrame, k: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """``doc_id, fp``, with ``keyed`` also ``key``: fp as a signed long, row by row."""
    on_workers(docs.sparkSession)
    rows = plain(docs.select("doc_id", "text"))
    if keyed:
        rows = rows.withColumn("key", row_key())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, k) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]],
                                             ["doc_id", "fp", "key"][:b.num_columns])

    return rows.mapInArrow(run, "doc_id long, fp long" + ", key binary" * keyed)


def segment_widths(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; the widths differ by one at most."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(fps: np.ndarray, segments: int, radius: int) -> Iterator[tuple[np.ndarray, bool, np.ndarray]]:
    """(bucket keys, home, rows): the entries and lookups of all fingerprints.
    A bucket key holds the table's number above the segment's value."""
    for table, (shift, width) in enumerate(segment_widths(segments)):
        value = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        base = value | np.uint64(table << 56)
        everyone = np.arange(len(fps))
        yield base, True, everyone
        for r in range(1, radius + 1):
            for bits in combinations(range(width), r):
                mask = np.uint64(sum(1 << b for b in bits))
                low = np.uint64(1 << bits[0])
                # the pair is found from the end whose lowest differing bit is zero
                asks = np.flatnonzero((value & low) == 0)
                yield base[asks] ^ mask, False, asks


def entries(fps: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """``bucket, home, fp`` for the distinct fingerprints ``fp``."""
    radius = max_bits // segments
    if max(w for _, w in segment_widths(segments)) > 56:
        raise ValueError("two segments at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, home, rows = zip(*_keys(own, segments, radius))
                rows, sizes = np.concatenate(rows), [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64), pa.int64()), pa.array(np.repeat(home, sizes)),
                     pa.array(own[rows].view(np.int64), pa.int64())], ["bucket", "home", "fp"])

    return fps.select("fp").mapInArrow(run, "bucket long, home boolean, fp long")


class Forest:
    """Union of places 0..n-1; keeps the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up, self.links = list(range(n)), []

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def bucket_links(home: np.ndarray, asking: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``home`` and between it and ``asking``."""
    forest, everyone = Forest(len(home) + len(asking)), np.concatenate([home, asking])
    step = max(1, _BLOCK // max(1, len(home)))
    for at in range(0, len(everyone), step):
        part = everyone[at:at + step]
        near = np.bitwise_count(part[:, None] ^ home[None, :]) <= max_bits
        i, j = np.nonzero(near)
        i += at
        fresh = i > j                       # each pair of home rows once
        if fresh.sum() > 64:                # most of them join nothing new in a dense bucket
            tops = np.array([forest.top(x) for x in range(len(everyone))])
            fresh &= tops[i] != tops[j]
        for a, b in zip(i[fresh].tolist(), j[fresh].tolist()):
            forest.join(a, b)
    if not forest.links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.array(forest.links).T
    return everyone[a], everyone[b]


def _matched(rows: DataFrame, max_bits: int) -> DataFrame:
    """``bucket, cell, home, fp`` sorted within partitions so that a cell's rows
    follow each other -> ``a, b`` links."""
    def small(bucket: np.ndarray, home: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All cells of a stretch at once; each row meets its cell's home rows."""
        n = len(fp)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(begin, n))
        homes = np.add.reduceat(home.astype(np.int64), begin)
        big = homes * size > 4096
        per_row = np.repeat(np.where(big, 0, homes), size)      # home rows stand first in a cell
        i = np.repeat(np.arange(n), per_row)
        first = np.repeat(np.repeat(begin, size), per_row)
        j = first + (np.arange(len(i)) - np.repeat(np.cumsum(per_row) - per_row, per_row))
        ok = (j < i) & (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits)
        found = [(fp[i[ok]], fp[j[ok]])]
        for c in np.flatnonzero(big):
            own = slice(begin[c], begin[c] + size[c])
            h = home[own]
            found.append(bucket_links(fp[own][h], fp[own][~h], max_bits))
        a, b = zip(*found)
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def stretch(parts):
            key, home, fp = (np.concatenate(x) for x in zip(*parts))
            a, b = small(key, home, fp)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64), pa.int64()),
                                               "b": pa.array(b.view(np.int64), pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, cell, home, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            key = np.stack([bucket, cell], 1).copy().view([("b", np.int64), ("c", np.int64)])[:, 0]
            fp = fp.view(np.uint64)
            if held and held[-1][0][-1] != key[0]:
                yield stretch(held)
                held = []
            # rows of the last cell may go on in the next batch
            cut = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])
            if cut:
                yield stretch([*held, (key[:cut], home[:cut], fp[:cut])])
                held = []
            held.append((key[cut:], home[cut:], fp[cut:]))
        if held:
            yield stretch(held)

    return rows.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints ``fp`` within
    ``max_bits`` of each other, directly or over others that are."""
    on_workers(fps.sparkSession)
    rows = entries(fps, max_bits, segments)
    # home rows are few (one per table); a bucket is large only if they are many
    large = (entries(fps, max_bits, segments).filter("home").groupBy("bucket").count().filter(F.col("count") > hot))
    parts = F.ceil(F.col("count") / F.lit(hot)).cast("long")
    own = F.pmod(F.xxhash64("fp"), parts)
    cells = rows.join(large, "bucket", "left").withColumn("parts", F.coalesce(parts, F.lit(1).cast("long"))) \
        .withColumn("own", F.coalesce(own, F.lit(0).cast("long"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))) \
        .withColumn("cell", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
    dealt = (cells.select("bucket", "cell", "home", "fp").repartition("bucket", "cell")
             .sortWithinPartitions("bucket", "cell", F.col("home").desc()))
    return _matched(dealt, max_bits)


def _rooted(classes: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """``classes``, a row per fingerprint ``fp``, and ``root``: the least
    fingerprint of its component, which is there without any ``doc_id``."""
    roots = saved(connected_components(links(classes, max_bits, segments)), "simhash-roots")
    return classes.join(roots, classes.fp == roots.node, "left") \
        .select(*[classes[c] for c in classes.columns], F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest ``doc_id`` that
    is reachable over links, its own included."""
    own = saved(fingerprints(docs, k), "simhash")
    classes = saved(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    rooted = _rooted(classes, max_bits, segments)
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # only classes that lie in a component of several need the second join
    named = rooted.join(of_root, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without all but one row of
    each component: the one with the smallest ``doc_id``, a null id last, then
    the smallest hash of id and text; of exact repeats of that row one stays.
    Rows with one id, or without, and unlike texts lie in components of their own."""
    own = fingerprints(docs, k, keyed=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = saved(own.groupBy("fp").agg(F.min(order).alias("least")), "simhash-classes")
    firsts = _rooted(classes, max_bits, segments).groupBy("root").agg(F.min("least").alias("least")) \
        .select(F.col("least.key").alias("key"))
    # repeats go before the exchange of the texts (WindowGroupLimit); the join, whose keys are
    # distinct, uses the same exchange, and is no semi-join, as that would move below the window
    repeats = Window.partitionBy("key").orderBy("worded")
    keyed = docs.select(row_key().alias("key"), F.col("text").isNotNull().alias("worded"), F.struct("*").alias("row"))
    single = keyed.withColumn("n", F.row_number().over(repeats)).filter("n = 1")
    return single.join(firsts, "key").select("row.*")
