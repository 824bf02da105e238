"""Line dedup by sharded minimal perfect hashes (operator 3).

1.  Every document yields the distinct 64-bit hashes of its line keys.  They are
    stored once, beside the documents, in the shared folder.
2.  Per distinct hash: the number of documents holding it and the largest
    ``doc_id`` (summed before the shuffle).
3.  The distinct hashes are dealt into shards.  Each shard becomes a minimal
    perfect hash with three arrays indexed by it: a 32-bit fingerprint that
    tells other keys apart, the count and the largest id.
4.  Documents send bare hashes to the shards and probe the arrays; only
    (document, hash) pairs whose line must go come back.  Lines never travel.
5.  Each document drops its lines and hashes its text.

Hot lines: a hash held by more than one ``HOT``-th of all probes is put into one
small index of its own.  There are fewer than ``HOT`` of these (their counts add
up to no more than all probes), so that index is broadcast under a proven bound
and its probes are answered where the documents are; no shard gets a hash with
more than that share.

Defined results: a null or empty text is one empty line; repeated rows count as
documents of their own; a null ``doc_id`` sorts below all others; rows that tie
for the largest ``doc_id`` all keep the line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, WS_BYTES, id_key, on_workers, partitions, plain, saved
from .phash import PerfectHash, mix

MIN_CHARS = 20
MIN_DOCS = 3
#: One in so many probes makes a line hot; fewer than so many lines are.
HOT = 10_000


def _long_enough(key: bytes, least: int) -> bool:
    n = len(key)
    if n < least:
        return False
    return n >= 4 * least or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least


def line_hashes(text: str, least: int = MIN_CHARS) -> list[int | None]:
    """For each line the signed 64-bit hash of its key; None where the key is
    too short.  ``bytes.lower`` changes A-Z only."""
    out = []
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(WS_BYTES)
        if _long_enough(key, least):
            h = xxhash.xxh3_64_intdigest(key)
            out.append(h - (1 << 64) if h >> 63 else h)
        else:
            out.append(None)
    return out


class LineIndex:
    """A shard: perfect hash, fingerprints, counts and largest ids."""

    def __init__(self, phash: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        self.phash, self.prints, self.counts, self.last = phash, prints, counts, last

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 0x5EED) >> np.uint64(32)).astype("<u4")

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        keys = hashes.astype(np.int64).view(np.uint64)
        phash = PerfectHash.build(keys)
        at = phash.numbers(keys)
        arrays = [np.empty(len(keys), t) for t in ("<u4", "<u4", "<i8")]
        for a, values in zip(arrays, (cls._print(keys), np.minimum(counts, 2 ** 32 - 1), last)):
            a[at] = values
        return cls(phash, *arrays)

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, largest id) of each hash; count 0 where it is not indexed."""
        keys = hashes.astype(np.int64).view(np.uint64)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = self.phash.numbers(keys)
        ok = (at >= 0) & (self.prints[at] == self._print(keys))
        return np.where(ok, self.counts[at], 0).astype(np.int64), self.last[at]

    def to_row(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.phash.to_bytes(), self.prints.tobytes(), self.counts.tobytes(), self.last.tobytes()

    @classmethod
    def from_row(cls, phash: bytes, prints: bytes, counts: bytes, last: bytes) -> LineIndex:
        return cls(PerfectHash.from_bytes(phash), np.frombuffer(prints, "<u4"),
                   np.frombuffer(counts, "<u4"), np.frombuffer(last, "<i8"))


def hashed(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``id`` (never null) and the distinct line hashes of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list({h for h in line_hashes(t, least) if h is not None}) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "hashes"])

    return (docs.select(id_key().alias("doc_id"), "text")
            .mapInArrow(run, "id long, hashes array<long>").filter(F.size("hashes") > 0))


def build_index(stats: DataFrame, shards: int) -> DataFrame:
    """``hash, docs, last`` -> one row per shard with the index's arrays."""
    def build(t: pa.Table) -> pa.Table:
        index = LineIndex.build(*(t.column(c).to_numpy() for c in ("hash", "docs", "last")))
        return pa.table({"shard": t.column("shard").slice(0, 1),
                         **{n: pa.array([v], pa.binary()) for n, v in
                            zip(("phash", "prints", "counts", "last"), index.to_row())}})

    return (stats.withColumn("shard", _shard(shards)).groupBy("shard")
            .applyInArrow(build, "shard int, phash binary, prints binary, counts binary, last binary"))


def _shard(n: int):
    return F.pmod(F.xxhash64("hash"), F.lit(n)).cast("int")


def _probed(index: LineIndex, ids: np.ndarray, hashes: np.ndarray, min_docs: int) -> pa.Table:
    counts, last = index.probe(hashes)
    go = (counts >= min_docs) & (ids < last)
    return pa.table({"id": pa.array(ids[go], pa.int64()), "hash": pa.array(hashes[go], pa.int64())})


def lines_to_drop(docs: DataFrame, least: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``id, drop``: per document the hashes of the lines that it loses."""
    spark = docs.sparkSession
    on_workers(spark)
    own = saved(hashed(docs, least), "line-hashes")
    lines = own.select("id", F.explode("hashes").alias("hash"))
    stats = saved(lines.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last")), "line-stats")
    probes = stats.agg(F.sum("docs")).first()[0] or 0
    hot_rows = stats.filter(F.col("docs") > probes // HOT).filter(F.col("docs") >= min_docs).collect()  # < HOT rows
    hot = LineIndex.build(*(np.array([r[i] for r in hot_rows], np.int64) for i in range(3)))
    shared = spark.sparkContext.broadcast(hot.to_row())
    shards = partitions(spark)
    index = build_index(stats, shards)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hot lines are answered here; the rest goes on with a null answer."""
        hot = LineIndex.from_row(*shared.value)
        for b in batches:
            ids, hashes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            counts, last = hot.probe(hashes)
            rest = counts == 0
            keep = rest | (ids < last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[keep], pa.int64()), pa.array(hashes[keep], pa.int64()), pa.array(~rest[keep])],
                ["id", "hash", "drop"])

    def far(probes: pa.Table, index: pa.Table) -> pa.Table:
        if not index.num_rows or not probes.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "hash": pa.array([], pa.int64())})
        shard = LineIndex.from_row(*(index.column(c)[0].as_py() for c in ("phash", "prints", "counts", "last")))
        return _probed(shard, probes.column("id").to_numpy(), probes.column("hash").to_numpy(), min_docs)

    asked = lines.mapInArrow(near, "id long, hash long, drop boolean")
    routed = (asked.filter(~F.col("drop")).withColumn("shard", _shard(shards)).select("shard", "id", "hash")
              .groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(far, "id long, hash long"))
    gone = asked.filter("drop").select("id", "hash").unionByName(routed)
    return gone.groupBy("id").agg(F.collect_set("hash").alias("drop"))


def dedup_lines(docs: DataFrame, least: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` for every row of ``docs``."""
    on_workers(docs.sparkSession)
    docs = plain(docs)
    drops = lines_to_drop(docs, least, min_docs)
    joined = (docs.withColumn("id", id_key()).join(drops.hint("shuffle_hash"), "id", "left")
              .select("doc_id", "text", "drop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not drop:
                    out.append((text.count("\n") + 1, 0, text))
                    continue
                drop, lines = set(drop), text.split("\n")
                kept = [line for line, h in zip(lines, line_hashes(text, least)) if h not in drop]
                out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, ``text`` without the dropped lines and
    ``n_chars``, where there is one, as its new length.  A null text stays null."""
    on_workers(docs.sparkSession)
    @F.arrow_udf("string")
    def without(texts: pa.Array, drops: pa.Array) -> pa.Array:
        """Texts and drop lists alone go to Python, 1,024 of them as objects at once."""
        out = []
        for start in range(0, len(texts), 1024):
            kept = []
            for text, drop in zip(texts.slice(start, 1024).to_pylist(), drops.slice(start, 1024).to_pylist()):
                if drop and text:
                    drop = set(drop)
                    text = "\n".join(x for x, h in zip(text.split("\n"), line_hashes(text)) if h not in drop)
                kept.append(text)
            out.append(pa.array(kept, pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    # a user's row stays in one column: its names cannot meet those used here
    rows = docs.select(id_key().alias("id"), F.struct("*").alias("row"))
    joined = rows.join(lines_to_drop(plain(docs)).hint("shuffle_hash"), "id", "left")
    changed = joined.withColumn("text", without("row.text", "drop"))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.col("row").getField("n_chars"))
           if "n_chars" in docs.columns else None}
    return changed.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("row").getField(f.name)).alias(f.name)
                            for f in docs.schema])
