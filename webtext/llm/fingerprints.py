"""Lempel-Ziv phrase fingerprints (operator 1).

A text is parsed from left to right into dictionary phrases (LZ78: each phrase
is the longest earlier phrase plus one more code point).  The set of phrases is
hashed; the ``SIZE`` smallest 32-bit hashes are the fingerprint, written as hex.
Two texts that compress each other well share phrases, so the Jaccard
similarity of their phrase sets, estimated from the minimum hashes of the
union, is a compression-like similarity that needs no second compression run.

Defined results: null is read as empty; the empty text has the empty
fingerprint, which is like itself (1.0) and unlike any other (0.0); an
unfinished last phrase equals an earlier one and adds nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, partitions, plain

#: Minimum hashes kept per text (standard error of the likeness below 0.045).
SIZE = 128
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 2 ** 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n >= len(self.up):
            m = max(2 * len(self.up), n + 1)
            for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))


_POWERS = _Powers()


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases of ``text`` that end before ``ends``."""
    if not ends:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    _POWERS.upto(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(codes + np.uint64(1)) * _POWERS.up[:n], out=prefix[1:])
    e = np.asarray(ends, np.int64)
    s = np.empty_like(e)
    s[0], s[1:] = 0, e[:-1]
    h = (prefix[e] - prefix[s]) * _POWERS.down[s]
    return (_mix(h + (e - s).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def smallest(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    if len(hashes) > 8 * size:   # hashes are uniform: few lie under a low cut
        low = hashes[hashes < np.uint32(min(2 ** 32 - 1, 3 * size * 2 ** 32 // len(hashes)))]
        u = np.unique(low)
        if len(u) >= size:
            return u[:size]
    return np.unique(hashes)[:size]


def parse(text: str, root: dict, node: dict, begin: int, ends: list[int], log: list | None) -> dict:
    """Continue the LZ78 parse of ``text`` at ``begin``; returns the open node.
    ``log`` gets each added edge, so that the additions can be taken back."""
    add = ends.append
    if log is None:
        log = []
    note = log.append
    for i, ch in enumerate(text[begin:] if begin else text, begin + 1):
        nxt = node.get(ch)
        if nxt is None:
            node[ch] = {}
            note((node, ch))
            add(i)
            node = root
        else:
            node = nxt
    return node


def fingerprint(text: str | None) -> np.ndarray:
    """Sorted minimum hashes of a text's phrase set."""
    text, root, ends = text or "", {}, []
    parse(text, root, root, 0, ends, None)
    return smallest(phrase_hashes(text, ends))


def fingerprints_sharing_prefix(text: str, edited: str, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts whose first ``shared`` code points are equal;
    that part is parsed once (an LZ78 parse depends on what stands before only)."""
    root, ends = {}, []
    node = parse(text[:shared], root, root, 0, ends, None)
    at, log = len(ends), []
    parse(text, root, node, shared, ends, log)
    first = smallest(phrase_hashes(text, ends))
    if edited == text:
        return first, first
    for parent, ch in reversed(log):
        del parent[ch]
    del ends[at:]
    parse(edited, root, node, shared, ends, None)
    return first, smallest(phrase_hashes(edited, ends))


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def from_text(fp: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fp), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of the phrase sets; exact while both fit."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right") / len(union))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint``.  Row by row, no shuffle."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([as_text(fingerprint(t)) for t in b.column(1).to_pylist()], pa.string())],
                ["doc_id", "fingerprint"])

    return plain(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _with_following(docs: DataFrame) -> DataFrame:
    """Deal documents into ranges of descending ``doc_id`` and add to each range
    the first document of the following one (the very first after the last).

    The ranges are cut at approximate quantiles of the ids.  Only the head of
    each range moves twice: one row per range, whatever the table's size.
    Columns: ``block, extra, doc_id, text``; sorted within partitions, so the
    row after a document is its following document."""
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or [0]
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    last = len(splits) - 1    # the block of documents without an id
    bucketed = Bucketizer(splits=splits, inputCol="__id", outputCol="__b", handleInvalid="keep")
    dealt = (bucketed.transform(docs.withColumn("__id", F.col("doc_id").cast("double")))
             .select(F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.lit(last - 1) - F.col("__b"))
                     .cast("int").alias("block"), "doc_id", "text"))
    heads = {r.block: r.head for r in dealt.groupBy("block").agg(F.max("doc_id").alias("head")).collect()}
    if not heads:
        return dealt.select("block", F.lit(False).alias("extra"), "doc_id", "text")
    order = sorted(heads)     # one per range, a number that the caller's settings bound
    before = {b: order[i - 1] for i, b in enumerate(order)}
    to = F.create_map(*[F.lit(x) for b in order for x in (b, before[b])])
    ids = [h for h in heads.values() if h is not None]
    is_head = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if last in heads:         # documents without an id: the one with the least text leads
        least = dealt.filter("block = %d" % last).agg(F.min("text")).first()[0]
        is_head = is_head | (F.col("doc_id").isNull() & (F.col("text") == F.lit(least)))
    extra = (dealt.filter(is_head).select(to[F.col("block")].alias("block"), "doc_id", "text")
             .groupBy("block", "doc_id").agg(F.min("text").alias("text")))
    both = dealt.select("block", F.lit(False).alias("extra"), "doc_id", "text").unionByName(
        extra.select("block", F.lit(True).alias("extra"), "doc_id", "text"))
    return both.repartition("block").sortWithinPartitions("block", "extra", F.col("doc_id").desc_nulls_last(), "text")


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprint every document and its edited text: the last floor(n/2) code
    points replaced by the first as many (or all) of the next document in
    descending ``doc_id`` (after the last: the first; equal ids by text; no id:
    last).  Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``."""
    on_workers(docs.sparkSession)
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")

    def rows(batches):
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        prev = waiting = None           # waiting: the previous row without its near_next

        def flush():
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                               [c.split()[0] for c in schema.split(", ")])
            out.clear()
            return batch

        for row in rows(batches):
            block, extra, doc_id, text = row
            if prev is not None and prev[0] == block and not prev[1]:
                n = len(prev[3])
                edited = prev[3][:n - n // 2] + text[:n // 2]
                a, e = fingerprints_sharing_prefix(prev[3], edited, n - n // 2)
                if waiting is not None:
                    out.append((*waiting[0], likeness(waiting[1], a)))
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                waiting = ((prev[2], n, sha, as_text(a), as_text(e), likeness(a, e)), a)
                if extra:               # the last of its block: the following one is parsed for it
                    out.append((*waiting[0], likeness(a, fingerprint(text))))
                    waiting = None
            prev = row
            if len(out) >= 512:
                yield flush()
        if out:
            yield flush()

    return _with_following(plain(docs)).mapInArrow(run, schema)
