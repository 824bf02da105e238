"""Language-model scoring with sharded Elias-Fano tries (operator 7).

A bigram model with absolute discounting, interpolated with the smoothed word
distribution:

    p(w | h) = max(c(h, w) - D, 0) / c(h) + D * T(h) / c(h) * (c(w) + 1) / (N + V + 1)

c: counts in the training documents, T(h): distinct words seen after h.  A
document is one line of words and an end token, which is also the first word's
context.

1.  Documents become chunks of about ``CHUNK`` tokens: the sorted hashes of the
    chunk's words, and its tokens as places among them.  Chunks are written to
    the shared folder once; all later steps read the same chunks.
2.  Each chunk sends each shard one message: its words and word pairs there,
    each once, with their counts in training documents.  A pair belongs to its
    context's shard.  The few contexts that hold more than a 1/``HOT``-th of the
    tokens are split over all shards by their next word; there are at most
    2 * ``HOT`` of these, whose counts are broadcast.
    There are as many shards as shuffle partitions, or more, so that none stands for
    over ``SHARD_TOKENS`` tokens.
3.  A shard adds up its messages, builds its trie, maps it into memory and
    answers every message from it: counts of words, codes of smoothed
    probabilities of pairs, in the message's order.
4.  Each chunk meets its answers and scores its documents.

Counts cover the whole corpus; nothing is pruned.  Words are told apart by
64-bit hashes, a context's next words by 40 bits of these.

Defined results: a null or empty text is its end token alone; a null ``doc_id``
trains; without training documents every count is 0, and a token's probability
is 1 / (0 + 0 + 1).
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, partitions, plain, saved
from .eliasfano import MappedTrie, Trie, decades, quantise, restore

DISCOUNT = 0.75
#: Tokens of a chunk; a longer document is a chunk of its own.
CHUNK = 2_000_000
HOT = 1000
#: A shard stands for at most so many tokens of the corpus.
SHARD_TOKENS = 32_000_000
END = xxhash.xxh64_intdigest(b"\n", 0)      # white space is never part of a word
_CHILD = np.uint64((1 << Trie.CHILD_BITS) - 1)

CHUNK_SCHEMA = ("chunk string, ids array<long>, held array<boolean>, lengths array<int>, "
                "vocabulary binary, counts binary, tokens binary")


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def _chunk(ids, held, lengths, numbers: dict[bytes, int], tokens: list[np.ndarray]) -> pa.RecordBatch:
    """Places among the words as met become places among the sorted hashes."""
    hashes = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w, 0) for w in numbers), np.uint64, len(numbers))
    vocabulary, place = np.unique(hashes, return_inverse=True)
    stream = place.astype("<u4")[np.concatenate(tokens)]
    training = np.repeat(~np.array(held, bool), lengths)
    counts = np.bincount(stream[training], minlength=len(vocabulary)).astype("<u4")
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
         pa.array([lengths], pa.list_(pa.int32())),
         *(pa.array([a.tobytes()], pa.binary()) for a in (vocabulary.astype("<u8"), counts, stream))],
        [c.split()[0] for c in CHUNK_SCHEMA.split(", ")])


def chunks(docs: DataFrame, held=held_out, size: int = CHUNK) -> DataFrame:
    """Documents as chunks of tokens, each row one chunk."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            numbers: defaultdict[bytes | None, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            return [], [], [], numbers, []

        ids, out, lengths, numbers, tokens = fresh()
        n = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                ids.append(doc_id)
                out.append(held(doc_id))
                lengths.append(len(words) + 1)
                place = numbers.__getitem__
                tokens.append(np.array([*map(place, words), place(None)], "<u4"))
                n += len(words) + 1
                if n >= size:
                    yield _chunk(ids, out, lengths, numbers, tokens)
                    ids, out, lengths, numbers, tokens = fresh()
                    n = 0
        if ids:
            yield _chunk(ids, out, lengths, numbers, tokens)

    return plain(docs).mapInArrow(run, CHUNK_SCHEMA)


class Layout:
    """A chunk's distinct words and pairs and the shard that each belongs to;
    worked out again, always the same, when the answers come."""

    def __init__(self, row: dict, hot: np.ndarray, shards: int) -> None:
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<u4")
        self.tokens = np.frombuffer(row["tokens"], "<u4").astype(np.int64)
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.held = np.asarray(row["held"], bool)
        end = int(np.searchsorted(self.vocabulary, np.uint64(END)))
        before = np.concatenate([[end], self.tokens[:-1]])      # each document ends with the end token
        width = np.uint64(len(self.vocabulary))
        pairs = before.astype(np.uint64) * width + self.tokens.astype(np.uint64)
        keys, self.pair_of_token, = np.unique(pairs, return_inverse=True)
        self.first, self.second = (keys // width).astype(np.int64), (keys % width).astype(np.int64)
        training = np.repeat(~self.held, self.lengths)
        self.pair_counts = np.bincount(self.pair_of_token[training], minlength=len(keys)).astype("<u4")
        s = np.uint64(shards)
        self.home = ((self.vocabulary >> np.uint64(20)) % s).astype(np.int64)
        self.is_hot = np.isin(self.vocabulary, hot, kind="sort")
        nxt = ((self.vocabulary >> np.uint64(7)) % s).astype(np.int64)
        self.pair_shard = np.where(self.is_hot[self.first],
                                   (self.home[self.first] + nxt[self.second]) % shards, self.home[self.first])
        self.pair_order = np.argsort(self.pair_shard, kind="stable")
        self.pair_cuts = np.searchsorted(self.pair_shard[self.pair_order], np.arange(shards + 1))
        self.word_order = np.argsort(self.home, kind="stable")
        self.word_cuts = np.searchsorted(self.home[self.word_order], np.arange(shards + 1))

    def of_shard(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shard's words (all contexts of its pairs too) and pairs."""
        pairs = self.pair_order[self.pair_cuts[shard]:self.pair_cuts[shard + 1]]
        own = self.word_order[self.word_cuts[shard]:self.word_cuts[shard + 1]]
        words = np.union1d(own, self.first[pairs])
        return words, pairs

    def message(self, shard: int) -> tuple[bytes, ...]:
        words, pairs = self.of_shard(shard)
        child = (self.vocabulary[self.second[pairs]] & _CHILD).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        begin = np.searchsorted(self.first[pairs], words).astype("<u4")
        counts = np.where(self.home[words] == shard, self.counts[words], 0).astype("<u4")
        return (self.vocabulary[words].tobytes(), zlib.compress(counts.tobytes(), 1), zlib.compress(begin.tobytes(), 1),
                np.ascontiguousarray(child).tobytes(), zlib.compress(self.pair_counts[pairs].tobytes(), 1))


_MESSAGE = ["words", "counts", "begin", "children", "pair_counts"]


class _Message:
    def __init__(self, words, counts, begin, children, pair_counts) -> None:
        self.words = np.frombuffer(words, "<u8")
        self.counts = np.frombuffer(zlib.decompress(counts), "<u4")
        self.begin = np.frombuffer(zlib.decompress(begin), "<u4").astype(np.int64)
        child = np.zeros((len(children) // 5, 8), np.uint8)
        child[:, :5] = np.frombuffer(children, np.uint8).reshape(-1, 5)
        self.children = child.view("<u8")[:, 0]
        self.pair_counts = np.frombuffer(zlib.decompress(pair_counts), "<u4")
        self.context = np.repeat(np.arange(len(self.words)), np.diff(np.append(self.begin, len(self.children))))


def hot_words(parts: DataFrame, share: int = HOT) -> dict[int, int]:
    """Training counts of all words with more than 1/``share`` of the tokens
    (as signed hashes).  Such a word has half of its mass in chunks where it has
    over half that share, so summing what chunks report there finds it, and no
    more than 2 * ``share`` words can pass."""
    def emit(limit):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for v, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    v, c = np.frombuffer(v, "<u8"), np.frombuffer(c, "<u4").astype(np.int64)
                    at = limit(v, c)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.append(v[at].view(np.int64), 0), pa.int64()), pa.array(np.append(c[at], c.sum()), pa.int64()),
                         pa.array(np.append(np.ones(len(at), bool), False))], ["word", "n", "is_word"])
        return parts.select("vocabulary", "counts").mapInArrow(run, "word long, n long, is_word boolean") \
            .groupBy("word", "is_word").agg(F.sum("n").alias("n"))

    reported = saved(emit(lambda v, c: np.flatnonzero(2 * share * c > c.sum())), "lm-hot")
    total = reported.filter("not is_word").agg(F.sum("n")).first()[0] or 0
    hot = np.sort(np.array([r.word for r in reported.filter("is_word").filter(F.col("n") * (2 * share) > total)
                           .select("word").collect()], np.int64))                       # at most 2 * share
    exact = emit(lambda v, c: np.flatnonzero(np.isin(v.view(np.int64), hot))).filter("is_word").collect()
    return {r.word: r.n for r in exact}


def _levels(messages: list[_Message], hot: dict[int, int]) -> tuple[MappedTrie, tuple]:
    """The shard's trie from all of its messages, and what is told once per
    shard: distinct words, hot contexts, their children."""
    words, at = np.unique(np.concatenate([m.words for m in messages]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([m.counts for m in messages]), len(words)).astype(np.int64)
    if len(words) >= 1 << (64 - Trie.CHILD_BITS):
        raise ValueError("more words in a shard than context numbers: raise spark.sql.shuffle.partitions")
    cuts = np.cumsum([0, *(len(m.words) for m in messages)])
    key = np.concatenate([(at[a:b][m.context].astype(np.uint64) << np.uint64(Trie.CHILD_BITS)) | m.children
                          for m, a, b in zip(messages, cuts, cuts[1:])])
    pair_counts = np.concatenate([m.pair_counts for m in messages])
    seen = pair_counts > 0
    key, place = np.unique(key[seen], return_inverse=True)
    pair_counts = np.bincount(place, pair_counts[seen], len(key))
    context = (key >> np.uint64(Trie.CHILD_BITS)).astype(np.int64)
    of_context = counts.copy()
    split = np.flatnonzero(np.isin(words.view(np.int64), np.array(sorted(hot), np.int64)))
    for i in split:
        of_context[i] = hot[int(words.view(np.int64)[i])]
    p = np.maximum(pair_counts - DISCOUNT, 0) / np.maximum(of_context[context], 1)
    begin = np.searchsorted(context, np.arange(len(words) + 1))
    told = (int((counts > 0).sum()), words[split].view(np.int64).tolist(),
            (begin[split + 1] - begin[split]).tolist())
    reach = decades(p)       # 0.25 / c(h) or more: grows with the counts, so no code is rounded up
    return MappedTrie(words, counts, begin, key, quantise(p, reach), reach=reach), told


def answer(t: pa.Table, hot: dict[int, int], shard: int) -> Iterator[tuple]:
    """Build the shard's trie from all of its messages; answer each of them.
    Yields (chunk, word counts, children counts, pair codes, their range) and, in the first
    row, what is told once per shard.  While it answers, the trie is mapped and only
    one message is open."""
    rows = [t.column(c) for c in _MESSAGE]
    opened = lambda i: _Message(*(c[i].as_py() for c in rows))
    mapped, told = _levels([opened(i) for i in range(t.num_rows)], hot)
    with mapped as trie:
        for i, name in enumerate(t.column("chunk").to_pylist()):
            m = opened(i)
            number = trie.find(m.words)
            yield (name, trie.counts[number].astype("<u8").tobytes(), trie.n_children(number).astype("<u4").tobytes(),
                   trie.child_codes(number[m.context], m.children).tobytes(), trie.reach,
                   *(told if i == 0 else (0, [], [])))


def score(docs: DataFrame, held=held_out, size: int = CHUNK, hot_share: int = HOT,
          shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    parts = saved(chunks(docs, held, size), "lm-chunks")
    tokens = parts.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(partitions(spark), -(-tokens // shard_tokens))
    hot_counts = hot_words(parts, hot_share)
    hot = np.sort(np.array(list(hot_counts), np.int64).view(np.uint64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                layout = Layout(row, hot, shards)
                for shard in range(shards):
                    m = layout.message(shard)
                    if len(m[0]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard], pa.int32()), pa.array([row["chunk"]]),
                             *(pa.array([x], pa.binary()) for x in m)], ["shard", "chunk", *_MESSAGE])

    def reply(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        cols = list(zip(*answer(t, hot_counts, shard)))
        return pa.table({"chunk": pa.array(cols[0]), "shard": pa.array([shard] * len(cols[0]), pa.int32()),
                         **{n: pa.array(c, pa.binary()) for n, c in zip(("counts", "followers", "codes"), cols[1:4])},
                         "reach": pa.array(cols[4], pa.float64()), "distinct": pa.array(cols[5], pa.int64()),
                         "hot": pa.array(cols[6], pa.list_(pa.int64())), "hot_n": pa.array(cols[7], pa.list_(pa.int64()))})

    sent = parts.mapInArrow(send, "shard int, chunk string, " + ", ".join(f"{n} binary" for n in _MESSAGE))
    replies = saved(sent.repartition(shards, "shard").groupBy("shard").applyInArrow(
        reply, "chunk string, shard int, counts binary, followers binary, codes binary, reach double, distinct long, "
               "hot array<long>, hot_n array<long>"), "lm-answers")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(np.frombuffer(c, "<u4").sum()) for c in b.column(0).to_pylist()], pa.int64())], ["n"])

    n_tokens = parts.select("counts").mapInArrow(sums, "n long").agg(F.sum("n")).first()[0] or 0
    n_words = replies.agg(F.sum("distinct")).first()[0] or 0
    # words seen after each hot context, summed over the shards it is split over
    hot_followers = {r.word: r.n for r in replies.select(F.explode(F.arrays_zip("hot", "hot_n")).alias("x"))
                     .groupBy(F.col("x.hot").alias("word")).agg(F.sum("x.hot_n").alias("n")).collect()}

    def result(key, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        layout = Layout(row, hot, shards)
        c = np.zeros(len(layout.vocabulary), np.int64)
        followers = np.zeros(len(layout.vocabulary), np.int64)
        seen_p = np.zeros(len(layout.first))
        for a in answers.to_pylist():
            words, pairs = layout.of_shard(a["shard"])
            own = layout.home[words] == a["shard"]
            c[words[own]] = np.frombuffer(a["counts"], "<u8")[own]
            followers[words[own]] = np.frombuffer(a["followers"], "<u4")[own]
            seen_p[pairs] = restore(np.frombuffer(a["codes"], np.uint8), a["reach"])
        for i in np.flatnonzero(layout.is_hot):
            followers[i] = hot_followers.get(int(layout.vocabulary.view(np.int64)[i]), 0)
        word_p = (c + 1) / (n_tokens + n_words + 1)
        # a context without training tokens leaves all its mass to the words
        back = np.where(c > 0, DISCOUNT * followers / np.maximum(c, 1), 1.0)
        pair_p = seen_p + back[layout.first] * word_p[layout.second]
        starts = np.cumsum(layout.lengths) - layout.lengths
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(layout.held),
            "n_tokens": pa.array(layout.lengths), "n_known": pa.array(add((c > 0).astype(np.int64)[layout.tokens])),
            "train_tokens": pa.array([n_tokens] * len(starts), pa.int64()),
            "base_score": pa.array(add(np.log10(word_p)[layout.tokens])),
            "score": pa.array(add(np.log10(pair_p)[layout.pair_of_token]))})

    return (parts.groupBy("chunk").cogroup(replies.select("chunk", "shard", "counts", "followers", "codes", "reach").groupBy("chunk"))
            .applyInArrow(result, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double"))
