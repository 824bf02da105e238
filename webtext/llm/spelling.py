"""Spelling variants: words one edit apart, found by asymmetric q-chunks (operator 13).

**Words.** Runs of letters are counted by document and summed in each task; a
task sends a word once for every ``FLUSH`` distinct words it has met.

**Near words.** Of two near words the shorter one (of equally long ones, each in
turn) gives two disjoint chunks, its halves.  One edit leaves one of them whole.
The other word gives its positional grams: those that begin where a chunk of a
word as long as it, or one shorter, can lie, that is within a shift of one.
Chunks and grams are joined by (length, side, gram), and pairs verified by their
edit distance.

A gram that many words share ("-tion") would pair all of them.  Where a key would
make over ``HOT`` pairs its rows are not joined but split once more: the edit lies
in the rest of the word, whose two halves are again chunks of which one is whole.
That goes on until no key is hot or the rest is a single letter, so no pair is lost
and a key's pairs stay bounded by ``HOT`` or by the alphabet.

**Forms and roots.** A word's form is its near word of largest count if that is at
least twice its own.  Counts grow along a chain of forms, so it ends; roots are
found by pointer jumping, which halves the chains each round.

Defined results: a null text has no words; a null ``doc_id`` counts as the empty
text in the hash; repeated rows count each; an empty table gives no rows.  Words
compare by code point.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers, plain, saved

LETTERS = "A-Za-zÀ-ÿ"
#: The contract's damage: where DAMAGE divides a run's hash in its document, one code point goes.
DAMAGE = 97
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: Pairs that one key may make before it is split; distinct words a task holds before it sends them on.
HOT, FLUSH = 4096, 200_000


def count_words(docs: DataFrame, damage: int = DAMAGE, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word, n``: every word of ``min_length`` code points, and how often it occurs."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{min_length},}}").findall     # shorter runs cannot give a word
        held: Counter = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    # bytes.lower() changes A to Z only
                    for word, n in Counter(runs(text.encode().lower().decode())).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1:]
                            if len(word) < min_length:
                                continue
                        held[word] += n
                if len(held) > FLUSH:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return plain(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halves(rows: DataFrame) -> DataFrame:
    """Two rows for each: one keeps the first half of the rest as its gram, one the
    second.  ``rest`` is what may hold the edit, ``size`` the length of the rest on
    the chunk's side; a gram's second half is counted from the end, so that it
    meets the chunk also behind an inserted letter."""
    first = F.floor(F.col("size") / 2).cast("int")
    second = F.col("size") - first
    length = F.length("rest")

    def side(number: int, gram: Column, rest: Column, size: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(number), gram).alias("key"), rest.alias("rest"), size.alias("size"))

    both = F.array(side(0, F.substring("rest", F.lit(1), first), F.substring("rest", first + 1, length), second),
                   side(1, F.right("rest", second), F.substring("rest", F.lit(1), length - second), first))
    return rows.withColumn("half", F.explode(both)).select("word", "n", "chunk", "half.key", "half.rest", "half.size")


def near_pairs(words: DataFrame, hot: int = HOT, min_length: int = 1) -> DataFrame:
    """``a, a_n, b, b_n`` for all words (``word, n``) one edit apart, each pair once."""
    length = F.length("word")
    chunks = words.select("word", "n", F.lit(True).alias("chunk"), length.cast("long").alias("key"), length.alias("size"))
    grams = words.select("word", "n", F.lit(False).alias("chunk"), F.explode(F.array(length - 1, length)).alias("size"))
    rows = (chunks.unionByName(grams.filter(F.col("size") >= min_length).withColumn("key", F.col("size").cast("long")))
            .withColumn("rest", F.col("word")))
    found = []
    while True:
        rows = saved(_halves(rows), "halves")
        sides = rows.groupBy("key").agg(F.count_if("chunk").alias("c"), F.count_if(~F.col("chunk")).alias("g"), F.max("size").alias("s"))
        sides = (sides.filter("c > 0 AND g > 0")
                 .select("key", ((F.col("c") * F.col("g") > hot) & (F.col("s") > 1)).alias("hot")))
        dealt = saved(rows.join(sides, "key"), "dealt")
        cold = dealt.filter(~F.col("hot"))
        x = cold.filter("chunk").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        y = cold.filter(~F.col("chunk")).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
        pairs = x.join(y, "key").filter((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
        found.append(pairs.filter(F.levenshtein("a", "b", 1) == 1).drop("key"))
        rows = dealt.filter("hot").drop("hot")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found).dropDuplicates(["a", "b"])


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words that have a form: the end of the chain of forms."""
    now = saved(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.filter("moved").isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = saved(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return now.drop("moved")


def variants(docs: DataFrame, damage: int = DAMAGE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
             ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the documents."""
    words = saved(count_words(docs, damage, min_length).filter(F.col("n") >= min_count), "words")
    pairs = near_pairs(words, hot, min_length)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("other_n")).alias("minus_n"), "other")).alias("best"))
    enough = -F.col("best.minus_n") >= ratio * F.col("n")
    known = saved(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus_n")).alias("form_n")), "forms")
    return known.join(_roots(known.filter(F.col("form").isNotNull())), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
