"""Language identification with character-trigram profiles trained on Spark.

Training: every text is lower-cased, whitespace-collapsed and padded with one
space on each side; its trigrams are counted per language, first within each task.
Scoring is multinomial naive Bayes with add-one smoothing over the trigram
vocabulary: ``score(d, L) = sum_g n(d, g) * ln((c(L, g) + 1) / (T_L + V))``
over the document's trigrams that occur in the vocabulary.  The profile is
held wide (one row per trigram, one count column per language), so scoring is
one broadcast join on the trigram and one aggregate per document; the corpus-wide
totals ``T_L`` and ``V`` enter as scalar subqueries.

Training works on blocks of texts as arrays of numbers: a trigram is the three code
points of 21 bits each, so it never becomes a row or a string before it is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ..functions.text import collapse_ws
from ..session import on_workers

# --- fixed values ---------------------------------------------------------
STUDY_LANGUAGES = {"en": "eng", "de": "ger"}   # detected code -> study label
OTHER, ERROR = "Other", "Error"
# --- end of fixed values --------------------------------------------------

# A profile up to this many bytes (estimated from its rows) is broadcast.
MAX_BROADCAST_BYTES = 256 << 20
GRAM_BYTES = 48                # a row's trigram and overhead, without scores

# Code points that are worked on at a time; a longer text is cut into pieces.
BLOCK = 1 << 19
# Trigrams of a profile that the driver turns into numbers at a time.
_PART = 1 << 14
# Distinct trigrams that a training task holds before it passes their counts on.
HELD_GRAMS = 1 << 20

# A text whose best language has a smaller share of the probability is undecided.
MIN_POSTERIOR = 0.9


#: Whether a code point is white space, as ``collapse_ws`` takes it; none is beyond the table.
_SPACE = np.zeros(0x3002, bool)
_SPACE[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def padded(text) -> F.Column:
    return F.concat(F.lit(" "), F.lower(collapse_ws(text)), F.lit(" "))


def edged(text) -> F.Column:
    """:func:`padded` but for the white space, which is collapsed in arrays: a text of nothing else
    is then one space instead of two, and has no trigram either way."""
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def trigrams(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys..., gram): every trigram of each row's whole text, repeats included."""
    # every overlapping trigram in one linear regex pass: a zero-width match at
    # each position captures the three characters that follow it
    grams = F.regexp_extract_all(padded(F.col(text_col)), F.lit(r"(?s)(?=(.{3}))"), 1)
    # explode_outer + null filter keeps the optimizer from inferring (and
    # pushing down) a size() > 0 predicate that would extract the trigrams twice
    return (df.select(*keys, F.explode_outer(grams).alias("gram"))
            .filter(F.col("gram").isNotNull()))


def _blocks(texts: list[str | None], made=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, trigram) of every trigram of the texts, their white space collapsed, a block at a
    time, or what ``made`` makes of a block's rows and texts."""
    made = made or _numbered
    rows, pieces, size = [], [], 0
    for row, text in enumerate(texts):
        if len(text or "") > BLOCK + 2:
            text = _collapsed([text])[0].tobytes().decode("utf-32-le")
        # pieces of a long text overlap by two code points
        for at in range(0, len(text or "") - 2, BLOCK):
            piece = text if len(text) <= BLOCK + 2 else text[at:at + BLOCK + 2]
            rows.append(row)
            pieces.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield made(rows, pieces)
                rows, pieces, size = [], [], 0
    if pieces:
        yield made(rows, pieces)


def _numbered(rows: list[int], pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points, lengths = _collapsed(pieces)
    return np.repeat(rows, np.maximum(lengths - 2, 0)), _gram_numbers(points)[_within(lengths)]


def _collapsed(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the joined pieces, each run of white space in a piece as one space, and
    how many each piece has."""
    points, lengths = _points("".join(pieces)), np.array([len(p) for p in pieces])
    space, starts = _SPACE[np.minimum(points, len(_SPACE) - 1)], np.cumsum(lengths) - lengths
    kept = ~space
    kept[1:] |= ~space[:-1]
    kept[starts] = True
    return np.where(space, np.uint32(0x20), points)[kept], np.add.reduceat(kept, starts, dtype=np.int64)


def _within(lengths: np.ndarray) -> np.ndarray:
    """Which trigrams of joined pieces do not lie across two of them; a piece may have fewer
    than three code points."""
    ends = np.cumsum(lengths)
    within = np.ones(ends[-1], bool)
    within[ends - 1] = within[ends - 2] = False
    return within[:-2]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _gram_numbers(points: np.ndarray) -> np.ndarray:
    points = points.astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def _gram_counts(_: list[int], pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a block and their counts; with few letters each
    trigram has a place of its own in an array."""
    points, lengths = _collapsed(pieces)
    within = _within(lengths)
    code = np.zeros(points.max() + 1, np.int32)
    code[points] = 1
    letters = np.flatnonzero(code)
    k = len(letters)
    if k ** 3 > 4 * max(len(points), BLOCK):
        counts = pc.value_counts(pa.array(_gram_numbers(points)[within]))
        return counts.field(0).to_numpy(), counts.field(1).to_numpy()
    code[letters] = np.arange(k)
    codes = code[points]
    n = np.bincount(((codes[:-2] * k + codes[1:-1]) * k + codes[2:])[within], minlength=k ** 3)
    found = np.flatnonzero(n)
    return letters[found // k ** 2] << 42 | letters[found // k % k] << 21 | letters[found % k], n[found]


def _gram_texts(grams: np.ndarray) -> list[str]:
    points = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], 1).astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    return [text[i:i + 3] for i in range(0, len(text), 3)]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several blocks as one."""
    if len(parts) == 1:
        return parts[0]
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    sums = np.zeros(len(grams), np.int64)
    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
    return grams, sums


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n): the counts of a task, in as many parts as
    hold ``HELD_GRAMS`` distinct trigrams."""
    held: dict = {}
    kind = pa.string()

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = _added(parts)
            yield pa.record_batch([pa.repeat(pa.scalar(lang, kind), len(grams)), pa.array(_gram_texts(grams), pa.string()),
                                   pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        kind = batch.column(0).type
        for lang in batch.column(0).unique().to_pylist():
            texts = batch.column(1).filter(pc.equal(batch.column(0), pa.scalar(lang, kind)))
            for counts in _blocks(texts.to_pylist(), _gram_counts):
                held.setdefault(lang, []).append(counts)
                if len(held[lang]) >= 32:
                    held[lang] = [_added(held[lang])]
            if sum(len(g) for parts in held.values() for g, _ in parts) > HELD_GRAMS:
                held.update({k: [_added(parts)] for k, parts in held.items()})
                if sum(len(parts[0][0]) for parts in held.values()) > HELD_GRAMS:
                    yield from passed_on()
    yield from passed_on()


def language_profiles(train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) trigram counts per language, over every row with a label."""
    rows = train.select(F.col(lang_col).alias("lang"), edged(F.col(text_col)).alias("text")).filter(F.col("lang").isNotNull())
    schema = StructType().add("lang", rows.schema["lang"].dataType).add("gram", StringType()).add("n", LongType())
    on_workers(train.sparkSession)
    return rows.mapInArrow(_counted, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def wide_profile(profiles: DataFrame, languages: list[str]) -> DataFrame:
    """(gram, lp_<lang>...) smoothed log-probabilities, one row per trigram."""
    wide = (profiles.groupBy("gram").pivot("lang", languages).agg(F.sum("n"))
            .na.fill(0, subset=languages))
    vocab = profiles.select(F.count_distinct("gram")).scalar()
    out = wide
    for lang in languages:
        total = profiles.filter(F.col("lang") == lang).select(F.sum("n")).scalar()
        out = out.withColumn(f"lp_{lang}", F.log((F.col(lang) + 1) / (total + vocab)))
    return out.select("gram", *[f"lp_{lang}" for lang in languages])


def detect_language(df: DataFrame, profiles: DataFrame, languages: list[str],
                    key: str | list[str] = "doc_id", text_col: str = "text",
                    min_posterior: float = MIN_POSTERIOR, unique: bool = False) -> DataFrame:
    """Add ``language`` (study label: eng / ger / Other; Error when no trigram
    of the text is known, or when the text is undecided) and ``detected`` (best
    profile language, null for Error).

    With equal priors the best language's share of the probability is
    ``1 / sum_L exp(score(d, L) - best score)``; below ``min_posterior``, ties
    included, the text is undecided.

    A score is a sum over trigrams, so they are joined to the broadcast profile
    where they are read and summed per row before the only exchange, which
    carries one row per document and task.  A profile too large to broadcast is
    joined on the trigram, after the repeats within each row are counted.

    ``df`` is read twice, so a long plan should be written first.  ``unique`` says
    that every row has a key of its own."""
    keys = [key] if isinstance(key, str) else list(key)
    if not unique:
        # rows that share a key, or have none, are told apart by their texts
        df, keys = df.withColumn("_text", F.md5(text_col)), [*keys, "_text"]
    prof = wide_profile(profiles, languages)
    grams = trigrams(df.select(*keys, text_col), keys, text_col).withColumn("n", F.lit(1))
    if _fits_broadcast(profiles, languages):
        prof = F.broadcast(prof)
    else:
        grams = grams.groupBy(*keys, "gram").agg(F.sum("n").alias("n"))
    scored = (grams.join(prof, "gram")
              .groupBy(*keys).agg(*[F.sum(F.col("n") * F.col(f"lp_{lang}")).alias(f"s_{lang}")
                                    for lang in languages]))
    named = [F.struct(F.col(f"s_{lang}").alias("s"), F.lit(lang).alias("lang")) for lang in languages]
    scored = scored.withColumn("_best", F.greatest(*named) if len(named) > 1 else named[0])
    odds = reduce(add, [F.exp(F.col(f"s_{lang}") - F.col("_best.s")) for lang in languages])
    scored = scored.select(*keys, F.when(1 / odds >= min_posterior, F.col("_best.lang")).alias("detected"))
    scored = scored.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return _labelled(df.join(scored, same, "left").drop("_text", *[f"_k_{k}" for k in keys]), text_col)


def _labelled(df: DataFrame, text_col: str) -> DataFrame:
    label = F.coalesce(*[F.when(F.col("detected") == k, F.lit(v)) for k, v in STUDY_LANGUAGES.items()],
                       F.lit(OTHER))
    blank = F.col(text_col).isNull() | ~F.col(text_col).rlike(r"(?U)\S")
    return df.withColumn("language", F.when(blank, F.lit(OTHER))
                         .when(F.col("detected").isNull(), F.lit(ERROR)).otherwise(label))


def _fits_broadcast(profiles: DataFrame, languages: list[str]) -> bool:
    n_grams = profiles.select(F.count_distinct("gram")).first()[0]
    return n_grams * (GRAM_BYTES + 8 * len(languages)) <= MAX_BROADCAST_BYTES


def detect_in_blocks(df: DataFrame, profiles: DataFrame, languages: list[str], key: str, text_col: str = "text",
                     min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """:func:`detect_language` of rows that each have a ``key`` of their own, for plans
    in which tasks may use arrays: a row is scored where it is read against the broadcast
    profile, without a row per trigram, an exchange or a second reading.  A profile too
    large to broadcast is joined."""
    if not _fits_broadcast(profiles, languages):
        return detect_language(df, profiles, languages, key, text_col, min_posterior, unique=True)
    best = _detector(df.sparkSession, wide_profile(profiles, languages), languages, min_posterior)
    return _labelled(df.withColumn("detected", best(edged(F.col(text_col)))), text_col)


def _detector(spark, prof: DataFrame, languages: list[str], min_posterior: float):
    """:func:`edged` text -> best language, or null; ``prof`` is broadcast."""
    on_workers(spark)
    wide = prof.toArrow()
    order = sorted(languages, reverse=True)      # of equal scores the first is taken
    # the last row counts the known trigrams; the last column is that of an unknown one
    scores, known = np.zeros((len(order) + 1, wide.num_rows + 1)), np.zeros(wide.num_rows, np.int64)
    scores[-1, :-1] = 1
    at = 0
    # in parts, as trigrams take several times as much memory as text than as numbers
    for part in wide.to_batches(max_chunksize=_PART):
        here = slice(at, at := at + part.num_rows)
        for i, lang in enumerate(order):
            scores[i, here] = part.column(f"lp_{lang}").to_numpy(zero_copy_only=False)
        known[here] = _gram_numbers(_points("".join(part.column("gram").to_pylist())))[::3]
    del wide
    model = spark.sparkContext.broadcast((known, scores))

    def detected(texts: pa.Array) -> pa.Array:
        known, scores = model.value
        sums = np.zeros((len(scores), len(texts)))
        for rows, grams in _blocks(texts.to_pylist()):
            at = pc.index_in(pa.array(grams), value_set=pa.array(known)).fill_null(len(known)).to_numpy()
            if not len(rows):
                continue
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            for total, score in zip(sums, scores):
                total[rows[starts]] += np.add.reduceat(score.take(at), starts)
        best = sums[:-1].argmax(0)
        odds = np.exp(sums[:-1] - sums[:-1].max(0)).sum(0)
        decided = (sums[-1] > 0) & (1 / odds >= min_posterior)
        return pa.array([order[b] if d else None for b, d in zip(best, decided)], pa.string())

    # not evaluated again for a filter on its result
    return F.arrow_udf(detected, "string").asNondeterministic()


def filter_language(df: DataFrame, keep=("eng", "ger"), col: str = "language") -> DataFrame:
    return df.filter(F.col(col).isin(list(keep)))
