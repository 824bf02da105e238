"""Class probabilities of texts, from hand-coded rows, one model per language.

The model is a multinomial naive Bayes over words (runs of letters, lower-cased)
with add-one smoothing, counted in one aggregate over all hand-coded rows:
``score(t, L, c) = ln P(c | L) + sum_w n(t, w) * ln((n(L, c, w) + 1) / (T(L, c) + V(L)))``
over the words that the language's hand-coded rows hold.  A text's log-probabilities
are its scores less the logarithm of the sum of their exponentials.

Null and empty texts have the prior of their language; texts in a language without
hand-coded rows, or in none, have no probabilities.  Rows without a class or a
language teach nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scores import CONCEPT_LABELS

CODES = list(CONCEPT_LABELS)
# Words of a model that take up to this many bytes of memory are broadcast.
MAX_BROADCAST_BYTES = 64 << 20
# What a broadcast word takes beside its letters, which are there twice.
WORD_BYTES = 192


def held_out(key) -> F.Column:
    """About a third of the rows, by the first digit of the key's MD5 hash."""
    return F.substring(F.md5(key.cast("string")), 1, 1).between("0", "4")


def words(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys..., word): every word of each row; one null where a row has none."""
    found = F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), 0)
    return df.select(*keys, F.explode_outer(found).alias("word"))


def word_model(coded: DataFrame) -> DataFrame:
    """(language, word, lp_<code>...) from rows (language, text, code)."""
    rows = coded.filter(F.col("code").isin(CODES) & F.col("language").isNotNull())
    counts = (words(rows, ["language", "code"]).filter(F.col("word").isNotNull()).groupBy("language", "word")
              .agg(*[F.count_if(F.col("code") == c).alias(f"n_{c}") for c in CODES]))
    totals = counts.groupBy("language").agg(F.count(F.lit(1)).alias("v"),
                                            *[F.sum(f"n_{c}").alias(f"t_{c}") for c in CODES])
    return (counts.join(totals, "language")
            .select("language", "word", *[F.log((F.col(f"n_{c}") + 1) / (F.col(f"t_{c}") + F.col("v"))).alias(f"lp_{c}")
                                          for c in CODES]))


def priors(coded: DataFrame) -> DataFrame:
    """(language, p_<code>...): logarithm of the share of each class."""
    rows = coded.filter(F.col("code").isin(CODES) & F.col("language").isNotNull())
    shares = rows.groupBy("language").agg(F.count(F.lit(1)).alias("d"),
                                          *[F.count_if(F.col("code") == c).alias(f"d_{c}") for c in CODES])
    return shares.select("language", *[F.log((F.col(f"d_{c}") + 1) / (F.col("d") + len(CODES))).alias(f"p_{c}")
                                       for c in CODES])


def split_model(model: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent words of the model, as many as may be broadcast, and the others if
    there are any.  The size is that in memory, some ten times that of the model's files."""
    n, letters = model.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    size = n * WORD_BYTES + 2 * letters
    if size <= MAX_BROADCAST_BYTES or not n:
        return model, None
    share = reduce(add, [F.exp(f"lp_{c}") for c in CODES])
    least = model.agg(F.percentile_approx(share, 1 - max(MAX_BROADCAST_BYTES, 0) / size)).first()[0]
    # words as frequent as the least one are many: all of them are among the others
    return model.filter(share > least), model.filter(share <= least)


def class_scores(df: DataFrame, model: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., token, logprob): a row per class for each row (keys..., language,
    text) of ``df``; rows of one key and language are scored as one text.

    A score is a sum, so the model's words are joined where the words are read and summed
    per row before the only exchange of the scores.  Of a model too large to broadcast this
    holds for its most frequent words, which are most of any text; the words not found there
    are read again and joined to the others by language and word.  ``df`` is then read twice,
    so a long plan should be written first."""
    scores = [f"lp_{c}" for c in CODES]
    frequent, rare = split_model(model)
    found = words(df, [*keys, "language"]).join(F.broadcast(frequent), ["language", "word"], "left")
    if rare is not None:
        # looks at all scores, so that both readings share one broadcast
        others = found.filter(F.coalesce(*scores).isNull()).select(*keys, "language", "word")
        # by its files' size the rest of the model may look small enough to be broadcast
        found = found.unionByName(others.join(rare.hint("merge"), ["language", "word"]))
    sums = (found.groupBy(*keys, "language")
            .agg(*[F.coalesce(F.sum(f"lp_{c}"), F.lit(0.0)).alias(f"s_{c}") for c in CODES]))
    scored = sums.join(prior, "language").select(*keys, *[(F.col(f"s_{c}") + F.col(f"p_{c}")).alias(f"s_{c}") for c in CODES])
    top = F.greatest(*[F.col(f"s_{c}") for c in CODES])
    scored = scored.withColumn("_top", top)
    rest = F.log(reduce(add, [F.exp(F.col(f"s_{c}") - F.col("_top")) for c in CODES]))
    found = F.array(*[F.struct(F.lit(str(c)).alias("token"), (F.col(f"s_{c}") - F.col("_top") - rest).alias("logprob"))
                      for c in CODES])
    return scored.select(*keys, F.inline(found))
