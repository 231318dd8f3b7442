"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Words are the letter runs of all texts with their counts. To find the pairs that differ
by one inserted, deleted or replaced code point, the shorter word (either, at equal
lengths) contributes two disjoint chunks, its halves. One edit leaves a half as it is, in
the other word at the same place or one further, so the other word contributes its
positional grams within a shift of one and both meet in an equality join. A half alone
is shared by many words, so the key also holds a quarter: the edit lies in one quarter
of the other half, and the other quarter is preserved in the same way. Every pair at one
edit therefore shares at least one of four keys of three quarters of a word, and no
bucket holds all words with a common beginning or ending. Pairs that meet are verified
by their edit distance.

Each word's form is its near word with the largest count, if this is at least ``RATIO``
times its own. Counts rise along forms, so chains are short; roots come by pointer
doubling, a few joins of tables with one row per word.

Defined results: null and blank texts have no words, an empty table gives no rows. A null
id counts as an empty one where occurrences are chosen. Repeated rows count each. Ties
between forms go to the smallest word in code-point order. Other columns are not read
and may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.workspace import stage

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
# Maximal letter runs that are long enough: a shorter run has no match anywhere in it.
RUNS = f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"
# Of the occurrences whose hash this divides, one letter goes.
DROP_EVERY = 199


def _lowered(run: Column) -> Column:
    """A to Z in lower case. Only runs that any lower-casing changes are rewritten."""
    low = F.translate(run, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.lower(run) == run, run).otherwise(low)


def occurrences(docs: DataFrame, key: str, text: str, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word): one row for each occurrence, with one letter of the chosen ones gone."""
    whole = F.coalesce(F.col(key).cast("string"), F.lit(""))
    runs = F.transform(F.regexp_extract_all(F.col(text), F.lit(RUNS), F.lit(0)), _lowered)
    # Runs and their hashes are columns before they are used several times.
    hashed = F.transform(
        runs, lambda run: F.struct(run.alias("run"), F.crc32(F.concat_ws(":", whole, run).cast("binary")).alias("h"))
    )
    found = docs.select(F.inline(hashed).alias("run", "h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("run"))
    return found.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words with at least ``LEAST_COUNT`` occurrences."""
    counted = occurrences(docs, key, text).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _part(word: Column, begin: Column, end: Column) -> Column:
    return F.substring(word, begin + 1, end - begin)


def _keys(shift: int) -> Column:
    """The four keys that a word shares with one that is ``shift`` letters shorter.

    ``cuts`` are the ends of the quarters of the shorter word. Half and quarter are taken
    at the places they have there, those behind the edit ``shift`` places further.
    Without a shift these are the word's own chunks.
    """
    word, zero = F.col("word"), F.lit(0)
    first, half, third, length = (F.col(f"cut{k}") for k in range(4))
    spots = [
        ((zero, half, 0), (half, third, 0)),
        ((zero, half, 0), (third, length, shift)),
        ((half, length, shift), (zero, first, 0)),
        ((half, length, shift), (first, half, shift)),
    ]
    return F.array(
        *[
            F.struct(
                length.alias("length"),
                F.lit(place).alias("place"),
                _part(word, a + s, b + s).alias("chunk"),
                _part(word, c + t, d + t).alias("quarter"),
            )
            for place, ((a, b, s), (c, d, t)) in enumerate(spots)
        ]
    )


def _keyed(words: DataFrame, shift: int) -> DataFrame:
    """(word, n, key) of ``words`` as partners of words that are ``shift`` letters shorter."""
    length = F.length("word") - shift
    half = F.floor(length / 2)
    cuts = [F.floor(half / 2), half, half + F.floor((length - half) / 2), length]
    # The cuts are written, so that each is worked out once.
    cut = stage(words.withColumns({f"cut{k}": c.cast("int") for k, c in enumerate(cuts)}), "cuts")
    return cut.select("word", "n", F.explode(_keys(shift)).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words of ``words`` (word, n) at one edit, once."""
    chunks = _keyed(words, 0)
    grams = chunks.withColumn("shift", F.lit(0)).unionByName(
        _keyed(words, 1).withColumn("shift", F.lit(1))
    )
    met = chunks.toDF("a", "a_n", "key").join(grams.toDF("b", "b_n", "key", "shift"), "key")
    met = met.where((F.col("shift") == 1) | (F.col("a") < F.col("b")))
    met = met.where(F.levenshtein("a", "b", 1) == 1)
    return met.select("a", "a_n", "b", "b_n").distinct()


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms of each word of ``links`` (word, form)."""
    reached = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = reached.join(further, "root", "left")
        moved = joined.select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = stage(moved, "roots")
        reached = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return reached


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of words (word, n)."""
    words = stage(words.select("word", "n"), "words")
    pairs = stage(near_pairs(words), "near")
    both = pairs.select(
        F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")
    ).unionByName(pairs.select(F.col("b").alias("word"), F.col("a"), F.col("a_n")).toDF("word", "near", "near_n"))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    )
    best = best.select(
        "word", "n_near", F.col("best.near").alias("form"), (-F.col("best.col1")).alias("form_n")
    )
    found = words.join(best, "word", "left")
    enough = F.col("form_n") >= RATIO * F.col("n")
    found = stage(
        found.select(
            "word",
            F.when(enough, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Variants among all words of the documents."""
    return variants(word_counts(docs, key, text))
