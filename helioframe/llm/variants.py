"""Spelling variants: words that differ by one character, found through permuterm rotations.

A word is marked by a terminator and written in all its rotations. If two words of equal length differ in one place, the
rotations that end with the differing character share everything before it: that prefix, which skips the edited character,
is one range of the sorted rotations. If one word has a character more, its prefix that skips this character is a
whole rotation of the other word. So a word is entered under its rotations without their last character ("skipping"
entries) and under its whole rotations, the entries are sorted, and each range of equal keys is scanned: skipping entries
with each other are replacements, a skipping and a whole entry are an insertion or deletion. Every pair of near words
meets in exactly one range, since of a run of equal characters only the first place is entered for deletions.

A range holds at most one entry per character of the alphabet and one whole rotation; no pairs are written out to count
and rank neighbours, as a scan of a sorted range knows the best two of it, and every member's best neighbour is one of them.

A word's form is its near word of largest count, if that is ``factor`` times its own. Counts grow along forms, so following
them ends; the last one is the root, found by doubling the steps.

Defined cases: a null or empty text has no words; texts are read whole; repeated rows count again; a null id counts as an
empty one; words below the limits of length and count are no words of the result, nor neighbours; the terminator is a
character that no word can hold; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.common import written

#: The characters whose runs are words.
LETTERS = r"[A-Za-z\u00C0-\u00FF]"
LEAST_CHARS, LEAST_COUNT = 6, 5
TERMINATOR = "$"


def runs(docs: DataFrame, text: str = "text", least_chars: int = 1) -> DataFrame:
    """One row per maximal run of at least so many letters, ``doc_id`` and ``run``; only A-Z are lower-cased."""
    lowered = F.translate(F.col(text).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    found = F.regexp_extract_all(lowered, F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def misspelt(run: Column, doc_id: Column, one_in: int = 199) -> Column:
    """``run``, or with a checksum of id and run that ``one_in`` divides, ``run`` without one of its characters."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (mark % F.length(run)).cast("int")
    short = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(mark % one_in == 0, short).otherwise(run)


def word_counts(
    words: DataFrame, word: str = "word", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT
) -> DataFrame:
    """``word`` and its count ``n``. Partial counts are made before the shuffle, so no frequent word is a hot key."""
    long = words.where(F.length(word) >= least_chars)
    return long.groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame, terminator: str = TERMINATOR) -> DataFrame:
    """The entries of each word: ``key``, whether it is a ``whole`` rotation, and whether it ``first`` skips a character
    of its run of equal ones."""
    marked = F.concat(F.col("word"), F.lit(terminator))
    n = F.length("word")
    twice = F.concat(marked, marked)
    at = F.col("at")
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), n)).alias("at"))
    entry = F.explode(
        F.array(
            F.struct(F.substr(twice, at + 1, n + 1).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("first")),
            # The place n is the terminator's, which is never skipped.
            F.when(
                at < n,
                F.struct(
                    F.substr(twice, at + 2, n).alias("key"),
                    F.lit(False).alias("whole"),
                    (F.substr(F.col("word"), at + 1, F.lit(1)) != F.substr(F.concat(F.lit(terminator), F.col("word")), at + 1, F.lit(1))).alias("first"),
                ),
            ),
        )
    )
    return places.select("word", "n", entry.alias("e")).where("e is not null").select("word", "n", "e.*")


def neighbourhoods(entries: DataFrame) -> DataFrame:
    """Per entry with neighbours in its range: ``word``, how many (``near``) and the ``best`` of them.

    ``best`` is a struct that is smaller for a better neighbour: minus its count, then the word.
    """
    ranked = entries.withColumn("rank", F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word")))
    group = Window.partitionBy("key")
    order = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    skipping = F.when(~F.col("whole"), F.col("rank"))
    first = F.when(F.col("first"), F.col("rank"))
    scanned = ranked.select(
        "word",
        "rank",
        "whole",
        "first",
        F.count(skipping).over(group).alias("n_skip"),
        F.count(first).over(group).alias("n_first"),
        F.min(skipping).over(group).alias("best_skip"),
        F.min(first).over(group).alias("best_first"),
        F.min(F.when(F.col("whole"), F.col("rank"))).over(group).alias("the_whole"),
        # The best skipping entry besides one's own: the one before or behind in the order of ranks that leads it.
        F.nth_value(skipping, 2, ignoreNulls=True).over(order).alias("second_skip"),
    )
    other = F.when(F.col("best_skip") == F.col("rank"), F.col("second_skip")).otherwise(F.col("best_skip"))
    near = F.when(F.col("whole"), F.col("n_first")).otherwise(
        F.col("n_skip") - 1 + F.when(F.col("first") & F.col("the_whole").isNotNull(), 1).otherwise(0)
    )
    best = F.when(F.col("whole"), F.col("best_first")).otherwise(
        F.least(other, F.when(F.col("first"), F.col("the_whole")))
    )
    return scanned.select("word", near.alias("near"), best.alias("best")).where("near > 0")


def near_pairs(words: DataFrame) -> DataFrame:
    """Every pair of near words once, ``a`` before ``b``. A range pairs at most an alphabet of words, all of them near."""
    entries = rotations(words)
    w = Window.partitionBy("key").orderBy("word")
    members = entries.withColumn("members", F.collect_list(F.struct("word", "whole", "first")).over(w))
    pairs = members.select("word", "whole", "first", F.explode("members").alias("m")).where(
        F.when(F.col("whole"), F.col("m.first")).when(F.col("m.whole"), F.col("first")).otherwise(True)
        & (F.col("word") != F.col("m.word"))
    )
    return pairs.select(F.col("m.word").alias("a"), F.col("word").alias("b"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for rows of ``word`` and ``form``. Every round doubles the steps made, and a count that grows
    by a factor with every step bounds the steps, so a few rounds do."""
    out = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = written(out.join(ahead, "root", "left"))
        if not moved.where("ahead is not null").limit(1).count():
            return out
        out = moved.select("word", F.coalesce("ahead", "root").alias("root"))


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """Per row of ``word`` and ``n``: its ``form``, its ``root``, ``n``, the number of near words and the form's count.
    ``words`` holds a word once and should be a written table, as it is read more than once."""
    near = (
        neighbourhoods(rotations(words))
        .groupBy("word")
        .agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    )
    strong = -F.col("best.minus") >= F.lit(factor) * F.col("n")
    found = written(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(strong, F.col("best.word")).alias("form"),
            F.when(strong, -F.col("best.minus")).cast("bigint").alias("form_n"),
        )
    )
    led = roots(found.where("form is not null"))
    return found.join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def document_variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    one_in: int = 199,
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    factor: int = 5,
) -> DataFrame:
    """Spelling variants among the words of whole documents, one in ``one_in`` runs misspelt on purpose. A misspelt run
    is shorter than it was, so shorter runs than the limit need not be read."""
    found = runs(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", least_chars)
    words = found.select(misspelt(F.col("run"), F.col("doc_id"), one_in).alias("word"))
    return spelling_variants(written(word_counts(words, "word", least_chars, least_count)), factor)
