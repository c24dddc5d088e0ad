"""Benchmark blocks: what several blocks find together, and what a block takes."""

import random

import numpy as np
import pytest

from helioframe.llm import decontam


def runs(text, item, window):
    """(item word, text word, length) of every maximal common run of at least a window, by trying all pairs."""
    least = min(window, len(item))
    for q in range(len(item)):
        for p in range(len(text)):
            if item[q] != text[p] or (q and p and item[q - 1] == text[p - 1]):
                continue
            n = 0
            while q + n < len(item) and p + n < len(text) and item[q + n] == text[p + n]:
                n += 1
            if n >= least:
                yield q, p, n


@pytest.mark.parametrize("block_words", [4, 9, 1000])
def test_matches_are_whole_across_blocks(spark, block_words):
    draw = random.Random(5)
    items = [(str(i % 7), draw.choices("abc", k=draw.randrange(1, 25))) for i in range(9)] + [(None, list("abcabc"))]
    texts = [(k, draw.choices("abcd", k=draw.randrange(30))) for k in range(8)] + [(0, list("abcabcabc")), (None, items[0][1])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id string, text string").coalesce(1)
    got = decontam.longest_matches(docs, bench, window=3, block_words=block_words)
    assert got.columns == ["doc_id", "item_id", "item_word", "doc_word", "n_words"]
    want = [(d, i, *m) for d, text in texts for i, item in items for m in runs(text, item, 3)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_a_long_item_keeps_its_word_positions(spark):
    passage = [f"w{i}" for i in range(500)]
    docs = spark.createDataFrame([(1, " ".join(["x", *passage[200:480], "y"]))], "doc_id bigint, text string")
    bench = spark.createDataFrame([("b", " ".join(passage))], "item_id string, text string")
    got = decontam.longest_matches(docs, bench, block_words=40).collect()
    assert [tuple(r) for r in got] == [(1, "b", 200, 1, 280)]


def test_a_block_is_arrays():
    """Beside its vocabulary a block holds less than a hundred bytes a word, whatever its items look like."""
    draw = np.random.default_rng(1)
    block = decontam.Block(10)
    for row in range(400):
        block.add(row, str(row), 0, [b"w%d" % w for w in draw.integers(0, 50_000, 500)])
    test = block.suffixes()
    held = sum(a.nbytes for a in (test.lower, test.lengths, test.first_place, test.place_row, test.place_word, test.rows))
    assert block.n_words == 200_000 and len(test.lengths) == 400 * 491 and held < 100 * block.n_words
    # Windows that occur again are kept once, with all their places.
    again = decontam.TestSuffixes.build([("a", [b"x"] * 30), ("b", [b"x"] * 12)], 10)
    assert len(again.lengths) == 1 and again.first_place.tolist() == [0, 24]
    assert sorted(zip(again.place_row.tolist(), again.place_word.tolist(), strict=True))[20:] == [(0, 20), (1, 0), (1, 1), (1, 2)]
