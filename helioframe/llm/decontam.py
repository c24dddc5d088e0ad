"""Benchmark decontamination by suffix arrays of the training text.

Each task cuts its documents into shards of a bounded size and sorts the suffixes of every shard, word by word.
All suffixes of the benchmark items are then looked up in every shard by binary search; the places where one
agrees with the text for a whole window give the verbatim matches, and overlapping ones join to the longest match.
Nothing is shuffled, and a task holds one shard at a time.

A shard's words are numbered by the benchmark's vocabulary. Words that no item has are all number 0: no test suffix
passes them, so they end a suffix just as the end of a document does.

Defined cases: a null or empty text has no words and is clean; an item without words matches nothing; an item without
id marks words but is not listed; several rows of one item_id count as one item; repeated documents each get a row;
columns besides id and text are neither read nor changed.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.llm.common import as_bytes, pieces, release_worker, spare_name, written

WINDOW = 10
#: Bytes of text in a shard, and words of benchmark text that are looked up together.
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 500_000
#: Blocks that a task holds at once; more blocks take more passes.
BLOCKS_AT_ONCE = 2

# ASCII letters and digits, and everything beyond ASCII, after lower-casing of A-Z (bytes.lower leaves other bytes).
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
FOUND_ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)
MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_row", T.LongType()),
            T.StructField("item_id", T.StringType()),
            T.StructField("item_word", T.LongType()),
            T.StructField("doc_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
        ]
    )
)
MATCHES_ARROW = pa.list_(
    pa.struct(
        [
            ("item_row", pa.int64()),
            ("item_id", pa.string()),
            ("item_word", pa.int64()),
            ("doc_word", pa.int64()),
            ("n_words", pa.int64()),
        ]
    )
)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class TestSuffixes:
    """The suffixes of a block of items, cut to a window, as search keys.

    ``per_key`` word numbers of ``bits`` bits make a key; a window takes ``lower.shape[1]`` keys. Beyond a window's end
    the lower key has zeros and the upper key ones, so the suffixes between the two are those that begin with it.
    Window ``w`` starts in the benchmark at the places ``first_place[w]`` to ``first_place[w + 1]``, each of them a row
    of ``place_row`` and ``place_word``; everything that grows with the block but its vocabulary is an array.
    """

    __test__ = False

    numbers: dict[bytes, int]
    bits: int
    per_key: int
    lower: np.ndarray
    lengths: np.ndarray
    first_place: np.ndarray
    place_row: np.ndarray
    place_word: np.ndarray
    #: Item id and number of each benchmark row that the block has words of.
    ids: list[str | None]
    rows: np.ndarray

    @property
    def upper(self) -> np.ndarray:
        width = self.lower.shape[1] * self.per_key
        beyond = np.arange(width) >= np.arange(self.lengths.max(initial=0) + 1)[:, None]
        ones = np.where(beyond, (1 << self.bits) - 1, 0).reshape(len(beyond), -1, self.per_key)
        return self.lower | packed(ones, self.bits)[self.lengths]

    @classmethod
    def build(cls, items: list[tuple[str | None, list[bytes]]], window: int) -> TestSuffixes:
        block = Block(window)
        for row, (item, words) in enumerate(items):
            block.add(row, item, 0, words)
        return block.suffixes()


class Block:
    """Collects the words of benchmark rows, or of parts of them, as numbers."""

    def __init__(self, window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        #: Each part is followed by a window of zeros, so that no window reaches into the next part.
        self.words = array("q")
        self.n_words = 0
        self.parts: list[tuple[int, str | None, int, int, int]] = []

    def add(self, row: int, item: str | None, first: int, words: list[bytes]) -> None:
        """``words`` of a row, which begin at its word ``first``."""
        self.parts.append((row, item, first, len(self.words), len(words)))
        numbers = self.numbers
        self.words.extend(numbers.setdefault(w, len(numbers) + 1) for w in words)
        self.words.extend(repeat(0, self.window))
        self.n_words += len(words)

    def suffixes(self) -> TestSuffixes:
        bits = (len(self.numbers) + 1).bit_length()
        per_key = max(1, 62 // bits)
        n_keys = -(-self.window // per_key)
        words = np.array(self.words, np.int64)
        begin = np.array([p[3] for p in self.parts], np.int64)
        size = np.array([p[4] for p in self.parts], np.int64)
        n_windows = np.where(size > 0, np.maximum(size - self.window, 0) + 1, 0)
        at = spread(begin, begin + n_windows)
        part = np.repeat(np.arange(len(begin)), n_windows)
        keys = np.zeros((len(at), n_keys), np.int64)
        for k in range(n_keys * per_key):
            key = keys[:, k // per_key]
            key <<= bits
            if k < self.window:
                key |= words[at + k]
        order = np.lexsort(keys.T[::-1])
        keys = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        at, part = at[order], part[order]
        first = np.array([p[2] for p in self.parts], np.int64)
        return TestSuffixes(
            self.numbers,
            bits,
            per_key,
            keys[new],
            np.minimum(size[part[new]], self.window),
            np.append(np.flatnonzero(new), len(order)),
            part.astype(np.int32),
            at - begin[part] + first[part],
            [p[1] for p in self.parts],
            np.array([p[0] for p in self.parts], np.int64),
        )


def packed(numbers: np.ndarray, bits: int) -> np.ndarray:
    """The word numbers along the last axis as one integer that sorts like them."""
    out = np.zeros(numbers.shape[:-1], np.int64)
    for k in range(numbers.shape[-1]):
        out = (out << bits) | numbers[..., k]
    return out


class Shard:
    """The suffix array of some documents, sorted as deep as the given test suffixes need.

    All suffixes are sorted by their first key. Only those that share it with a test suffix are sorted on to the
    full window: no search looks further into the others.
    """

    def __init__(self, texts: list[bytes], test: TestSuffixes):
        rows = [words_of(t) for t in texts]
        self.counts = np.array([len(r) for r in rows], np.int64)
        # A zero after each document and one key's worth of zeros at the end.
        self.firsts = np.cumsum(self.counts + 1) - (self.counts + 1)
        self.size = int((self.counts + 1).sum())
        self.test = test
        self.n_keys = test.lower.shape[1]
        words = np.zeros(self.size + (self.n_keys + 1) * test.per_key, np.int64)
        for first, row in zip(self.firsts.tolist(), rows, strict=True):
            words[first : first + len(row)] = np.fromiter(map(test.numbers.get, row, repeat(0)), np.int64, len(row))
        keys = words[: len(words) - test.per_key + 1].copy()
        for k in range(1, test.per_key):
            keys <<= test.bits
            keys |= words[k : len(keys) + k]
        self.keys = keys
        at = np.flatnonzero(words[: self.size])
        self.order = at[np.argsort(keys[at], kind="stable")]
        self._refine()

    def _refine(self) -> None:
        if self.n_keys == 1 or not len(self.order):
            return
        first = self.keys[self.order]
        wanted = np.unique(np.concatenate([self.test.lower[:, 0], self.test.upper[:, 0]]))
        low, high = np.searchsorted(first, wanted, "left"), np.searchsorted(first, wanted, "right")
        keep = high - low > 1
        spots = spread(low[keep], high[keep])
        if len(spots):
            at = self.order[spots]
            levels = [self.keys[at + k * self.test.per_key] for k in range(self.n_keys - 1, 0, -1)]
            self.order[spots] = at[np.lexsort([*levels, first[spots]])]

    def search(self, probes: np.ndarray, right: bool) -> np.ndarray:
        """For each probe the first place in the suffix array that is not before it (``right``: that is after it)."""
        low = np.zeros(len(probes), np.int64)
        high = np.full(len(probes), len(self.order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            at = self.order[middle]
            before = np.full(len(open_), right)
            for k in range(self.n_keys - 1, -1, -1):
                key, probe = self.keys[at + k * self.test.per_key], probes[open_, k]
                before = np.where(key == probe, before, key < probe)
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
        return low

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(word position in the shard, window) of every occurrence of every window."""
        low, high = self.search(self.test.lower, False), self.search(self.test.upper, True)
        return self.order[spread(low, high)], np.repeat(np.arange(len(low)), high - low)

    def document_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, at, "right") - 1


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The integers of all ranges [low, high), one range after the other."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def joined_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching ranges as one; both arrays sorted by start."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([new[1:], [True]])]


def found_in(texts: list[bytes], test: TestSuffixes) -> list[dict]:
    """For each text its words, the hit spans (start, end, start, end, ...) and the items that they come from."""
    shard = Shard(texts, test)
    out = [{"n_words": int(n), "spans": [], "items": []} for n in shard.counts]
    at, window = shard.occurrences()
    if not len(at):
        return out
    order = np.argsort(at, kind="stable")
    at, window = at[order], window[order]
    starts, ends = joined_spans(at, at + test.lengths[window])
    docs = shard.document_of(starts)
    base = shard.firsts[docs]
    for doc, start, end in zip(docs.tolist(), (starts - base).tolist(), (ends - base).tolist(), strict=True):
        out[doc]["spans"] += (start, end)
    n = len(test.lengths)
    docs, windows = np.divmod(np.unique(shard.document_of(at) * n + window), n)
    edges = [*np.flatnonzero(np.diff(docs, prepend=-1)).tolist(), len(docs)]
    for start, end in pairwise(edges):
        of = windows[start:end]
        rows = np.unique(test.place_row[spread(test.first_place[of], test.first_place[of + 1])])
        out[int(docs[start])]["items"] = sorted({test.ids[r] for r in rows.tolist()} - {None})
    return out


def matches_in(texts: list[bytes], test: TestSuffixes) -> list[list[dict]]:
    """For each text its verbatim matches with every row of the block, as long as the block shows them."""
    shard = Shard(texts, test)
    out: list[list[dict]] = [[] for _ in texts]
    at, window = shard.occurrences()
    if not len(at):
        return out
    low, high = test.first_place[window], test.first_place[window + 1]
    places = spread(low, high)
    p, length = np.repeat(at, high - low), np.repeat(test.lengths[window], high - low)
    q, part = test.place_word[places], test.place_row[places]
    row = test.rows[part]
    order = np.lexsort((p, p - q, row))
    p, q, row, part, length = p[order], q[order], row[order], part[order], length[order]
    # Windows that follow one another word by word in the text and in the row are one match.
    new = np.ones(len(p), bool)
    new[1:] = (row[1:] != row[:-1]) | (np.diff(p - q) != 0) | (np.diff(p) != 1)
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(p)) - 1
    docs = shard.document_of(p[first])
    for i, j, doc in zip(first.tolist(), last.tolist(), docs.tolist(), strict=True):
        out[doc].append(
            {
                "item_row": int(row[i]),
                "item_id": test.ids[part[i]],
                "item_word": int(q[i]),
                "doc_word": int(p[i] - shard.firsts[doc]),
                "n_words": int(p[j] - p[i] + length[j]),
            }
        )
    return out


def test_blocks(
    benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int
) -> Iterator[TestSuffixes]:
    """The benchmark in blocks of bounded size; one block is in the driver at a time. Overlong items are cut so that
    each window falls into one block."""
    block = Block(window)
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string"))
    for row, (item, said) in enumerate(rows.toLocalIterator()):
        words = words_of((said or "").encode())
        step = max(1, block_words - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + step + window - 1]
            if block.parts and block.n_words + len(part) > block_words:
                yield block.suffixes()
                block = Block(window)
            block.add(row, item, at, part)
    yield block.suffixes()


test_blocks.__test__ = False


def finder(block, to_arrow: pa.DataType, sql_type: str | T.DataType, look, shard_bytes: int):
    """An Arrow UDF that looks up one broadcast block in the texts that it gets."""

    @F.arrow_udf(sql_type)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release_worker()
        test = block.value
        for batch in batches:
            texts = as_bytes(batch)
            out: list = []
            for start, end in pieces(texts, shard_bytes):
                out += look(texts[start:end], test)
            yield pa.array(out, to_arrow)

    return find


@F.arrow_udf(FOUND)
def merge_found(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        flat = sorted(zip((x["spans"] + y["spans"])[::2], (x["spans"] + y["spans"])[1::2], strict=True))
        both = np.array(flat, np.int64).reshape(-1, 2)
        starts, ends = joined_spans(both[:, 0], both[:, 1])
        spans = np.stack([starts, ends], 1).ravel().tolist()
        out.append({"n_words": x["n_words"], "spans": spans, "items": sorted({*x["items"], *y["items"]})})
    return pa.array(out, FOUND_ARROW)


@F.arrow_udf(MATCHES)
def merge_matches(a: pa.Array, b: pa.Array) -> pa.Array:
    """Matches of two blocks; those of one row that overlap in step are one match that goes on beyond a block."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        whole: list[dict] = []
        for m in sorted(x + y, key=lambda m: (m["item_row"], m["doc_word"] - m["item_word"], m["doc_word"])):
            if whole and follows(whole[-1], m):
                end = max(whole[-1]["doc_word"] + whole[-1]["n_words"], m["doc_word"] + m["n_words"])
                whole[-1]["n_words"] = end - whole[-1]["doc_word"]
            else:
                whole.append(m)
        out.append(whole)
    return pa.array(out, MATCHES_ARROW)


def follows(a: dict, b: dict) -> bool:
    """Whether match ``b`` begins inside or right after ``a``, in the same row and in step with it."""
    in_step = a["doc_word"] - a["item_word"] == b["doc_word"] - b["item_word"]
    return a["item_row"] == b["item_row"] and in_step and b["doc_word"] <= a["doc_word"] + a["n_words"]


def looked_up(
    docs: DataFrame,
    benchmark: DataFrame,
    into: str,
    kind: tuple,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with what all blocks together give for each text in a column ``into``; ``kind`` names the look-up."""
    to_arrow, sql_type, look, merge = kind
    context = docs.sparkSession.sparkContext
    other = spare_name(docs, "_more")
    for k, test in enumerate(test_blocks(benchmark, item_id, item_text, window, block_words)):
        if k and k % BLOCKS_AT_ONCE == 0:
            docs = written(docs)
        found = finder(context.broadcast(test), to_arrow, sql_type, look, shard_bytes)(F.col(text).cast("string"))
        if k == 0:
            docs = docs.withColumn(into, found)
        else:
            docs = docs.withColumn(other, found).withColumn(into, merge(into, other)).drop(other)
    return docs


def with_found(docs: DataFrame, benchmark: DataFrame, into: str, **how) -> DataFrame:
    """``docs`` with a column ``into``: n_words, hit spans of words and the ids of the items found in each text.

    ``how`` names the columns (``text``, ``item_id``, ``item_text``), the ``window`` in words and the bounds of memory
    (``shard_bytes``, ``block_words``).
    """
    return looked_up(docs, benchmark, into, (FOUND_ARROW, FOUND, found_in, merge_found), **how)


def hit_words(found: str):
    """The number of words inside the spans of a ``with_found`` column."""
    spans = F.col(f"{found}.spans")
    return F.aggregate(
        F.sequence(F.lit(0), F.size(spans) - 1),
        F.lit(0).cast("bigint"),
        lambda n, k: n + F.when(k % 2 == 1, F.get(spans, k)).otherwise(-F.get(spans, k)),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One row per document: words, hit words, the items found and whether it is contaminated."""
    found = spare_name(docs, "_found")
    items = F.col(f"{found}.items")
    n_hit = F.when(F.size(f"{found}.spans") > 0, hit_words(found)).otherwise(F.lit(0).cast("bigint"))
    return with_found(docs, benchmark, found, **how).select(
        F.col(doc_id).alias("doc_id"),
        F.col(f"{found}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"),
        (F.size(f"{found}.spans") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows in which a window of a benchmark item occurs; columns as they were."""
    found = spare_name(docs, "_found")
    return with_found(docs, benchmark, found, **how).filter(F.size(f"{found}.spans") == 0).drop(found)


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One row per maximal verbatim match of at least a window (or of a whole shorter item): document, item, first word
    in the item and in the document, length in words. ``how`` as for ``with_found``."""
    found = spare_name(docs, "_found")
    matches = looked_up(docs, benchmark, found, (MATCHES_ARROW, MATCHES, matches_in, merge_matches), **how)
    return matches.select(F.col(doc_id).alias("doc_id"), F.inline(found)).drop("item_row")
