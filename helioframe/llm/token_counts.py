"""Token counts by finite-state transducers.

Two machines are compiled from a tokenizer file (BPE whose words end in a mark, lower case, white space dropped):

1. The splitter, five states over classes of characters, whose transitions say whether a word begins. A text is cut
   into chunks; the state map of a chunk (for each state before it the state after it) is computed for all chunks side by
   side, the maps are composed by a parallel prefix scan, and from the state so known at each chunk's start all chunks
   are run at once.
2. The merger, a transducer over the bytes of a word whose transitions carry the change in the number of tokens. Its
   state is what the future can still depend on: the longest suffix of the word so far that begins a token, the last
   token of each prefix that ends in that suffix, and their counts. States and transitions are compiled when they are
   first met, and forgotten together at a bound, as text has no end of new words. The word's end is a last transition,
   to the tokens with the end mark.

The sum over a word's transitions is its number of tokens; words met before are remembered, up to a bound.

Defined cases: a null or empty text has 0 bytes and tokens; strings of special tokens inside a text are one token each,
as is the library's default; texts are read whole, whatever their length; repeated rows each get a row.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import pieces

LIMIT = 2048
CHUNK = 64
PIECE_CHARS = 2 << 20
REMEMBERED = 500_000
#: States and answers of the merger held at once, about 100 MB of a worker; beyond, it is compiled anew.
COMPILED = 400_000
COUNTS = "struct<n_bytes:bigint,n_tokens:bigint>"
COUNTS_ARROW = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

# Classes of characters. QUOTE2 and QUOTE3 are an apostrophe before one or two letters that make a short form.
SPACE, LETTER, NUMBER, OTHER, QUOTE2, QUOTE3 = range(6)
# States of the splitter.
BETWEEN, IN_LETTERS, IN_OTHERS, ONE_MORE, TWO_MORE = range(5)
SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a word begins) by state and class."""
    after = np.zeros((5, 6), np.uint8)
    begins = np.zeros((5, 6), bool)
    for state in (BETWEEN, IN_LETTERS, IN_OTHERS):
        after[state] = (BETWEEN, IN_LETTERS, BETWEEN, IN_OTHERS, ONE_MORE, TWO_MORE)
        begins[state] = (False, state != IN_LETTERS, True, state != IN_OTHERS, True, True)
    # A run of other characters takes in apostrophes, whatever follows.
    after[IN_OTHERS, [QUOTE2, QUOTE3]] = IN_OTHERS
    begins[IN_OTHERS, [QUOTE2, QUOTE3]] = False
    after[ONE_MORE], after[TWO_MORE] = BETWEEN, ONE_MORE
    return after, begins


def character_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            out[point] = kind
    # White space by its Unicode property.
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def classes_of(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of each character; short forms are seen by looking ahead."""
    out = table[points]
    one, two = np.append(points[1:], 0), np.append(points[2:], [0, 0])[: len(points)]
    quotes = points == ord("'")
    if quotes.any():
        for form in SHORT_FORMS:
            hit = quotes & (one == ord(form[0]))
            if len(form) == 2:
                hit &= two == ord(form[1])
            out[hit] = QUOTE2 if len(form) == 1 else QUOTE3
    return out


def word_starts(classes: np.ndarray, after: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character, by chunk maps and a prefix scan over them."""
    n = len(classes)
    grid = np.full(-(-n // CHUNK) * CHUNK, SPACE, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
    maps = np.tile(np.arange(len(after), dtype=np.uint8), (grid.shape[1], 1))
    for column in grid:
        maps = after[maps, column[:, None]]
    span = 1
    while span < len(maps):
        maps = np.concatenate([maps[:span], np.take_along_axis(maps[span:], maps[:-span].astype(np.intp), axis=1)])
        span *= 2
    state = np.concatenate([[BETWEEN], maps[:-1, BETWEEN]]).astype(np.uint8)
    out = np.empty(grid.shape, bool)
    for k, column in enumerate(grid):
        out[k] = begins[state, column]
        state = after[state, column]
    return out.T.ravel()[:n]


def byte_characters() -> list[str]:
    """The characters that stand for the 256 bytes in vocabularies of this kind: printable ones for themselves, the
    others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """The transducer from the bytes of a word to its number of tokens."""

    def __init__(self, merges: list[tuple[str, str]], end: str):
        self.end = end
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.born = {a + b: (i, a, b) for i, (a, b) in enumerate(merges)}
        singles = byte_characters()
        self.tokens = {*singles, *(c + end for c in singles), *self.born}
        # Everything that begins a token, as bytes stand in it.
        self.begins = {t[:k] for t in self.tokens for k in range(len(t.removesuffix(end)) + 1)}
        self.forget()

    def forget(self) -> None:
        """Drop what was compiled; the machine is compiled anew from the words that follow."""
        self._stands: dict[tuple[str, str], bool] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.start = self.number(("", ("",), (0,)))

    def number(self, state: tuple) -> int:
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return known

    def stand(self, a: str, b: str) -> bool:
        """Whether merging the bytes of ``a b`` gives ``a b``: undoing merges from the latest on, the two that touch
        are never a pair that would have been joined before the next merge beside them."""
        known = self._stands.get((a, b))
        if known is not None:
            return known
        left, right, until, out = a, b, 2 * len(self.ranks), True
        while True:
            rank = self.ranks.get((left, right))
            if rank is not None and 2 * rank < until:
                out = False
                break
            l_born, r_born = self.born.get(left), self.born.get(right)
            l_time = 2 * l_born[0] if l_born else -1
            r_time = 2 * r_born[0] + 1 if r_born else -1
            if l_time < 0 and r_time < 0:
                break
            if l_time > r_time:
                until, left = l_time, l_born[2]
            else:
                until, right = r_time, r_born[1]
        self._stands[a, b] = out
        return out

    def last(self, said: str, lasts: tuple, mark: str) -> tuple[str, int]:
        """The unique last token of a prefix that ends in ``said``, and how many places before its end it begins.
        ``lasts`` are the last tokens of the prefixes up to each place in ``said``, but the end."""
        for at in range(len(said)):
            token = said[at:] + mark
            if token in self.tokens and (lasts[at] == "" or self.stand(lasts[at], token)):
                return token, at
        raise ValueError(f"no token ends {said!r}")

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition of a state on a byte: (next state, change in the number of tokens)."""
        said, lasts, counts = self.states[state]
        said += char
        token, at = self.last(said, lasts, "")
        change = counts[at] + 1
        lasts, counts = (*lasts, token), (*(c - change for c in counts), 0)
        cut = 0
        while said[cut:] not in self.begins:
            cut += 1
        step = self.steps[state][char] = (self.number((said[cut:], lasts[cut:], counts[cut:])), change)
        return step

    def finish(self, before: int, char: str) -> int:
        """The change in the number of tokens on the last byte of a word, from the state before it."""
        said, lasts, counts = self.states[before]
        _, at = self.last(said + char, lasts, self.end)
        return counts[at] + 1

    def count(self, word: str) -> int:
        """The number of tokens of a word, one character for a byte."""
        if len(self.numbers) + len(self._stands) > COMPILED:
            self.forget()
        state, total = self.start, 0
        for char in word[:-1]:
            state, change = self.steps[state].get(char) or self.compile(state, char)
            total += change
        key = ("end", state, word[-1])
        change = self.numbers.get(key)
        if change is None:
            change = self.numbers[key] = self.finish(state, word[-1])
        return total + change


class Counter:
    """Counts the tokens of texts with both machines."""

    def __init__(self, spec: dict):
        self.special = [re.escape(s) for s in spec["special"]]
        self.cut = re.compile("|".join(self.special)) if self.special else None
        self.after, self.begins = splitter()
        self.table = spec["classes"]
        self.merger = Merger([tuple(m) for m in spec["merges"]], spec["end"])
        self.bytes = dict(enumerate(byte_characters()))
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        n = self.known[word] = self.merger.count(word.encode().decode("latin-1").translate(self.bytes))
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            split = self.cut.split(text) if self.cut else [text]
            out[i] += len(split) - 1
            for part in split:
                if part:
                    # Lower case letter by letter: the final sigma has no form of its own here.
                    parts.append(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
                    owner.append(i)
        if not parts:
            return out
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = classes_of(points, self.table)
        starts = word_starts(classes, self.after, self.begins)
        edges = np.flatnonzero(starts | (classes == SPACE))
        first = starts[edges]
        begin, end = edges[:-1][first[:-1]], edges[1:][first[:-1]]
        known, more = self.known, self.word
        words = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        found = np.array([known.get(w) or more(w) for w in words], np.int64)
        ends = np.cumsum([len(p) + 1 for p in parts])
        part_of = np.searchsorted(ends, begin, "right")
        np.add.at(out, np.array(owner)[part_of], found)
        return out


def read_spec(path: str) -> dict:
    """What the machines are compiled from; raises if the file describes another kind of tokenizer."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model = made["model"]
    steps = [n["type"] for n in made["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"]:
        raise ValueError("expected BPE with an end-of-word suffix over lower-cased text")
    return {
        "merges": [tuple(m) for m in model["merges"]],
        "end": model["end_of_word_suffix"],
        "special": [t["content"] for t in made["added_tokens"]],
        "classes": character_classes(),
    }


def counter(shared):
    @F.arrow_udf(COUNTS)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = Counter(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            n: list[int] = []
            for start, end in pieces(texts, PIECE_CHARS):
                n += machine.counts(texts[start:end]).tolist()
            yield pa.array([{"n_bytes": len(t.encode()), "n_tokens": k} for t, k in zip(texts, n, strict=True)], COUNTS_ARROW)

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: bytes, tokens and whether they exceed the limit."""
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), counter(shared)(F.col(text).cast("string")).alias("c"))
    return rows.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))
