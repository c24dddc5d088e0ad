"""Fill-in-the-middle transformation, with cuts located by a wavelet matrix.

A text is a row of units: a run of ASCII letters is one unit, any other character is one. A prefix, a middle and a
suffix of whole units are put in another order around markers, so that a model learns to write the middle last.

Every byte of a batch of texts belongs to one of four classes: a letter that goes on a run, a later byte of a character,
a letter that begins a run, any other first byte of a character. A wavelet matrix over the classes answers in constant
time how many bytes of a class stand before a place (its rank). The units that begin before a place are the ranks of two
classes together, the characters before it are all bytes but those of one class. The number of units of a text is a
difference of such counts, and a cut after k units is the place, found by bisection, at which the count reaches k; all
cuts of a batch are searched at once.

Defined cases: a null or empty text stays as it is (``plain``, an empty output); so does a text that holds a marker, which
makes every output readable again; texts of any length are cut whole; a null id draws like the empty id; repeated rows
are cut alike; columns that clash with the results are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.llm.common import parts, spare_name

MARKERS = ("<P>", "<S>", "<M>")
#: Bytes of text that one wavelet matrix covers; a longer text has one of its own.
BLOCK = 4 << 20
GOES_ON, LATER_BYTE, RUN, OTHER = range(4)
CUT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)
CUT_ARROW = pa.struct(
    [("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


class BitRank:
    """A row of bits that counts its ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        room = np.zeros(len(bits) // 64 * 8 + 8, np.uint8)
        room[: len(packed)] = packed
        self.words = room.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank of any symbol of ``bits`` bits: one plane per bit, each sorted by the bits above."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.planes = len(symbols), []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit & 1).astype(bool)
            self.planes.append((bit, BitRank(ones), len(symbols) - int(np.count_nonzero(ones))))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each place."""
        low, high = np.zeros_like(at), at
        for bit, plane, zeros in self.planes:
            low_ones, high_ones = plane.rank(low), plane.rank(high)
            if symbol >> bit & 1:
                low, high = zeros + low_ones, zeros + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return high - low


def byte_classes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Class of each UTF-8 byte; no run of letters crosses a place in ``begins``."""
    low = data | 0x20
    letter = (low >= 0x61) & (low <= 0x7A) & (data < 0x80)
    after = np.zeros(len(data), bool)
    after[1:] = letter[:-1]
    after[begins[begins < len(data)]] = False
    later = (data & 0xC0) == 0x80
    return np.where(letter, np.where(after, GOES_ON, RUN), np.where(later, LATER_BYTE, OTHER)).astype(np.uint8)


class Units:
    """Units and characters of the texts that stand one after the other in ``data``, by rank queries."""

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        self.matrix = WaveletMatrix(byte_classes(data, begins), 2)

    def begun(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before each place."""
        return self.matrix.rank(RUN, at) + self.matrix.rank(OTHER, at)

    def characters(self, at: np.ndarray) -> np.ndarray:
        return at - self.matrix.rank(LATER_BYTE, at)

    def after(self, units: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place from ``low`` to ``high`` behind so many units: the last one before which no more units begin."""
        goal = self.begun(low) + units
        low, high = low.copy(), high.copy()
        while np.any(low < high):
            middle = (low + high + 1) >> 1
            enough = self.begun(middle) <= goal
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        return low


def _cut_block(data: np.ndarray, ends: np.ndarray, draws: list[np.ndarray], plain, suffix_first) -> pa.Array:
    starts = ends[:-1]
    units = Units(data, starts)
    n = units.begun(ends[1:]) - units.begun(starts)
    first, second = (draw % (n + 1) for draw in draws)
    one = units.after(np.minimum(first, second), starts, ends[1:])
    two = units.after(np.maximum(first, second), starts, ends[1:])
    chars = [units.characters(at) for at in (starts, one, two)]
    whole, out = data.tobytes(), []
    p, s, m = (marker.encode() for marker in MARKERS)
    for k, (a, b, c, d) in enumerate(zip(starts.tolist(), one.tolist(), two.tolist(), ends[1:].tolist(), strict=True)):
        if plain[k]:
            out.append(whole[a:d])
        elif suffix_first[k]:
            out.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
        else:
            out.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
    none = np.asarray(plain, bool)
    return pa.StructArray.from_arrays(
        [
            pa.array(n, pa.int64()),
            pa.array(chars[1] - chars[0], pa.int64(), mask=none),
            pa.array(chars[2] - chars[1], pa.int64(), mask=none),
            pa.array(out, pa.binary()).cast(pa.string()),
        ],
        fields=list(CUT_ARROW),
    )


@F.arrow_udf(CUT)
def _cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for texts, first, second, plain, suffix_first in batches:
        raw = texts.cast(pa.binary())
        draws = [d.to_numpy(zero_copy_only=False).astype(np.int64) for d in (first, second)]
        flags = [f.to_numpy(zero_copy_only=False) for f in (plain, suffix_first)]
        for a, b in parts(raw, BLOCK):
            block = raw[a:b].to_pylist()
            ends = np.cumsum([0, *map(len, block)], dtype=np.int64)
            data = np.frombuffer(b"".join(block), np.uint8)
            yield _cut_block(data, ends, [d[a:b] for d in draws], *(f[a:b] for f in flags))


def draws(doc_id: str, seed: str = "1") -> list[Column]:
    """Four numbers below 2**32, from the digest of the seed and the decimal id."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def infilled(
    docs: DataFrame,
    into: str = "fim",
    doc_id: str = "doc_id",
    text: str = "text",
    share: int = 90,
    suffix_first: int = 20,
    seed: str = "1",
) -> DataFrame:
    """``docs`` with a struct ``into``: units ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output``.

    Of a hundred texts ``share`` are cut; of a hundred of these ``suffix_first`` are written with the suffix before the
    prefix (``spm``), the others prefix, suffix, middle (``psm``).
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    one, two, chance, order = draws(doc_id, seed)
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | whole.contains(marker)
    plain = (whole == "") | marked | (chance % 100 >= share)
    spm = order % 100 < suffix_first
    c = spare_name(docs, "_cut")
    form = F.when(plain, "plain").when(spm, "spm").otherwise("psm")
    cut = docs.withColumn(c, _cut(whole, one, two, plain, spm))
    fields = [F.col(f"{c}.{f}").alias(f) for f in ("prefix_chars", "middle_chars", "output")]
    return cut.withColumn(into, F.struct(F.col(f"{c}.n").alias("n"), form.alias("form"), *fields)).drop(c)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Markers do not occur in a cut text, so the first of each is the one set."""
    p, s, m = MARKERS

    def upto(rest: Column, marker: str) -> Column:
        return F.substring_index(rest, marker, 1)

    def behind(rest: Column, marker: str) -> Column:
        return F.substr(rest, F.length(upto(rest, marker)) + len(marker) + 1)

    body = F.substr(output, F.lit(len(p) + 1))
    psm = F.concat(upto(body, s), behind(behind(body, s), m), upto(behind(body, s), m))
    spm = F.concat(upto(behind(body, p), m), behind(behind(body, p), m), upto(body, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: the cut, and digests of the output and of the text read back from it."""
    rows = infilled(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "fim", "doc_id", "text", **how)
    back = restored(F.col("fim.output"), F.col("fim.form"))
    return rows.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2(F.col("fim.output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
