"""Statistics of whole texts, by one pass over their bytes in Arrow batches.

Words are runs of anything but space and the five ASCII control blanks. A null or empty text has zeros throughout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.llm.common import as_bytes, parts, release_worker

BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
NAMES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct",
    "n_upper",
    "n_digits",
    "n_marks",
    "n_stops",
)
SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])
ARROW = pa.struct([(n, pa.int64()) for n in NAMES])

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?\"'(){}[]=_~^/\\@"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside a window of ``size`` words that occurs at least twice."""
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    n, reach = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            n += at + size - max(at, reach)
            reach = at + size
    return n


def stats_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    counts = Counter(words)
    # Short frequent words: those of at most three bytes that come back.
    stops = sum(n for w, n in counts.items() if n > 1 and len(w) <= 3)
    points = len(text.decode("utf-8", "surrogatepass")) if not text.isascii() else len(text)
    return (
        len(words),
        points - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(counts),
        len(text) - len(text.translate(None, _UPPER)),
        len(text) - len(text.translate(None, _DIGITS)),
        len(text) - len(text.translate(None, _MARKS)),
        stops,
    )


@F.arrow_udf(SCHEMA)
def text_stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    release_worker()
    for batch in batches:
        for a, b in parts(batch):
            columns = zip(*(stats_of(t) for t in as_bytes(batch[a:b])), strict=True)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(ARROW))


def ratio(a, b, scale: float = 1.0):
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, scale * a / b).otherwise(F.lit(0.0))


def derived(s: str) -> dict:
    """Size-free statistics from a ``text_stats`` column named ``s``."""
    c = lambda n: F.col(f"{s}.{n}")
    return {
        "symbols_per_100": ratio(c("n_symbols"), c("n_words"), 100.0),
        "upper_share": ratio(c("n_upper"), c("word_chars")),
        "dup_line_share": ratio(c("n_dup_lines"), c("n_lines")),
        "repeat_share": ratio(c("n_repeat_words"), c("n_words")),
        "distinct_share": ratio(c("n_distinct"), c("n_words")),
        "word_length": ratio(c("word_chars"), c("n_words")),
        "digit_share": ratio(c("n_digits"), c("word_chars")),
        "mark_share": ratio(c("n_marks"), c("word_chars")),
        "stop_share": ratio(c("n_stops"), c("n_words")),
        "words_per_line": ratio(c("n_words"), c("n_lines")),
        "log_words": F.log1p(c("n_words").cast("double")),
    }
