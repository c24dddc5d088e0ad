"""What the text operators share: tables, scratch storage, batches of texts, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table known to have no more rows than this is dealt to files of ``ROWS_A_FILE`` rows before it is written.
FEW_ROWS, ROWS_A_FILE = 200_000, 10_000


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read from there.

    The folder is the one that ``spark.checkpoint.dir`` names. A session that names none must set one with
    ``SparkContext.setCheckpointDir``; there is no silent choice of a local folder. ``rows``, a bound of the number of
    rows where it is known, keeps a small table out of as many files as the last shuffle had partitions. (It is dealt
    out anew: with ``coalesce`` one task would hold the sort buffers of all partitions that it takes over.)
    """
    if rows is not None and rows <= FEW_ROWS:
        df = df.repartition(max(1, -(-rows // ROWS_A_FILE)))
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Have the session cut Arrow batches by bytes: by rows alone, 10,000 long texts are held at once by the JVM and the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_HELD: dict = {}


def held_by_worker(key, build: Callable):
    """What ``build`` makes, kept by this Python worker from task to task until it is asked for anything else. Spark uses
    a worker for one stage after another, so a stage that needs nothing of the kind calls ``release_worker``."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def release_worker() -> None:
    """Free what an earlier stage left in this Python worker."""
    _HELD.clear()


def spare_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def pieces(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``most`` bytes or characters together, or of one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Bytes of text that a Python worker turns into objects at once. Results may come in smaller batches than the input.
AT_ONCE = 2 << 20


def parts(texts: pa.Array, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow batch of at most ``most`` bytes of text together, or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    return pieces([range(n) for n in sizes], most)


class Remembered(dict):
    """Values of a function, each computed once while it is remembered.

    There are two generations of at most ``most`` values. When the younger one is full it becomes the older one, from which
    values that are still in use come back; what was not used for a whole generation is forgotten.
    """

    def __init__(self, compute: Callable, most: int):
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


class WordHashes(Remembered):
    """64-bit hash of a word."""

    MOST = 60_000

    def __init__(self):
        super().__init__(xxhash.xxh3_64_intdigest, self.MOST)

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of some texts, and how many words each has. Words are those of ``bytes.lower`` and
    ``bytes.split``, without an object for each; a word that comes again is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    owners = np.repeat(np.arange(len(texts)), counts)
    encoded = words.dictionary_encode()
    # No word has a space, so they travel as one string.
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(encoded.dictionary)], encoded.dictionary), pa.scalar(" ", words.type))
    distinct = joined[0].as_buffer().to_pybytes().split(b" ") if len(encoded.dictionary) else []
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[encoded.indices.to_numpy()[real]], np.bincount(owners[real], minlength=len(texts))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words; one for all of them if there are fewer, none without words."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = mixed(out + np.uint64(k + 1)) + word_hashes[k : n - size + 1 + k]
    return mixed(out)
