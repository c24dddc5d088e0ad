"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is exactly one last token: the token after which the encoding of the rest of
the prefix still stands. Whether it stands depends on two neighbours only: tokens ``a b`` stand side by side if merging
their bytes gives ``a b`` again. So one pass over the bytes stores the last token of every prefix, the encoding is read
backwards, an append goes on where the table ends, and an edit only recomputes what follows it. New pieces of some
megabytes of text are taken in order, so that one goes on where the table agrees with the piece before.

Defined cases: a null or empty text has no tokens; every byte must be a token of the vocabulary (a clear error if not);
texts of any length are encoded whole, match by match; repeated rows each get a row; other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.llm.common import Remembered, held_by_worker, parts

ENCODED = "struct<ids:array<int>,decoded:binary>"
ENCODED_ARROW = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"
DIGEST_ARROW = pa.struct(
    [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)
#: Pieces whose tokens a worker remembers, pairs of tokens, and steps from state to state, in each of two generations.
REMEMBERED, REMEMBERED_PAIRS, REMEMBERED_STEPS = 150_000, 150_000, 150_000
#: Bytes of a piece beyond which its prefix table is not kept for the next one.
LONG_PIECE = 10_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file (base64 of the bytes, rank), on whatever file system Spark reads. Its size is
    that of a vocabulary, not of the data."""
    rows = spark.read.text(path).collect() if "://" in path else open(path).read().splitlines()
    lines = (r if isinstance(r, str) else r[0] for r in rows)
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The plain way: join the neighbours of lowest rank until none can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        options = [(ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        best = min((o for o in options if o[0] is not None), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@dataclass
class Vocabulary:
    """Ranks, and for a token the two tokens that its last merge joins. A token goes by its rank."""

    ranks: dict[bytes, int]

    def __post_init__(self):
        ranks = self.ranks
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 single bytes")
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.count = max(self.tokens) + 1
        # What was read is known by its longest end that begins a token; the state is the number of that beginning.
        beginnings = {token[:k] for token in ranks for k in range(1, len(token) + 1)}
        self.beginnings = [b"", *beginnings]
        self.numbers = {beginning: state for state, beginning in enumerate(self.beginnings)}
        self.step = Remembered(self._step, REMEMBERED_STEPS)
        # The longest token that ends what was read, by state, and the next shorter one that does, by token.
        self.ending = [-1, *map(self._ending, self.beginnings[1:])]
        self.shorter = {rank: self._ending(token[1:]) for token, rank in ranks.items() if len(token) > 1}
        self.sizes = [len(self.tokens.get(rank, b"")) for rank in range(self.count)]
        self._halves: dict[int, tuple[int, int] | None] = {}
        # Tokens by pairs: left * count + right, where the left one is -1 at the begin of a piece.
        self.stand = Remembered(self._stand, REMEMBERED_PAIRS)

    def _step(self, state_and_byte: int) -> int:
        state, byte = divmod(state_and_byte, 256)
        read = self.beginnings[state] + bytes([byte])
        while read not in self.numbers:
            read = read[1:]
        return self.numbers[read]

    def _ending(self, read: bytes) -> int:
        while read not in self.ranks:
            read = read[1:]
        return self.ranks[read]

    def halves(self, rank: int) -> tuple[int, int] | None:
        """What the last merge of a token joins; None for a single byte, () for a token that its own bytes do not
        encode to, which never appears in an encoding."""
        if rank not in self._halves:
            pair = None
            if self.sizes[rank] > 1:
                parts = merge_bytes(self.tokens[rank], _Below(self.ranks, rank))
                pair = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else ()
            self._halves[rank] = pair
        return self._halves[rank]

    def _stand(self, pair: int) -> bool:
        """Whether the two tokens are the encoding of their own bytes.

        Going back in time, the later of the two merges is undone until both sides are single bytes. If the two tokens
        that touch could have been joined before the next merge on either side took place, they would have been.
        """
        ranks, tokens, sizes, halves = self.ranks, self.tokens, self.sizes, self.halves
        left, right = divmod(pair, self.count)
        if halves(right) == ():
            return False
        if left < 0:
            return True
        # Position in time before which the two touching tokens exist side by side.
        until = self.count * 2
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and 2 * joined < until:
                return False
            born_left = 2 * left if sizes[left] > 1 else -1
            born_right = 2 * right + 1 if sizes[right] > 1 else -1
            if born_left < 0 and born_right < 0:
                return True
            if born_left > born_right:
                until, left = born_left, halves(left)[1]
            else:
                until, right = born_right, halves(right)[0]


class _Below(dict):
    """The ranks below a bound."""

    def __init__(self, ranks: dict[bytes, int], bound: int):
        self.ranks, self.bound = ranks, bound

    def get(self, token, default=None):
        rank = self.ranks.get(token, default)
        return rank if rank is not None and rank < self.bound else default


class PrefixTable:
    """A piece of text with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = [-1]
        self.states: list[int] = [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the piece; what is stored stays as it is."""
        v, last, states = self.vocabulary, self.last, self.states
        step, ending, sizes, stand, shorter, count = v.step, v.ending, v.sizes, v.stand, v.shorter, v.count
        state, end = states[-1], len(self.data)
        add, add_state = last.append, states.append
        # Of the tokens that end a prefix, one stands.
        for byte in more:
            end += 1
            state = step[state << 8 | byte]
            token = ending[state]
            while not stand[last[end - sizes[token]] * count + token]:
                token = shorter[token]
            add(token)
            add_state(state)
        self.data += more

    def cut(self, end: int) -> None:
        """Keep the first ``end`` bytes."""
        del self.data[end:], self.last[end + 1 :], self.states[end + 1 :]

    def become(self, data: bytes) -> None:
        """Hold another piece; what both begin with is not computed again."""
        old, alike = self.data, 0
        for byte in data[: len(old)]:
            if byte != old[alike]:
                break
            alike += 1
        del old[alike:], self.last[alike + 1 :], self.states[alike + 1 :]
        self.append(data[alike:])

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes [start, end). Returns the number of prefixes that were computed anew: past the change they
        are computed until they agree with the stored ones for as many bytes as the longest token has."""
        old_last, old_states, shift = self.last[:], self.states[:], len(new) - (end - start)
        rest = bytes(self.data[end:])
        self.cut(start)
        self.append(new)
        alike, used = 0, 0
        longest, sizes = self.vocabulary.longest, self.vocabulary.sizes
        while used < len(rest) and alike < longest:
            self.append(rest[used : used + 1])
            used += 1
            at = len(self.data)
            # A stored last token can be kept only if it lies behind the change.
            same = self.last[at] == old_last[at - shift] and sizes[self.last[at]] <= used
            alike = alike + 1 if same else 0
        kept = rest[used:]
        if kept:
            first = len(self.data) + 1 - shift
            self.data += kept
            self.last += old_last[first:]
            self.states += old_states[first:]  # a state depends on no more bytes than the longest token has
        return len(new) + used

    def ids(self) -> list[int]:
        out, last, sizes = [], self.last, self.vocabulary.sizes
        end = len(self.data)
        while end:
            token = last[end]
            out.append(token)
            end -= sizes[token]
        return out[::-1]

    def tokens(self) -> list[bytes]:
        return [self.vocabulary.tokens[k] for k in self.ids()]


class Encoder:
    """Encodes texts match by match and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.table = PrefixTable(self.vocabulary)
        self.known = Remembered(self._piece, REMEMBERED)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data, ranks = piece.encode(), self.vocabulary.ranks
        if data in ranks:  # a match that is a token is that token, however its bytes would merge
            return (ranks[data],)
        if len(data) > LONG_PIECE:
            return tuple(PrefixTable(self.vocabulary, data).ids())
        self.table.become(data)
        return tuple(self.table.ids())

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text. Pieces not known yet are taken in order, so that those which begin alike share what the
        prefix table holds of their beginning."""
        get, known = self.known.get, self.known
        split, found = [], []
        for text in texts:
            pieces = self.split(text)
            ids = list(map(get, pieces))
            found.append(ids)
            split.append(pieces if None in ids else ())
        new = {piece for pieces, ids in zip(split, found, strict=True) for piece, k in zip(pieces, ids, strict=False) if k is None}
        added = {piece: known[piece] for piece in sorted(new)}
        for pieces, ids in zip(split, found, strict=True):
            if pieces:
                ids = [added[piece] if k is None else k for piece, k in zip(pieces, ids, strict=True)]
            yield list(chain.from_iterable(ids))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def _coder(spark: SparkSession, ranks_path: str, pattern: str, digest: bool):
    ranks = read_ranks(spark, ranks_path)
    version = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf(DIGEST if digest else ENCODED)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = held_by_worker(("bpe", version, pattern), lambda: Encoder(shared.value, pattern))
        names = [str(k) for k in range(max(encoder.vocabulary.tokens) + 1)]
        kind = DIGEST_ARROW if digest else ENCODED_ARROW
        for batch in batches:
            for a, b in parts(batch):
                texts = [text or "" for text in batch[a:b].to_pylist()]
                yield pa.array([coded(encoder, ids, names) for ids in encoder.encode_all(texts)], kind)

    def coded(encoder: Encoder, ids: list[int], names: list[str]) -> dict:
        data = encoder.decode(ids)
        if not digest:
            return {"ids": ids, "decoded": data}
        return {
            "n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(data).hexdigest(),
        }

    return code


def encoded(docs: DataFrame, ranks_path: str, pattern: str, into: str = "bpe", text: str = "text") -> DataFrame:
    """``docs`` with a column ``into``: the token ids of each whole text and the bytes that they decode to."""
    return docs.withColumn(into, _coder(docs.sparkSession, ranks_path, pattern, False)(F.col(text).cast("string")))


def digests(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: token count, digest of the ids and digest of the decoded bytes."""
    code = _coder(docs.sparkSession, ranks_path, pattern, True)
    return docs.select(F.col(doc_id).alias("doc_id"), code(F.col(text).cast("string")).alias("d")).select(
        "doc_id", "d.*"
    )
