"""Conversations rebuilt from event logs and rendered for training.

A log has rows (conv_id, seq, kind, message, role, text). Its events in the order of seq mean:

``message``     begins a message with a role and a first text (again: begins it anew)
``delta``       appends streamed text to a message
``edit``        replaces the text of a message
``regenerate``  drops a message and all later ones; what follows rebuilds them

The messages are rendered as ``### role: text</turn>\n``. Inside roles and texts a backslash goes before every backslash
and ``#``, and into every ``</``, so that neither mark can appear in them; taking the backslashes out restores them. The
loss mask of a turn is the span of an assistant's text in the rendered turn.

A conversation may hold a large part of all rows, so it is dealt out in blocks of ``RANGE`` message numbers. A message
depends on other messages only by the last regeneration of a smaller number, so in the order of message and seq a task
folds it with the last such event so far and the parts of one message in memory. What blocks need from those before, the
last regeneration and the number of turns, are prefixes over one row per block, which travel as the block's first row.
Only the digest of a conversation, a hash over its turns in order, is a stream in one task, whose sort spills to disk.

Defined cases: a null text or role is empty; events of one seq are taken in the order of kind, message, role and text; an
event for a message that never began begins it without a role; a null conv_id is a conversation of its own; a log
without rows gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Message numbers, or turns, that one task takes together.
RANGE = 256
#: Code points in a streamed delta of a log that is made from finished turns.
DELTA = 512

OPEN, CLOSE = "### ", "</turn>\n"
TURNS = "conv_id bigint, turn bigint, role string, formatted string, loss_start bigint, loss_end bigint"
TURNS_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn", pa.int64()),
        ("role", pa.string()),
        ("formatted", pa.string()),
        ("loss_start", pa.int64()),
        ("loss_end", pa.int64()),
    ]
)
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
DIGESTS_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)

COUNTS = "conv_id bigint, block bigint, n bigint"
COUNTS_ARROW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("n", pa.int64())])

# A rendered turn: role and text are anything but unescaped marks; ": " ends the role, in which colons are escaped.
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.DOTALL)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span of its loss mask; an empty span if it has no loss."""
    head = f"{OPEN}{escaped(role).replace(':', chr(92) + ':')}: "
    body = escaped(text)
    turn = head + body + CLOSE
    return (turn, len(head), len(head) + len(body)) if role == "assistant" else (turn, 0, 0)


def read_back(turn: str) -> tuple[str, str]:
    role, text = TURN.fullmatch(turn).groups()
    return unescaped(role), unescaped(text)


def fold(events) -> list[tuple[str, str]]:
    """The final (role, text) of the messages, in order of message number, from (kind, message, role, text) in order."""
    messages: dict[int, tuple[str, list[str]]] = {}
    for kind, message, role, text in events:
        if kind == "message":
            messages[message] = (role, [text])
        elif kind == "regenerate":
            for later in [m for m in messages if m >= message]:
                messages[later] = (messages[later][0], []) if later == message else None
                if messages[later] is None:
                    del messages[later]
        else:
            role, parts = messages.setdefault(message, (role, []))
            if kind == "edit":
                parts.clear()
            parts.append(text)
    return [(messages[m][0], "".join(messages[m][1])) for m in sorted(messages)]


def rows_of(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def in_batches(rows, schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def later(a: tuple, b: tuple) -> bool:
    """Whether place (seq, kind, message) a is after b; null comes first, as in Spark's order."""
    return [(x is not None, x) for x in a] > [(x is not None, x) for x in b]


def surviving(events) -> Iterator[tuple[int, str, str]]:
    """(first turn, role, text) of the final messages of a block. The first event has what the blocks before have left."""
    head = next(events)
    cut = head[-1] and tuple(head[-1].values())
    for message, own in groupby(events, key=itemgetter(3)):
        role, parts, begun, next_cut = "", [], False, cut
        for _, _, _, _, seq, kind, said, text, _, _ in own:
            place = (seq, kind, message)
            if kind == "regenerate":
                parts.clear()
                if next_cut is None or later(place, next_cut):
                    next_cut = place
            elif cut is None or later(place, cut):
                if kind == "message" or not begun:
                    role, begun = said or "", True
                if kind != "delta":
                    parts.clear()
                parts.append(text or "")
        cut = next_cut
        if begun:
            yield head[-2], role, "".join(parts)


def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rendered():
        for (conv, _), events in groupby(rows_of(batches), key=itemgetter(0, 1)):
            for k, (first, role, text) in enumerate(surviving(events)):
                turn, start, end = render(role, text)
                yield conv, first + k, role, turn, start, end

    return in_batches(rendered(), TURNS_ARROW)


def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted():
        for (conv, block), events in groupby(rows_of(batches), key=itemgetter(0, 1)):
            yield conv, block, sum(1 for _ in surviving(events))

    return in_batches(counted(), COUNTS_ARROW)


def turn_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests():
        for conv, said in groupby(rows_of(batches), key=lambda r: r[0]):
            whole, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for _, _, _, formatted, start, end in said:
                role, text = read_back(formatted)
                whole.update(f"{role}\n{text}\n".encode())
                masked = unescaped(formatted[start:end])
                loss.update(masked.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + len(formatted)
            yield conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars

    return in_batches(digests(), DIGESTS_ARROW)


def _before(value):
    """``value``, an aggregate, over the blocks of the conversation before this one."""
    return value.over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))


def _dealt(events: DataFrame, heads: DataFrame) -> DataFrame:
    """Each block's events in the order of message and seq, after its row of ``heads``, which has first_turn and cut."""
    order = ["conv_id", "block", "body", "message", "seq", "kind", "role", "text"]
    rows = events.withColumn("body", F.lit(1)).unionByName(heads.withColumn("body", F.lit(0)), allowMissingColumns=True)
    rows = rows.repartition("conv_id", "block").sortWithinPartitions(*order)
    return rows.select("conv_id", "block", "body", "message", "seq", "kind", "role", "text", "first_turn", "cut")


def formatted_turns(log: DataFrame) -> DataFrame:
    """One row per final turn, rendered, with its loss span."""
    number = F.coalesce(F.col("message").cast("bigint"), F.lit(0).cast("bigint"))
    events = log.select("conv_id", F.col("seq").cast("bigint").alias("seq"), "kind", number.alias("message"), "role", "text")
    events = events.withColumn("block", F.floor(F.col("message") / RANGE))
    place = F.when(F.col("kind") == "regenerate", F.struct("seq", "kind", "message"))
    blocks = events.groupBy("conv_id", "block").agg(F.max(place).alias("last"))
    cuts = blocks.select("conv_id", "block", F.lit(0).cast("bigint").alias("first_turn"), _before(F.max("last")).alias("cut"))
    counts = _dealt(events.withColumn("text", F.lit(None).cast("string")), cuts).mapInArrow(survivors, COUNTS)
    firsts = counts.select("conv_id", "block", F.coalesce(_before(F.sum("n")), F.lit(0).cast("bigint")).alias("first_turn"))
    # One row per block from either side, by a sum and not a join: a null conversation is one, too.
    heads = cuts.unionByName(firsts, allowMissingColumns=True).groupBy("conv_id", "block")
    heads = heads.agg(F.sum("first_turn").alias("first_turn"), F.max("cut").alias("cut"))
    return _dealt(events, heads).mapInArrow(turns, TURNS)


def log_of_turns(turns_table: DataFrame, delta: int = DELTA) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the log of how they came about: each begins and grows by deltas.

    Every fourth message begins with a draft that an edit replaces. Every eighth one is first written, and answered, in
    another way and then regenerated, which drops both. The log folds to the given turns. Turns of the same number,
    repeated rows among them, are messages of their own, in the order of role and text. A text is cut into its deltas in
    one pass.
    """
    # A message's number has to be known where its rows are cut, so it comes from the conversation's own order.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns_table.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))
    parts = F.when(F.length("text") > 0, cut).otherwise(F.array(F.lit("")))
    said = _numbered(rows).select("conv_id", "message", "role", F.posexplode(parts).alias("part", "text"))

    message, draft = F.col("message"), F.concat(F.lit("draft: "), F.left("text", F.lit(16)))

    def event(place, kind: str, number, words):
        return F.struct(F.lit(place).alias("place") if isinstance(place, int) else place.alias("place"), F.lit(kind).alias("kind"), number.alias("message"), words.alias("text"))

    none = F.lit(None).cast("string")
    told = [event(0, "message", message, draft), event(1, "message", message + 1, draft), event(2, "regenerate", message, none)]
    plain = F.array(event(3, "message", message, F.col("text")))
    edited = F.array(event(3, "message", message, draft), event(4, "edit", message, F.col("text")))
    first = F.when(message % 8 == 3, F.concat(F.array(*told), plain)).when(message % 4 == 1, edited).otherwise(plain)
    grown = F.array(event(4 + F.col("part"), "delta", message, F.col("text")))
    events = F.when(F.col("part") == 0, first).otherwise(grown)
    return said.select("conv_id", "role", (message * (1 << 24)).alias("base"), F.inline(events)).select(
        "conv_id", (F.col("base") + F.col("place")).alias("seq"), "kind", "message", "role", "text"
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Messages numbered from 1 in the order of turn, role and text: the counts of the blocks before, and the place in the block."""
    rows = rows.withColumn("block", F.floor(F.col("turn") / RANGE))
    counts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    heads = counts.select("conv_id", "block", F.coalesce(_before(F.sum("n")), F.lit(0).cast("bigint")).alias("before"))
    both = rows.withColumn("body", F.lit(1)).unionByName(heads.withColumn("body", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("conv_id", "block").orderBy("body", "turn", "role", "text")
    # The head is the first row of its block.
    message = F.row_number().over(order) - 1 + F.first("before").over(order)
    return both.select("conv_id", "body", "role", "text", message.alias("message")).where("body = 1").drop("body")


def conversation_digests(turn_rows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its rendered turns in order."""
    order = ["conv_id", "turn"]
    return turn_rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(turn_digests, DIGESTS)


def control_case(spark: SparkSession) -> DataFrame:
    """A conversation made of control strings."""
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
