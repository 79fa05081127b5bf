"""Chat formatting by event-sourced reconstruction.

*Log.*  A conversation is a log of events: conv_id, seq (its order), kind,
message (a number within the conversation), role, text, pos, len.

* ``start``       opens a message with a role (its text may come along)
* ``delta``       a streamed piece: appended to the message
* ``edit``        ``len`` code points of the message from ``pos`` are replaced by the text
* ``regenerate``  the message's text is emptied and the text begins it anew;
                  messages opened after it are dropped, as they answered the old text
* ``retract``     the message is dropped

Logs are partitioned by conversation, sorted by seq, and folded in one pass
per partition: the task holds the state of the conversation it is in, and
nothing else.  Messages come out in the order in which they opened.

*Rendering.*  A turn is ``<|role|>\\n`` text ``<|end|>\\n``.  Inside texts and
roles a backslash, and the ``<`` or ``[`` that begins a control string, or
``</s>``, get a backslash in front, which ``parse`` takes away; so no text can
open or close a turn, and the original comes back exactly.  The loss mask
covers the escaped text of each assistant turn, as (start, stop) code points of
the formatted text.

Every rendered row is one turn: conv_id, turn_no, text (formatted), loss spans
and the offset of the turn in its conversation.  A conversation is never one
value, so its length has no bound.  ``digests`` reads the written turns back.

Edge cases: a null text is empty; a null role is the empty role; events of
equal seq are taken in the order start, regenerate, edit, delta, retract, then
by role, text and message; events on a message that was never opened, or is dropped,
and unknown kinds, do nothing; an edit beyond the text's end acts at the end;
repeated rows are events of their own; a null conv_id is a conversation; a row of
null turn comes before its conversation's others.  An empty table gives no row;
other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm import common as C
from ferrule.session import scratch_path

DELTA = 1024
KINDS = ("start", "regenerate", "edit", "delta", "retract")
CONTROL = re.compile(r"\\|<(?=\||/s>|s>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<\|((?:[^\\|]|\\.|\|(?!>))*)\|>\n(.*)<\|end\|>\n", re.S)

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string, pos long, len long"
TURNS = "conv_id long, turn_no long, role string, text string"
RENDERED = "conv_id long, turn_no long, offset long, text string, loss array<struct<start:long,stop:long>>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(), text).replace("|>", "|\\>")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m.group(1), text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and stop of its text in it)."""
    head = f"<|{escape(role)}|>\n"
    body = escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse(turn: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    m = TURN.fullmatch(turn)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m.group(1)), unescape(m.group(2))


class Fold:
    """The state of one conversation."""

    def __init__(self):
        self.roles: dict = {}  # message -> role, in order of opening
        self.parts: dict = {}

    def apply(self, kind, message, role, text, pos, length) -> None:
        text = text or ""
        if kind == "start":
            if message in self.roles:  # opened anew: as a new message
                del self.roles[message]
            self.roles[message] = role or ""
            self.parts[message] = [text]
        elif message not in self.roles:
            return
        elif kind == "delta":
            self.parts[message].append(text)
        elif kind == "edit":
            old = "".join(self.parts[message])
            at = min(max(pos or 0, 0), len(old))
            self.parts[message] = [old[:at], text, old[at + max(length or 0, 0) :]]
        elif kind == "regenerate":
            later = list(self.roles)
            for m in later[later.index(message) + 1 :]:
                del self.roles[m]
            self.parts[message] = [text]
        elif kind == "retract":
            del self.roles[message]

    def turns(self):
        for k, (m, role) in enumerate(self.roles.items()):
            yield k, role, "".join(self.parts[m])


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows, names, types, size: int = 1 << 22):
    """Batches of about ``size`` characters."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += sum(len(x) for x in r if isinstance(x, str)) + 64
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def by_conversation(df: DataFrame, *order) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def reconstruct(events: DataFrame) -> DataFrame:
    """Folds event logs to final messages (``TURNS``)."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            conv, fold = None, None
            for c, kind, message, role, text, pos, length in _rows(batches):
                if fold is None or c != conv:
                    if fold is not None:
                        yield from ((conv, *t) for t in fold.turns())
                    conv, fold = c, Fold()
                fold.apply(kind, message, role, text, pos, length)
            if fold is not None:
                yield from ((conv, *t) for t in fold.turns())

        yield from _batches(out(), ["conv_id", "turn_no", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()])

    cols = ("conv_id", "kind", "message", "role", "text", "pos", "len")
    return by_conversation(events, "seq", rank, "role", "text", "message", "pos", "len").select(*cols).mapInArrow(run, TURNS)


def format_turns(turns: DataFrame) -> DataFrame:
    """Rendered turns (``RENDERED``); ``turns`` as ``reconstruct`` gives them:
    partitioned by conversation and in order, which is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            conv, offset = None, 0
            for c, k, role, text in _rows(batches):
                if k == 0 or c != conv:
                    conv, offset = c, 0
                s, a, b = render(role or "", text or "")
                loss = [{"start": offset + a, "stop": offset + b}] if role == "assistant" else []
                yield c, k, offset, s, loss
                offset += len(s)

        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        yield from _batches(out(), ["conv_id", "turn_no", "offset", "text", "loss"], types)

    return turns.mapInArrow(run, RENDERED)


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, from its formatted turns: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.  A digest runs
    through a conversation in order, so its turns pass one task, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            conv, state = None, None
            for c, offset, text, loss in _rows(batches):
                if state is None or c != conv:
                    if state is not None:
                        yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                for x in loss:
                    part = unescape(text[x["start"] - offset : x["stop"] - offset])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(text)
            if state is not None:
                yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from _batches(out(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                            [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return by_conversation(rendered, "turn_no").select("conv_id", "offset", "text", "loss").mapInArrow(run, schema)


def event_log(turns: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log that streams the rows of a table of turns (conv_id, turn, role,
    text): each row opens a message with its first ``delta`` code points, and
    streams the rest in deltas of as many.  Messages are numbered by turn (any
    long; null first), role and whole text, of which a start event has the first
    piece only; their numbers order the log, so no turn is too large."""
    keyed = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.length("text") - 1) / delta), F.lit(0))))
    cut = keyed.withColumn("part", piece)
    return cut.select(
        "conv_id", (F.col("message") * (1 << 20) + F.col("part")).alias("seq"),
        F.when(F.col("part") == 0, "start").otherwise("delta").alias("kind"), "message",
        F.when(F.col("part") == 0, F.col("role")).alias("role"),
        F.substring("text", F.col("part").cast("int") * delta + 1, F.lit(delta)).alias("text"),
        F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("len"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = scratch_path(spark, f"op3-{uuid.uuid4().hex}")
    format_turns(reconstruct(event_log(turns))).write.parquet(path)
    return digests(spark.read.schema(RENDERED).parquet(path))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(regexp_replace(text, '(\\|<\||</s>|<s>|\[/?INST\])', '\\\1', 'g'), '|>', '|\>') AS body FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + length(role) + 13)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op3_chat_format": (op3_chat_format, SQL)}
