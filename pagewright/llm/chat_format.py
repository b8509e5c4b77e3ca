"""Chat formatting from an event log: events of a conversation, in sequence, are folded into its final messages
(streamed deltas, edits, regenerations, deletions), which are then rendered with a reversible template.

Events: conv_id, seq, kind, message, role, text.
  message     a new message with role and text
  delta       text goes to the end of the last message of that id
  edit        text replaces the text of the last message of that id
  regenerate  the last message of that id starts anew with text; messages after it go
  delete      the last message of that id goes
An event on a message that is not there is a `message` if it is a delta or an edit, else it does nothing. Ties in seq
are ordered by message, kind, role and text. Null roles and texts are empty, a null conv_id is a conversation.

Rendered: `<|turn|>role\\ntext<|end|>` for each message. Within role and text a backslash is doubled, and each control
string gets `\\:` after its first character, so it no longer is one; line breaks in a role become `\\n`.

Scale: one exchange by conversation, sorted with spill; a task streams conversations and holds one at a time (it is
one output value). Many short conversations share a task, so hot keys are no longer than the conversation itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import grouped, small_batches

TURN, END = "<|turn|>", "<|end|>"
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]")
LOSS_ROLE = "assistant"
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_RENDERED = re.compile(re.escape(TURN) + r"(.*?)\n(.*?)" + re.escape(END), re.DOTALL)


def escape(s: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\:{m[0][1:]}", s.replace("\\", "\\\\"))


def unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: {":": "", "n": "\n"}.get(m[1], m[1]), s)


def fold(kinds: list, ids: list, roles: list, texts: list) -> list[tuple[str, str]]:
    """The final (role, text) messages of events in order. Places of each id are kept, so an event costs the same in a
    conversation of any length."""
    out: list[list | None] = []  # id, role, parts of the text; None: deleted
    places: dict = {}
    for kind, i, role, text in zip(kinds, ids, roles, texts, strict=True):
        of = places.setdefault(i, [])
        if kind == "message" or not of and kind in ("delta", "edit"):
            of.append(len(out))
            out.append([i, role or "", [text or ""]])
        elif not of:
            continue
        elif kind == "delta":
            out[of[-1]][2].append(text or "")
        elif kind == "edit":
            out[of[-1]][2] = [text or ""]
        elif kind == "regenerate":
            out[of[-1]][2] = [text or ""]
            while len(out) > of[-1] + 1:
                if (gone := out.pop()) is not None:
                    places[gone[0]].pop()
        elif kind == "delete":
            out[of.pop()] = None
    return [(m[1], "".join(m[2])) for m in out if m is not None]


def render(messages: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[int], list[int]]:
    """The formatted text, and the starts and ends of the spans under the loss mask, in code points."""
    parts, at, starts, ends = [], 0, [], []
    for role, text in messages:
        head, body = f"{TURN}{escape(role).replace('\n', '\\n')}\n", escape(text)
        if role == loss_role:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _RENDERED.finditer(formatted)]


def from_turns(conversations: DataFrame) -> DataFrame:
    """One `message` event for each row of (conv_id, turn, role, text)."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("turn").cast("long").alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def as_streamed(conversations: DataFrame) -> DataFrame:
    """The events that a log of (conv_id, turn, role, text) would have, had each text been streamed: a user's text is
    drafted and edited; any other is begun, regenerated and streamed in two deltas. Rows of one turn are told apart by a
    number in order of role and text."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda step, kind, part: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), part.alias("text"))
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    user = F.array(event(0, "message", first), event(1, "edit", text))
    other = F.array(event(0, "message", F.reverse(text)), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", rest))
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("message", number)
    d = d.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.explode(F.when(F.col("role") == "user", user).otherwise(other)).alias("e"))
    return d.select("conv_id", (F.col("message") * 4 + F.col("e.step")).alias("seq"), "e.kind", "message", "role", "e.text")


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_starts, loss_ends: one row for each conversation with events."""
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ints = pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.string(), ints, ints)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for g in grouped(batches, ["conv_id"]):
            messages = fold(g["kind"], g["message"], g["role"], g["text"])
            rows.append((g["conv_id"][0], len(messages), *render(messages)))
            size += len(rows[-1][2])
            if len(rows) == 1024 or size > 4_000_000:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    events = events.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "kind", "message", "role", "text")
    dealt = events.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind", "role", "text")
    return dealt.mapInArrow(made, "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for text, starts, ends in zip(b.column("formatted").to_pylist(), b.column("loss_starts").to_pylist(), b.column("loss_ends").to_pylist(), strict=True):
                turns = parse(text)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                out.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
