"""Chat formatting from event logs.

A log row is an event of a conversation at a sequence number: ``message`` (a whole message),
``delta`` (more text for it), ``edit`` (its text is replaced) or ``regenerate`` (its text starts
anew). Messages are folded one by one, so a conversation of any length is spread over tasks;
then each is rendered by itself, and conversations are read in order as a stream whose state is
a few counters and hashes.

Rendered forms: user ``[INST] text [/INST]``, assistant `` text </s>``, system ``<<SYS>>`` text
``<</SYS>>``, any other ``[ROLE name] text [/ROLE]``; a conversation opens with ``<s>``. A
backslash goes before every backslash and control string inside a text, and undoing that gives
the text back exactly. The loss mask covers the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

OPEN = "<s>"
#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"(?s)\\(.)")
FORMS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
_OTHER = ("[ROLE ", " [/ROLE]")
_STOPS = {end: re.compile(r"(?s)\\.|(" + re.escape(end) + ")") for end in [*(e for _, e in FORMS.values()), _OTHER[1], "] "]}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> str:
    if role in FORMS:
        before, after = FORMS[role]
        return before + escape(text) + after
    return _OTHER[0] + escape(role).replace("]", "\\]") + "] " + escape(text) + _OTHER[1]


def _until(s: str, at: int, end: str) -> tuple[int, int]:
    for m in _STOPS[end].finditer(s, at):
        if m[1]:
            return m.start(), m.end()
    raise ValueError("unclosed turn")


def parse(s: str, at: int = 0) -> Iterator[tuple[str, str, tuple[int, int] | None]]:
    """(role, text, loss span in ``s`` or None) of each rendered turn."""
    at += len(OPEN) if s.startswith(OPEN, at) else 0
    while at < len(s):
        role = next((r for r in ("user", "system", "assistant") if s.startswith(FORMS[r][0], at)), None)
        if role:
            at += len(FORMS[role][0])
            stop, nxt = _until(s, at, FORMS[role][1])
        elif s.startswith(_OTHER[0], at):
            stop, nxt = _until(s, at + len(_OTHER[0]), "] ")
            role, at = unescape(s[at + len(_OTHER[0]) : stop]), nxt
            stop, nxt = _until(s, at, _OTHER[1])
        else:
            raise ValueError("no turn here")
        yield role, unescape(s[at:stop]), (at, stop) if role == "assistant" else None
        at = nxt


def fold(events: DataFrame) -> DataFrame:
    """``events(conv_id, seq, event, message_id, role, text)`` -> ``(conv_id, seq, role, text)``, one row a message.

    A message stands at its first event's number and has that event's role. Its text is that of its last
    ``message``, ``edit`` or ``regenerate`` with all later deltas, in order of number, then of text. An
    event without a message id is a message of its own. Null texts are empty, null roles too; an unknown
    event counts as a delta; equal rows count each time.
    """
    events = events.select("conv_id", "seq", "event", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = events.filter("message_id is null").select("conv_id", "seq", "role", "text")
    parts = events.filter("message_id is not null")
    key = ["conv_id", "message_id"]
    resets = F.col("event").isin("message", "edit", "regenerate")
    heads = parts.groupBy(*key).agg(F.min(F.struct("seq", "role")).alias("head"), F.max(F.when(resets, F.struct("seq", "text"))).alias("last"))
    heads = heads.select(F.col("conv_id").alias("c"), F.col("message_id").alias("m"), F.col("head.seq").alias("first"), F.col("head.role").alias("first_role"), F.col("last.seq").alias("reset"), F.coalesce("last.text", F.lit("")).alias("start"))
    deltas = parts.filter(~resets | F.col("event").isNull()).select(*key, "seq", "text")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message_id") == F.col("m"))
    later = heads.join(deltas, same & (F.col("reset").isNull() | (F.col("seq") > F.col("reset"))), "left")
    whole = later.groupBy("c", "m", "first", "first_role", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("seq").isNotNull() | F.col("text").isNotNull(), F.struct("seq", "text")))), lambda x: x["text"]), "").alias("more"))
    return alone.unionByName(whole.select(F.col("c").alias("conv_id"), F.col("first").alias("seq"), F.col("first_role").alias("role"), F.concat("start", "more").alias("text")))


#: Events that one message is logged with at most.
STEPS = 8


def logged(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` -> an event log of them as ``fold`` takes it, written down.

    How a message came about is drawn from a hash of it: at once; begun and streamed on in deltas; as a
    draft that an edit replaced; or streamed, thrown away and regenerated. Folding gives the message
    again. Repeated rows are messages of their own; null texts are empty; an empty table gives no event."""
    text, half = F.coalesce("text", F.lit("")), (F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    one = lambda step, event, value: F.struct(F.lit(step).alias("step"), F.lit(event).alias("event"), value.alias("text"))
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    third = (F.length(tail) / 2).cast("int")
    streamed = [F.substring(tail, F.lit(1), third), F.substring(tail, third + 1, F.length(tail))]
    ways = [
        F.array(one(0, "message", F.col("text"))),
        F.array(one(0, "message", head), one(1, "delta", streamed[0]), one(2, "delta", streamed[1])),
        F.array(one(0, "message", F.concat(F.lit("draft "), head)), one(1, "delta", F.lit("...")), one(2, "edit", text)),
        F.array(one(0, "message", F.lit("")), one(1, "delta", tail), one(2, "regenerate", F.lit("")), one(3, "delta", head), one(4, "delta", streamed[0]), one(5, "delta", streamed[1])),
    ]
    way = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(len(ways)))
    events = messages.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().cast("string").alias("message_id"))
    events = events.select("conv_id", "turn", "role", "message_id", F.explode(F.get(F.array(*ways), way.cast("int"))).alias("e"))
    # Logs come in any order.
    return materialise(events.select("conv_id", (F.col("turn") * STEPS + F.col("e.step")).alias("seq"), "e.event", "message_id", "role", "e.text"), "log")


def rendered(messages: DataFrame) -> DataFrame:
    """``(conv_id, seq, role, text)`` -> ``(conv_id, seq, role, text, segment)``; row by row. Null roles and
    texts are empty; repeated rows stay; an empty table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segments = [render(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segments, pa.string())], names=["conv_id", "seq", "role", "text", "segment"])

    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    messages = messages.select("conv_id", "seq", "role", "text")
    return messages.mapInArrow(run, f"conv_id {kinds['conv_id']}, seq {kinds['seq']}, role string, text string, segment string")


def digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation, from its rendered segments alone, in order.

    A task holds a batch of segments and the hashes of one conversation, however long it is. SHA-256
    over a conversation in order can't be split, so one conversation is one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def close() -> None:
            out.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 6
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return made

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for conv, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if now != (conv,):
                    if now is not None:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), len(OPEN)]
                state[4] += len(segment)
                for role, text, loss in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if loss:
                        masked = unescape(segment[loss[0] : loss[1]])
                        state[2] += len(masked)
                        state[3].update(masked.encode())
            if out:
                yield batch()
        if now is not None:
            close()
            yield batch()

    kind = segments.schema["conv_id"].dataType.simpleString()
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text").select("conv_id", "segment")
    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def formatted(events: DataFrame) -> DataFrame:
    """Fold, render, write the rendered log down, and read its digests back from there: ``(conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars)``. Nulls and repeated rows as in ``fold``; rows
    without a conversation are one; an empty log gives no row; further columns are ignored."""
    return digests(materialise(rendered(fold(events)), "rendered"))
