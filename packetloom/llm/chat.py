"""Chat formatting with a black-box template, by rendering growing prefixes.

A template is any function from messages to text. Successive prefixes of a conversation are rendered; where one output
extends the last, the new part is the turn's span, and two probes of the turn show where its text lies inside. An output
that does not extend the last one shows that the template rewrites history: the turns it touches are marked unstable and
carry no loss.

A template is shown the true prefixes of a conversation, so a conversation is held whole and its work grows with the square
of its turns. Templates whose text for a turn depends on the turn alone can be declared local with ``window``: prefixes are
then taken inside windows of so many turns, with the turn before as context, and a window is the most that is held.

Defined results: a null text or role counts as empty; turns in null or equal positions are ordered null first, then by
role and text; repeated rows are separate turns; rows without a conversation id form one conversation; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Message = tuple[str, str]  # role, text
Render = Callable[[list[Message]], str]


class TurnTemplate:
    """Marks every turn; control strings cannot arise from texts.

    Each control string begins with ``<`` or ``[`` and another character. In texts these two and the backslash are
    followed by an inserted backslash, which ``unescape`` takes away again.
    """

    begin, turn, end, line = "<s>", "<|turn|>", "</s>", "</n>"

    def escape(self, text: str) -> str:
        return re.sub(r"[<\[\\]", r"\g<0>\\", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"([<\[\\])\\", r"\1", text)

    def __call__(self, messages: list[Message]) -> str:
        return self.begin + "".join(
            f"{self.turn}{self.escape(role).replace(chr(10), self.line)}\n{self.escape(text)}{self.end}" for role, text in messages)

    def parse(self, text: str) -> list[Message]:
        """The messages back from formatted text, or from a piece of it."""
        found = []
        for part in text.removeprefix(self.begin).split(self.end)[:-1]:
            role, _, body = part.removeprefix(self.turn).partition("\n")
            found.append((self.unescape(role.replace(self.line, "\n")), self.unescape(body)))
        return found


def probe(render: Render, before: list[Message], role: str) -> tuple[str, str]:
    """What the template puts before and after the text of a turn with this role."""
    base = render(before)
    one, two = (render([*before, (role, x)])[len(base):] for x in "ab")
    at = len(os.path.commonprefix([one, two]))
    return one[:at], one[at + 1 :]


def locate(render: Render, context: list[Message], messages: list[Message], probes: dict, whole: bool = False) -> tuple[str, list[list]]:
    """The formatted text of ``messages`` after ``context``, and ``[start, end, text_start, text_end, stable]`` of each turn.
    ``whole``: with what the template puts before any turn, and with probes of each turn's own."""
    previous = render(context)
    cut = 0 if whole else len(previous)
    spans: list[list] = []
    for k, (role, _) in enumerate(messages):
        current = render([*context, *messages[: k + 1]])
        if current.startswith(previous):
            a, b = len(previous) - cut, len(current) - cut
            part = current[len(previous) :]
            for fresh in (True,) if whole else (False, True):
                if fresh or role not in probes:
                    probes[role] = probe(render, [*context, *messages[:k]], role)
                head, tail = probes[role]
                fits = part.startswith(head) and part.endswith(tail) and len(part) >= len(head) + len(tail)
                if fits:
                    break
            spans.append([a, b, a + len(head), b - len(tail), True] if fits else [a, b, a, a, False])
        else:
            same = len(os.path.commonprefix([previous, current])) - cut
            for s in spans:
                if s[1] > same:
                    s[:] = [min(s[0], max(same, 0)), max(same, 0), 0, 0, False]
            spans.append([max(same, 0), len(current) - cut, 0, 0, False])
        previous = current
    return previous[cut:], spans


def conversations(batches: Iterator[pa.RecordBatch], window: int | None) -> Iterator[tuple[bool, object, list[Message], list[Message]]]:
    """Windows of turns from rows sorted by conversation: whether it begins one, its id, the turn before, the turns."""
    now, held, before, first = None, [], [], True
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and conv != now:
                yield first, now, before, held
                held, before, first = [], [], True
            elif len(held) == window:
                yield first, now, before, held
                held, before, first = [], held[-1:], False
            elif not held:
                first = True
            now = conv
            held.append((role or "", text or ""))
    if held:
        yield first, now, before, held


def format_conversations(turns: DataFrame, template: Render | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_role: str = "assistant", window: int | None = None) -> DataFrame:
    """``conv_id, piece, offset, formatted, spans``: a conversation's formatted text is its pieces in order, ``offset`` is
    where a piece starts in it. ``spans`` has ``role, start, end, text_start, text_end, stable, loss`` of each turn, in
    code points of the whole conversation. Rows of a conversation are in one partition, in order. ``window`` declares the
    template local; without it a conversation is one piece. The default template is local, in windows of 64 turns."""
    render = template or TurnTemplate()
    window = window or (64 if template is None else None)
    span = "array<struct<role: string, start: long, `end`: long, text_start: long, text_end: long, stable: boolean, loss: boolean>>"
    schema = T.StructType([T.StructField("conv_id", turns.schema[conv_col].dataType), T.StructField("piece", T.LongType()), T.StructField("offset", T.LongType()),
                           T.StructField("formatted", T.StringType()), *T.StructType.fromDDL(f"spans {span}").fields])
    kinds = [("role", pa.string()), *[(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")], ("stable", pa.bool_()), ("loss", pa.bool_())]
    span_type = pa.list_(pa.struct(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes: dict = {}
        piece = offset = 0
        id_type = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        for first, conv, before, messages in conversations(typed(), window):
            prologue = render([]) if first and window else ""
            if first:
                piece = offset = 0
            body, spans = locate(render, before, messages, probes, window is None)
            at = offset + len(prologue)
            rows = [{"role": role, "start": at + a, "end": at + b, "text_start": at + c, "text_end": at + d, "stable": ok, "loss": ok and role == loss_role}
                    for (role, _), (a, b, c, d, ok) in zip(messages, spans)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], id_type), pa.array([piece]), pa.array([offset]), pa.array([prologue + body]), pa.array([rows], span_type)], names=schema.names)
            piece, offset = piece + 1, at + len(body)

    d = turns.select(F.col(conv_col).alias("conv_id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(turn_col).alias("turn"))
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return d.select("conv_id", "role", "text").mapInArrow(run, schema)


def read_back(pieces: DataFrame, template: TurnTemplate | None = None) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_unstable`` from the formatted text and its
    loss spans alone. ``pieces`` must come as ``format_conversations`` left them."""
    form = template or TurnTemplate()
    schema = T.StructType([pieces.schema["conv_id"], *T.StructType.fromDDL(
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_unstable long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        kind = None

        def close() -> pa.RecordBatch:
            conv, n, turns, chars, loss, size, unstable = state
            values = [n, turns.hexdigest(), chars, loss.hexdigest(), size, unstable]
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), *[pa.array([v]) for v in values]], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, piece, offset, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if piece == 0:
                    if state:
                        yield close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in form.parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    if s["loss"]:
                        said = form.unescape(text[s["text_start"] - offset : s["text_end"] - offset])
                        state[3] += len(said)
                        state[4].update(said.encode())
                    state[6] += not s["stable"]
                state[5] += len(text)
        if state:
            yield close()

    return pieces.mapInArrow(run, schema)
