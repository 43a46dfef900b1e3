"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to a string. Nothing is known of it, so
each turn is found by rendering one turn more and comparing: if the new output begins with the
old one, the rest is the turn's span; if not, the template rewrites history, which is reported.
The place of a text inside its span is found by rendering it once more with one marker
character in its stead. Prefixes are rendered whole, however long the conversation: what an
unknown template does with earlier turns cannot be told from a part of them. That is work in the
square of a conversation's turns, and one conversation in memory. For a template known to be
*local* (the output of a list of turns is that of its parts, joined, whatever came before) the caller
may pass ``window``: after that many turns only the newest stays as context, so a
conversation of any length costs linear time and bounded memory.

Rows of a conversation stream through one task in order, nothing is collected; the output is
one row a turn, whose ``piece`` strings, joined, are the formatted conversation.

Defined cases: null text and null role are empty; a null conversation id is one conversation; rows
of equal turn come in order of role and text; repeated rows are repeated turns; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]
LOCAL_WINDOW = 64  # turns of context for templates declared local
MARK = "\ue000"
START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\([\\|n])")


def escape(text: str) -> str:
    """No ``<|`` is left, so no control string; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def marked_turns(messages: list[tuple[str, str]]) -> str:
    """The default template: marked turns, control strings in roles and texts escaped."""
    return "".join(f"{START}{escape(role).replace(chr(10), '\\n')}\n{escape(text)}{END}\n" for role, text in messages)


def read_turns(text: str) -> tuple[list[tuple[str, str, int, int]], int]:
    """Complete turns of formatted text as (role, text, place of the escaped text), and where they end."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out, at


class Formatter:
    """Renders the turns of one conversation one after another."""

    def __init__(self, template: Template, window: int | None = None):
        self.template, self.window = template, window
        self.context: list[tuple[str, str]] = []
        self.before = ""
        self.chars = 0

    def add(self, role: str, text: str) -> dict:
        if self.window is not None and len(self.context) >= self.window:
            self.context = self.context[-1:]
            self.before = self.template(self.context)
        now = self.template([*self.context, (role, text)])
        rewritten = not now.startswith(self.before)
        # After a rewrite the span begins where the outputs part.
        shared = len(self.before) if not rewritten else next((i for i, (a, b) in enumerate(zip(self.before, now)) if a != b), min(len(self.before), len(now)))
        probe = self.template([*self.context, (role, MARK)])
        at = probe.find(MARK, min(shared, len(probe)))
        size = len(now) - len(probe) + 1
        piece = now[shared:]
        placed = at >= shared and size >= 0 and probe[:at] == now[:at]
        out = {
            "piece": piece, "start": self.chars, "end": self.chars + len(piece), "rewritten": rewritten,
            "text_start": self.chars + at - shared if placed else None, "text_end": self.chars + at - shared + size if placed else None,
        }
        self.chars += len(piece)
        self.context.append((role, text))
        self.before = now
        return out


_PIECES = "conv_id {kind}, turn long, role string, piece string, start long, end long, text_start long, text_end long, rewritten boolean"


def _ordered(batches):
    for b in batches:
        yield from zip(*[b[c].to_pylist() for c in ("conv_id", "turn", "role", "text")])


def _format(template: Template, window: int | None, id_type: pa.DataType):
    schema = pa.schema([("conv_id", id_type), ("turn", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                        ("text_start", pa.int64()), ("text_end", pa.int64()), ("rewritten", pa.bool_())])

    def run(batches):
        current, formatter, out, size = object(), None, [], 0
        for conv, turn, role, text in _ordered(batches):
            if formatter is None or conv != current:
                current, formatter = conv, Formatter(template, window)
            out.append({"conv_id": conv, "turn": turn, "role": role} | formatter.add(role or "", text or ""))
            size += len(out[-1]["piece"])
            if len(out) >= 4096 or size >= 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def format_turns(conversations: DataFrame, template: Template = marked_turns, window: int | None = None) -> DataFrame:
    """One row a turn: conv_id, turn, role, piece, its place (start, end) in the conversation's
    formatted text, the place of the escaped text (null if the template does not show it), rewritten.

    A conversation's rows stay in one partition, in order. ``window`` declares the template local.
    """
    import pyspark.sql.pandas.types as at

    field = conversations.schema["conv_id"].dataType
    ordered = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(template, window, at.to_arrow_type(field)), _PIECES.format(kind=field.simpleString()))


def _read_back(id_type: pa.DataType, learnt: str):
    schema = pa.schema([("conv_id", id_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())])

    def fresh(conv):
        return {"conv_id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "rest": "", "rewritten": False}

    def close(s):
        return {"conv_id": s["conv_id"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["loss_chars"], "loss_sha256": s["loss"].hexdigest(),
                "formatted_chars": s["chars"], "rewritten": s["rewritten"]}

    def run(batches):
        state, out = None, []
        for b in batches:
            for conv, piece, start, text_start, text_end, rewritten in zip(*[b[c].to_pylist() for c in ("conv_id", "piece", "start", "text_start", "text_end", "rewritten")]):
                if state is None or conv != state["conv_id"]:
                    if state is not None:
                        out.append(close(state))
                    state = fresh(conv)
                state["chars"] += len(piece)
                state["rewritten"] |= rewritten
                text = state["rest"] + piece
                turns, at = read_turns(text)
                state["rest"] = text[at:]
                for role, content, _, _ in turns:
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{content}\n".encode())
                    if role == learnt and text_start is not None:
                        masked = unescape(piece[text_start - start : text_end - start])
                        state["loss"].update(masked.encode())
                        state["loss_chars"] += len(masked)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state is not None:
            out.append(close(state))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def read_back(pieces: DataFrame, learnt: str = LEARNT_ROLE) -> DataFrame:
    """Digests per conversation, read from the pieces of ``format_turns`` (default template) in their own partitions."""
    import pyspark.sql.pandas.types as at

    field = pieces.schema["conv_id"].dataType
    return pieces.mapInArrow(_read_back(at.to_arrow_type(field), learnt),
                             f"conv_id {field.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")
