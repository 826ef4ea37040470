"""Chat formatting with any template, taken as a black box.

A template is a function from the turns (role, text) to a string. Every prefix
of a conversation is rendered and compared with the one before: what it adds is
the span of the new turn. A second rendering with a mark in place of the new
text shows where in the span the text lies. If a prefix doesn't go on from the
one before, the template rewrites history; the turn is noted, and spans beyond
the place where the two part are given up.

Defined results. Null texts and roles are empty. Turns are ordered by turn
(nulls first), then role, then text; repeated rows are turns of their own. Rows
without ``conv_id`` are one conversation with a null id. A conversation is one
string, so that it fits in a row; its prefixes take time with the square of its
turns. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = Sequence[tuple[str, str]]
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Stands for the text of a turn where its place is looked for.
MARK = "﷐"


def escape(s: str) -> str:
    """No control string is left: between ``<`` and ``|`` comes one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", s)


def unescape(s: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", s)


def escape_role(s: str) -> str:
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


def render(turns: Turns) -> str:
    """The template of the query: marked turns with escaped texts."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def parse(s: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    found = re.findall(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", s, re.DOTALL)
    return [(unescape_role(role), unescape(text)) for role, text in found]


def locate(turns: Turns, template: Callable[[Turns], str], trained: str = ASSISTANT) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """The formatted conversation, the span of each turn (-1, -1 if given up),
    those of the texts to train on, and the turns that rewrote history."""
    before, spans, texts, rewrote = template([]) if turns else "", [], [], []
    for i, (role, text) in enumerate(turns):
        now = template(turns[: i + 1])
        if now.startswith(before):
            spans.append((len(before), len(now)))
        else:
            rewrote.append(i)
            same = len(os.path.commonprefix([before, now]))
            spans = [s if s[1] <= same else (-1, -1) for s in spans]
            texts = [s for s in texts if s[1] <= same]
            spans.append((-1, -1))
        marked = template([*turns[:i], (role, MARK)]) if role == trained and text else ""
        at = marked.rfind(MARK)
        end = len(now) - (len(marked) - at - len(MARK))
        if at >= 0 and now[:at] == marked[:at] and at <= end:
            texts.append((at, end))
        before = now
    return before, spans, texts, rewrote


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(SPAN)), ("loss", pa.list_(SPAN)), ("rewrote", pa.list_(pa.int64()))])
FORMATTED_DDL = "conv_id long, formatted string, turns array<struct<start:long,end:long>>, loss array<struct<start:long,end:long>>, rewrote array<long>"


def format_conversations(conversations: DataFrame, template: Callable[[Turns], str] = render, trained: str = ASSISTANT) -> DataFrame:
    """A row for each conversation. Rows are shuffled by conversation and
    streamed in order; a task holds one conversation at a time."""
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    rows = conversations.select(columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: list[tuple[str, str]] = []
        current: int | None = None
        done: list[tuple] = []

        def close() -> None:
            if turns:
                text, spans, loss, rewrote = locate(turns, template, trained)
                as_spans = [[{"start": a, "end": b} for a, b in x] for x in (spans, loss)]
                done.append((current, text, *as_spans, rewrote))
                turns.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * len(FORMATTED)
            done.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, FORMATTED, strict=True)], schema=FORMATTED)

        for b in batches:
            for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != current:
                    close()
                    current = conv_id
                turns.append((role, text))
                if len(done) >= 1000:
                    yield flush()
        close()
        yield flush()

    return rows.mapInArrow(run, FORMATTED_DDL)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the trained texts, from ``render``'s output."""
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = pa.schema(fields)

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv_id, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                turns = parse(text)
                trained = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out.append((conv_id, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(trained), digest(trained), len(text)))
            cols = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
