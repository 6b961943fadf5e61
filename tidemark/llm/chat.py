"""Chat formatting: turns located in the output of a template that is only called, never read.

The template is a function from a list of (role, text) to a string. The prefixes of a conversation are rendered one
after another; each output must begin with the one before, and what is new belongs to the newest turn. A template whose
output for a longer prefix doesn't begin with the shorter one's rewrites history and is reported as such. Every prefix is
rendered whole, whatever its length, as a template may number turns or drop early ones. So the work grows with the square of
a conversation's length, and the conversation at hand is held in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import private, ship, tidy

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
# The control strings of the template.
OPEN, CLOSE, START, END = "[INST]", "[/INST]", "<s>", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:INST\]|s>))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:INST\]|s>))")


def escape(text: str) -> str:
    """No control string is left: each gets one more backslash after its first character."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def instruct_template(turns: list[Turn]) -> str:
    """`<s>role[INST]text[/INST]</s>` for each turn, with control strings in roles and texts escaped."""
    return "".join(f"{START}{escape(role)}{OPEN}{escape(text)}{CLOSE}{END}" for role, text in turns)


_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)


class Rewritten(ValueError):
    """The template changed what it had written for earlier turns."""


class Incremental:
    """Renders a conversation turn by turn. push() returns what the turn added; its span is [start, end) of the output."""

    def __init__(self, template: Template):
        self.template = template
        self.turns: list[Turn] = []
        self.before = template([])
        self.end = len(self.before)
        self.count = 0

    def push(self, turn: Turn) -> tuple[int, int, str]:
        self.turns.append(turn)
        now = self.template(self.turns)
        if not now.startswith(self.before):
            raise Rewritten(f"turn {self.count} changes the output of earlier turns")
        added = now[len(self.before) :]
        start, self.end, self.before = self.end, self.end + len(added), now
        self.count += 1
        return start, self.end, added


def spans(turns: list[Turn], template: Template = instruct_template) -> tuple[list[tuple[int, int]], bool]:
    """(span of each turn, whether the template rewrites history) of a whole conversation; spans stop at the rewriting turn."""
    render, found = Incremental(template), []
    try:
        for turn in turns:
            found.append(render.push(turn)[:2])
    except Rewritten:
        return found, True
    return found, False


def text_span(added: str) -> tuple[int, int]:
    """Where the text of a turn stands within what the turn added: between the two marks of the template."""
    m = _TURN.fullmatch(added)
    if not m:
        raise ValueError("not one turn of the template")
    return m.span(2)


class _Digest:
    """What the query needs of one conversation, taken from the rendered output as it grows."""

    def __init__(self, conv_id: int | None, template: Template):
        self.conv_id, self.render = conv_id, Incremental(template)
        self.all, self.loss, self.loss_chars, self.n_turns = hashlib.sha256(), hashlib.sha256(), 0, 0
        self.rewritten, self.readable = False, template is instruct_template

    def push(self, turn: Turn) -> None:
        self.n_turns += 1
        if self.rewritten:
            return
        try:
            _, _, added = self.render.push(turn)
        except Rewritten:
            self.rewritten = True
            return
        if self.readable:
            m = _TURN.fullmatch(added)
            role, text = unescape(m[1]), unescape(m[2])
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss.update(text.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(text)

    def row(self) -> tuple:
        read = self.readable and not self.rewritten
        digests = (self.all.hexdigest(), self.loss_chars, self.loss.hexdigest()) if read else (None, None, None)
        return self.conv_id, self.n_turns, *digests, None if self.rewritten else self.render.end, self.rewritten


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())])


def _by_conversation(conversations: DataFrame) -> DataFrame:
    ship(conversations.sparkSession)
    turns = private(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_digests(conversations: DataFrame, template: Template = instruct_template) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten of every conversation.

    A template other than instruct_template can be rendered and not read back: its digests are null. Where a template
    rewrites history, its length is null as well and `rewritten` is true.

    Rows of a conversation are sorted by turn, then role and text, so ties and repeated rows have one order (and all
    count). A null text or role is empty; rows without conv_id form a conversation of their own; an empty table gives no
    rows. The rows stream through in sorted order: one conversation at a time is held in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if state is None or state.conv_id != conv_id:
                    if state is not None:
                        done.append(state.row())
                    state = _Digest(conv_id, template)
                state.push((role, text))
            if len(done) >= 2000:
                yield _rows(done)
                done = []
        if state is not None:
            done.append(state.row())
        if done:
            yield _rows(done)

    return _by_conversation(conversations).mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _FORMATTED, strict=True)], schema=_FORMATTED)


def formatted_turns(conversations: DataFrame, template: Template = instruct_template) -> DataFrame:
    """A row for each turn: conv_id, turn_no, start, end, formatted (what the turn adds), loss_start, loss_end (the
    span of an assistant's text, else null), rewritten. After a turn that rewrites history the conversation has no more rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, render, broken = object(), None, False
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if conv_id != current or render is None:
                    current, render, broken = conv_id, Incremental(template), False
                if broken:
                    continue
                try:
                    start, end, added = render.push((role, text))
                except Rewritten:
                    broken = True
                    rows.append((conv_id, render.count, None, None, None, None, None, True))
                    continue
                own = text_span(added) if template is instruct_template and role == "assistant" else None
                rows.append((conv_id, render.count - 1, start, end, added, own and start + own[0], own and start + own[1], False))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "turn_no", "start", "end", "formatted", "loss_start", "loss_end", "rewritten"])

    return _by_conversation(conversations).mapInArrow(tidy(run), "conv_id long, turn_no long, start long, end long, formatted string, loss_start long, loss_end long, rewritten boolean")
