"""Chat formatting by incremental black-box rendering (operator 10).

A template is any function from a list of turns to a text. Successive prefixes of a conversation are rendered and each
output compared with the one before: what it adds is the new turn's span. An output that does not begin with the one
before shows that the template rewrites history. Probe texts in the new turn's place tell which part of its span is the
text itself, and so what the loss mask covers.

Rows are dealt by conversation, sorted and read turn by turn. A conversation is rendered whole, prefix by prefix, which
takes work that grows with the square of its turns and holds it in memory. Only a template that declares itself
append-only is rendered in windows of turns, so that memory does not grow with a conversation; that each window
continues the one before is verified by comparing outputs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quireframe.session import ship_code

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Turns of a window of an append-only template, and the characters of texts after which a window ends early.
WINDOW_TURNS = 64
WINDOW_CHARS = 200_000
#: Rows that a task sends on together.
ROWS_OUT = 256
LOSS_ROLE = "assistant"

OPEN, CLOSE = "<turn ", "</turn>\n"
#: Strings with which a text could pass for the template's own marks, or for other formats' role marks.
CONTROL = re.compile(r"\\|</?turn|###|<\|")


def escaped(text: str) -> str:
    """``text`` with a backslash before each backslash and control string; reversible by ``unescaped``."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _role_mark(role: str) -> str:
    return escaped(role).replace(">", "\\>").replace("\n", "\\\n")


def append_only(template: Template) -> Template:
    """Declare that ``template`` gives for two lists of turns put together what it gives for each, put together. It is
    then rendered window by window; an output that shows otherwise is an error."""
    template.append_only = True
    return template


@append_only
def turn_template(turns: list[Turn]) -> str:
    """Each turn as an opening mark with its role, a line break, the escaped text, a line break and a closing mark."""
    return "".join(f"{OPEN}{_role_mark(role)}>\n{escaped(text)}\n{CLOSE}" for role, text in turns)



def read_turns(formatted: str) -> list[Turn]:
    """The turns of ``turn_template``'s output."""
    out, at = [], 0
    while at < len(formatted):
        head = formatted.index(">\n", at + len(OPEN))
        while _escaped_at(formatted, head):
            head = formatted.index(">\n", head + 1)
        end = formatted.index("\n" + CLOSE, head + 1)
        out.append((unescaped(formatted[at + len(OPEN) : head]), unescaped(formatted[head + 2 : max(end, head + 2)])))
        at = end + 1 + len(CLOSE)
    return out


def _escaped_at(text: str, at: int) -> bool:
    n = 0
    while at - n > 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


class Span(NamedTuple):
    """Where a turn lies in the output: the whole of it, and its text."""

    start: int
    end: int
    text_start: int
    text_end: int


def _common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def locate(turns: list[Turn], template: Template) -> tuple[str, list[Span], bool]:
    """The output for all turns, each turn's span and whether the template ever rewrote what it had put out.

    A rewritten part counts to the turn that caused it: its span starts where the two outputs part, and spans found
    before are cut off there.
    """
    output, spans, rewrites = template([]) if not turns else "", [], False
    for k in range(1, len(turns) + 1):
        before, output = output, template(turns[:k])
        start = len(before)
        if not output.startswith(before):
            rewrites = True
            start = _common_prefix(before, output)
            spans = [Span(*(min(x, start) for x in s)) for s in spans]
        role = turns[k - 1][0]
        one, two = (template([*turns[: k - 1], (role, probe)]) for probe in ("x", "y"))
        head = max(_common_prefix(one, two), start)
        tail = _common_prefix(one[::-1], two[::-1])
        spans.append(Span(start, len(output), head, max(head, len(output) - tail)))
    return output, spans, rewrites


class Window(NamedTuple):
    output: str
    spans: list[Span]
    roles: list[str]
    rewrites: bool


def windows(turns: Iterable[Turn], template: Template) -> Iterator[Window]:
    """A conversation's windows in order, at least one turn each: one for all turns, or bounded ones if the template
    declares itself append-only."""
    bounded = getattr(template, "append_only", False)
    held: list[Turn] = []
    before: tuple[list[Turn], str] = [], ""
    chars = 0
    for turn in turns:
        if bounded and held and (len(held) >= WINDOW_TURNS or chars + len(turn[1]) > WINDOW_CHARS):
            yield (w := _window(held, template, *before))
            before, held, chars = (held, w.output), [], 0
        held.append(turn)
        chars += len(turn[1])
    if held:
        yield _window(held, template, *before)


def _window(held: list[Turn], template: Template, turns_before: list[Turn], output_before: str) -> Window:
    output, spans, rewrites = locate(held, template)
    if turns_before and (rewrites or template([*turns_before, *held]) != output_before + output):
        raise ValueError("the template declares itself append-only, but its output depends on turns before")
    return Window(output, spans, [r for r, _ in held], rewrites)


def _sorted_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    ship_code(rows.sparkSession)
    slim = rows.select(rows[f"`{conv}`"].alias("conv_id"), rows[f"`{turn}`"].alias("turn"), F.coalesce(rows[f"`{role}`"], F.lit("")).alias("role"), F.coalesce(rows[f"`{text}`"], F.lit("")).alias("text"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[Turn]]]:
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    for conv, of in groupby(rows, key=lambda x: x[0]):
        yield conv, ((r, t) for _, r, t in of)


def _map_rows(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str) -> DataFrame:
    """``rows`` through ``make``, which reads a partition's batches and yields tuples, sent on a few at a time."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(batches)
        while held := list(islice(made, ROWS_OUT)):
            yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)

    return rows.mapInArrow(run, schema)


def _array(values: tuple, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind):
        names = [f.name for f in kind.value_type]
        return pa.array([[dict(zip(names, x, strict=True)) for x in v] for v in values], kind)
    return pa.array(values, kind)


def format_conversations(rows: DataFrame, template: Template = turn_template, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, or per window of it if ``template`` is declared ``append_only``: conv_id, window, formatted, rewrites_history and turns, an array of
    role, start, end, text_start and text_end within ``formatted``.

    Turns come in order of turn, then role and text; nulls of turn first. Null roles and texts are empty strings; rows
    with a null conversation form one. An empty table gives no rows.
    """
    sorted_rows = _sorted_turns(rows, conv, turn, role, text)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for cid, turns in _conversations(batches):
            for k, w in enumerate(windows(turns, template)):
                yield cid, k, w.output, w.rewrites, [(r, *s) for r, s in zip(w.roles, w.spans, strict=True)]

    kind = sorted_rows.schema["conv_id"].dataType.simpleString()
    return _map_rows(sorted_rows, formatted, f"conv_id {kind}, window int, formatted string, rewrites_history boolean, turns array<struct<role string, start int, end int, text_start int, text_end int>>")


def digest_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, read back from the formatted output: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars and rewrites_history. Turns are recovered by reading the marks, loss texts by the
    located spans; both are hashed as they stream by."""
    sorted_rows = _sorted_turns(rows, conv, turn, role, text)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for cid, turns in _conversations(batches):
            all_turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            rewrites = False
            for w in windows(turns, turn_template):
                for r, t in read_turns(w.output):
                    n += 1
                    all_turns.update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                for r, s in zip(w.roles, w.spans, strict=True):
                    if r == LOSS_ROLE:
                        part = unescaped(w.output[s.text_start : s.text_end])
                        loss_chars += len(part)
                        loss.update(part.encode("utf-8", "surrogatepass"))
                chars += len(w.output)
                rewrites |= w.rewrites
            yield cid, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites

    kind = sorted_rows.schema["conv_id"].dataType.simpleString()
    return _map_rows(sorted_rows, digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
