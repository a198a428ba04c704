"""Chat formatting in token-budgeted windows of whole turns, and its exact inverse."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import whole_number

#: The template: a turn is HEAD role COLON text END. Inside roles and texts the characters of CODES become a backslash and a
#: letter, so no marker can appear there.
HEAD, COLON, END = "### ", ":\n", "</turn>\n"
CODES = {"\\": "\\b", "#": "\\h", "<": "\\l", ":": "\\c"}
ESCAPED, UNESCAPE = re.compile(r"[\\#<:]"), re.compile(r"\\[bhlc]")
DECODES = {v: k for k, v in CODES.items()}
TOKEN = re.compile(r"\w+|[^\w\s]")

FORMATTED = (
    "conv_id long, window long, formatted string, loss_spans array<struct<start:int,stop:int>>, "
    "n_turns int, n_repeated int, n_tokens long, over_budget boolean"
)


WINDOWS = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()),
    ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()),
])
DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()),
])


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: CODES[m[0]], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: DECODES[m[0]], text)


def count_tokens(text: str) -> int:
    """Words and single marks; pass another counter for a tokenizer's own figures."""
    return len(TOKEN.findall(text))


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of every turn of a window; start and stop bound the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError("not a formatted window")
        text_at = formatted.index(COLON, at)
        stop = formatted.index(END, text_at)
        start = text_at + len(COLON)
        out.append((unescape(formatted[at + len(HEAD) : text_at]), unescape(formatted[start:stop]), start, stop))
        at = stop + len(END)
    return out


class _Window:
    """The turns of one conversation that the next window may hold: the system turn, limited history, and new turns."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, int] | None = None
        self.past: list[tuple[str, int]] = []
        self.new: list[tuple[str, int, bool, int, int]] = []
        self.used = self.number = 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        head = HEAD + escape(role) + COLON
        body = escape(text)
        turn = (head + body + END, tokens, role == "assistant", len(head), len(head) + len(body))
        if self.new and self._fixed() + self.used + tokens > self.budget:
            yield self.close()
        if not self.new:
            self._trim(tokens)
        self.new.append(turn)
        self.used += tokens

    def _fixed(self) -> int:
        return (self.system[1] if self.system else 0) + sum(t for _, t in self.past)

    def _trim(self, tokens: int) -> None:
        """Drop the oldest history until prefix sums fit its limit and leave room for the turn to come."""
        room = min(self.history, self.budget - (self.system[1] if self.system else 0) - tokens)
        sums = list(accumulate(t for _, t in reversed(self.past)))
        fit = sum(s <= room for s in sums)
        self.past = self.past[len(self.past) - fit :]

    def close(self) -> tuple:
        fixed = ([self.system] if self.system else []) + self.past
        parts, at, spans = [p for p, _ in fixed], sum(len(p) for p, _ in fixed), []
        for text, _, target, start, stop in self.new:
            if target:
                spans.append({"start": at + start, "stop": at + stop})
            parts.append(text)
            at += len(text)
        tokens = self._fixed() + self.used
        row = (self.conv_id, self.number, "".join(parts), spans, len(self.new), len(fixed), tokens, tokens > self.budget)
        if self.number == 0 and self.new and self.new[0][0].startswith(HEAD + "system" + COLON):
            first = self.new[0]
            self.system = (first[0], first[1])
            self.past += [(t, n) for t, n, *_ in self.new[1:]]
        else:
            self.past += [(t, n) for t, n, *_ in self.new]
        self._trim(0)
        self.new, self.used, self.number = [], 0, self.number + 1
        return row


def format_conversations(
    turns: DataFrame, budget: int = 512, history: int = 128, counter=count_tokens,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per window: the formatted text, the spans under the loss mask, new turns, repeated turns, tokens.

    Turns go in order of (turn, role, text), nulls first; null roles and texts are empty; turns and ids that aren't whole numbers are null; a null conversation id is a
    conversation of its own; repeated rows are turns of their own. Windows hold whole turns in order: a turn starts a new one
    when the prefix sum with it would pass `budget`. Each later window repeats a system turn that opened the conversation and as many
    of the last turns as fit in `history` tokens. Only new assistant turns are under the loss mask, so each is a target once.
    A turn larger than the budget gets a window of its own, marked over_budget; nothing is cut. Rows stream
    through a task in sorted order and only the open window is held, so a long conversation needs no more memory.
    """

    def run(batches):
        open_ = None
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        rows.append(open_.close())
                    open_ = _Window(conv_id, budget, history)
                rows.extend(open_.add(role, text, counter(text)))
            yield _batch(rows, WINDOWS)
        if open_ is not None:
            yield _batch([open_.close()], WINDOWS)

    return _in_order(turns, conv_col, [turn_col, role_col, text_col]).mapInArrow(run, FORMATTED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def _in_order(turns: DataFrame, conv_col: str, order: list[str]) -> DataFrame:
    turn, role, text = order
    return (
        turns.select(
            whole_number(conv_col).alias("conv_id"), whole_number(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) from formatted windows alone.

    Windows of a conversation must stand together and in order in a partition, as format_conversations() gives them.
    """

    def run(batches):
        now = None
        for batch in batches:
            rows = []
            for conv_id, formatted, spans, n_repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans", "n_repeated"))):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        rows.append(_digests(now))
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns = parse(formatted)
                for role, text, _, _ in turns[n_repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    target = unescape(formatted[span["start"] : span["stop"]])
                    now[3] += len(target)
                    now[4].update(target.encode("utf-8", "surrogatepass"))
                now[5] += len(formatted)
                now[6] += 1
            yield _batch(rows, DIGESTS)
        if now is not None:
            yield _batch([_digests(now)], DIGESTS)

    return windows.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    )


def _digests(now):
    return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6])
